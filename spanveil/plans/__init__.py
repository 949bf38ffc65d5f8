"""Query plans assembled from the operators, and session helpers."""
