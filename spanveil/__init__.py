"""spanveil: span extraction, span algebra, redaction and scoring on Spark DataFrames.

Batch and streaming share the same column expressions.  The optional subpackage
``spanveil.llm`` holds operators for preparing training data; nothing here imports it.
"""

__version__ = "0.1.0"
