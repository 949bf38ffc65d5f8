"""The same expressions on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.plans.analyze import analyze, deidentify


def analyze_stream(texts: DataFrame, text: str = "text", **options) -> DataFrame:
    """Stateless: detection needs nothing but the row."""
    return analyze(texts, text, **options)


def deidentify_stream(texts: DataFrame, policy: str = "ferpa", text: str = "text", **options) -> DataFrame:
    """Stateless; surrogates are hashes, so equal values stay equal across batches.  Leaking rows are marked, not raised."""
    return deidentify(texts, policy, text, verify=False, **options)


def label_counts(texts: DataFrame, time: str, window: str = "1 hour", late: str = "1 day", text: str = "text") -> DataFrame:
    """Spans per label and event-time window; rows later than the watermark are left out."""
    found = analyze(texts.withWatermark(time, late), text)
    rows = found.select(time, F.explode("spans").alias("s")).groupBy(F.window(time, window), F.col("s.label").alias("label"))
    return rows.agg(F.count("*").alias("spans"))


def run_to_table(stream: DataFrame, path: str) -> DataFrame:
    """Process what is there, exactly once per file, into a table; called again it goes on where it stopped."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/_state").option("path", f"{path}/rows").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
