"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.operators.redact import as_record
from spanveil.schema import CLASS_IDS


def results_json(df: DataFrame, path: str, spans: str = "spans", include_values: bool = False) -> None:
    """Results as JSON lines; without values no original text leaves."""
    df.select(F.to_json(as_record(spans, include_values)).alias("value")).write.mode("overwrite").text(path)


def redacted_text(df: DataFrame, path: str) -> None:
    df.select(F.coalesce("deidentified_text", F.lit("")).alias("value")).write.mode("overwrite").text(path)


def report(df: DataFrame, path: str) -> None:
    """A report of a few rows as one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def prepared(split: DataFrame, path: str) -> None:
    """Train and validation documents by part, and the class names beside them."""
    split.write.mode("overwrite").partitionBy("part").parquet(f"{path}/documents")
    names = split.sparkSession.createDataFrame(sorted(CLASS_IDS.items(), key=lambda x: x[1]), "label string, id int")
    names.coalesce(1).write.mode("overwrite").json(f"{path}/labels")
    keep = ("document", "tokens", "trailing_whitespace", "labels")
    split.filter("part = 'validation'").select(*keep).write.mode("overwrite").json(f"{path}/validation")


def corpus(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
