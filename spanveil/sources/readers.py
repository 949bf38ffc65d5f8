"""Readers.  Schemas are declared, never inferred."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.schema import ALL_LABELS, CORPUS_DDL, MANIFEST_DDL

#: Longest text a request may carry.
MOST_CHARS = 200_000


def texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``path, text``."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def corpus(spark: SparkSession, path: str, limit: int = 0, lines: bool = False) -> DataFrame:
    """Labelled documents from files that hold one JSON array each, or JSON ``lines`` (which split over tasks); ``limit`` keeps
    the first ones by id."""
    docs = spark.read.schema(CORPUS_DDL).json(path, multiLine=not lines)
    return docs.orderBy("document").limit(limit) if limit else docs


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Model manifest: JSON lines, blank lines and ``#`` lines left out, the last of equal names kept."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    rows = lines.filter("trim(value) <> '' and not trim(value) like '#%'").select("at", F.from_json("value", MANIFEST_DDL).alias("m"))
    last = rows.groupBy("m.name").agg(F.max(F.struct("at", "m")).alias("x"))
    return last.select("x.m.*")


def resolve_model(spark: SparkSession, manifest_rows: DataFrame, name: str | None, default: str) -> str:
    """A folder is itself; a listed name gives its local path if that exists, else its published id; anything else passes through."""
    want = name or default
    if os.path.isdir(want):
        return want
    rows = manifest_rows.filter(F.col("name") == want).select("local_path", "hf_id").limit(1).collect()
    if not rows:
        return want
    local = rows[0].local_path
    return local if local and os.path.exists(local) else rows[0].hf_id


def resolve_models(asked: DataFrame, manifest_rows: DataFrame) -> DataFrame:
    """``name, place`` of many names at once, by a join: the local path if that exists, else the published id, else the name itself."""
    listed = manifest_rows.groupBy("name").agg(F.first("local_path", True).alias("local_path"), F.first("hf_id", True).alias("hf_id"))
    paths = [r.local_path for r in listed.filter("local_path is not null").select("local_path").distinct().limit(10_000).collect()]
    there = [p for p in paths if os.path.exists(p)]
    local = F.when(F.col("local_path").isin(*there), F.col("local_path")) if there else F.lit(None)
    return asked.join(listed, "name", "left").select("name", F.coalesce(local, "hf_id", "name").alias("place"))


def downloads_allowed(flag: str | None) -> bool:
    return (flag or "").strip().lower() in {"1", "true", "yes"}


def prepared(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def check_requests(requests: DataFrame, models: DataFrame, policies: DataFrame) -> DataFrame:
    """Add ``status`` and ``problem`` to requests (``text, model_name, labels, policy``): 200, or 400/422 with the reason.

    Names are looked up by joins, so lists of models and policies may have any size.
    """
    wrong = F.coalesce(F.exists("labels", lambda l: ~F.coalesce(l.isin(*ALL_LABELS), F.lit(False))), F.lit(False))
    known = models.select(F.col("name").alias("_model")).filter("_model is not null").distinct().withColumn("_m", F.lit(True))
    named = policies.select(F.col("name").alias("_policy")).filter("_policy is not null").distinct().withColumn("_p", F.lit(True))
    rows = requests.join(known, F.col("model_name") == F.col("_model"), "left").join(named, F.col("policy") == F.col("_policy"), "left")
    problem = (
        F.when(F.col("text").isNull(), "no text")
        .when(F.length("text") > MOST_CHARS, "text too long")
        .when(F.col("model_name").isNotNull() & (F.col("model_name") != "rules") & F.col("_m").isNull(), "unknown model")
        .when(F.col("policy").isNotNull() & F.col("_p").isNull(), "unknown policy")
        .when(wrong, "unknown label")
    )
    status = F.when(problem.isNull(), 200).when(problem.isin("no text", "text too long"), 422).otherwise(400)
    return rows.withColumn("problem", problem).withColumn("status", status).drop("_model", "_m", "_policy", "_p")


#: Problems after a request was accepted, and their statuses.
REFUSED = {"model unavailable": 503, "leak": 422}


def answers(requests: DataFrame, results: DataFrame, key: str, model_ready: bool = True) -> DataFrame:
    """Checked requests with what they get: ``deidentified_text`` for status 200 only.

    A request for a model that isn't ready is refused with 503; one whose text still holds a value that was to be removed with 422 and
    without its text.
    """
    rows = requests.join(results.select(key, "deidentified_text", F.size("leaks").alias("_leaks")), key, "left")
    asks = F.col("model_name").isNotNull() & (F.col("model_name") != "rules")
    later = F.when(asks & F.lit(not model_ready), "model unavailable").when(F.col("_leaks") > 0, "leak")
    rows = rows.withColumn("problem", F.coalesce("problem", later))
    code = F.when(F.col("problem") == "model unavailable", REFUSED["model unavailable"]).when(F.col("problem") == "leak", REFUSED["leak"]).otherwise(F.col("status"))
    rows = rows.withColumn("status", code.cast("int"))
    return rows.withColumn("deidentified_text", F.when(F.col("status") == 200, F.col("deidentified_text"))).drop("_leaks")
