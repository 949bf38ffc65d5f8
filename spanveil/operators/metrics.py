"""Span-level scoring: interval semi and anti joins within a document, then grouped counts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.schema import ALL_LABELS, CORPUS_LABELS

# Recall weighs five to one; ratios have four places.
BETA2, PLACES = 25.0, 4
MOST_LEAKS = 200


def scope(name: str) -> tuple[str, ...]:
    return {"corpus": CORPUS_LABELS, "all": ALL_LABELS}[name]


def f_beta(precision: Column, recall: Column, beta2: float = BETA2) -> Column:
    return F.when(precision + recall > 0, (1 + beta2) * precision * recall / (beta2 * precision + recall)).otherwise(0.0)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _touch(gold: DataFrame, pred: DataFrame, key: str, same_label: bool) -> Column:
    cond = (gold[key] == pred[key]) & (gold.start < pred.end) & (pred.start < gold.end)
    return cond & (gold.label == pred.label) if same_label else cond


def judged(gold: DataFrame, pred: DataFrame, key: str = "document", labels: Iterable[str] = CORPUS_LABELS) -> DataFrame:
    """``kind`` (tp, fn, fp) of each span, ``exposed`` for gold spans that nothing of any label touches.

    Both sides have ``key, label, start, end``.  A gold span is found if a prediction of its label overlaps it; a prediction is wrong only
    if it overlaps no gold span of its label.  Each side is flagged by one aggregate over its overlaps, so the range condition only ever
    filters within a document.
    """
    labels = list(labels)
    g = gold.filter(F.col("label").isin(*labels)).select(key, "label", "start", "end").withColumn("_id", F.monotonically_increasing_id())
    p = pred.select(F.col(key).alias("_k"), F.col("label").alias("_l"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    near = (F.col(key) == F.col("_k")) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end"))
    found = g.join(p, near, "left").groupBy(key, "label", "start", "end", "_id").agg(
        F.max(F.coalesce(F.col("label") == F.col("_l"), F.lit(False))).alias("hit"), F.max(F.col("_k").isNotNull()).alias("seen")
    )
    gold_side = found.select(key, "label", "start", "end", F.when(F.col("hit"), "tp").otherwise("fn").alias("kind"), (~F.col("seen")).alias("exposed"))
    q = pred.filter(F.col("label").isin(*labels)).select(key, "label", "start", "end")
    other = gold.select(F.col(key).alias("_k"), F.col("label").alias("_l"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    wrong = q.join(other, near & (F.col("label") == F.col("_l")), "left_anti")
    return gold_side.unionByName(wrong.select(key, "label", "start", "end", F.lit("fp").alias("kind"), F.lit(False).alias("exposed")))


def prf(kinds: DataFrame) -> DataFrame:
    """Per label, and overall under a null label: counts, precision, recall, F, exposed."""
    count = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0))
    g = kinds.rollup("label").agg(count("tp").alias("tp"), count("fp").alias("fp"), count("fn").alias("fn"), F.sum(F.col("exposed").cast("int")).alias("exposed"))
    g = g.withColumn("p", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("r", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return g.select(
        "label", "tp", "fp", "fn", F.round("p", PLACES).alias("precision"), F.round("r", PLACES).alias("recall"),
        F.round(f_beta(F.col("p"), F.col("r")), PLACES).alias("f5"), "exposed",
    )


def leaks(kinds: DataFrame, texts: DataFrame, key: str = "document", most: int = MOST_LEAKS) -> DataFrame:
    """The first missed gold spans with their text; the limit is the size of the report."""
    missed = kinds.filter("kind = 'fn'").join(texts.select(key, "text"), key)
    value = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    return missed.select(key, "label", "start", value.alias("value"), "exposed").orderBy(key, "start", "label").limit(most)


def report(kinds: DataFrame, documents: int, model: str = "rules") -> DataFrame:
    """One row: overall figures, per-label figures and what would have got through."""
    m = prf(kinds)
    row = F.struct("tp", "fp", "fn", "precision", "recall", "f5")
    return m.agg(
        F.lit(model).alias("model"),
        F.lit(documents).cast("bigint").alias("docs"),
        F.first(F.when(F.col("label").isNull(), row), True).alias("overall"),
        F.map_from_entries(F.collect_list(F.when(F.col("label").isNotNull(), F.struct(F.col("label"), row)))).alias("per_label"),
        F.sum(F.when(F.col("label").isNull(), F.col("tp") + F.col("fn"))).alias("identifiers"),
        F.sum(F.when(F.col("label").isNull(), F.col("exposed"))).alias("exposed"),
    ).withColumn("removed_under_any_label", F.when(F.col("identifiers") > 0, F.round(1 - F.col("exposed") / F.col("identifiers"), PLACES)))


def token_metrics(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Token-level counts over class ids; a wrong label is a false positive and a false negative."""
    g, p = F.col(gold), F.col(pred)
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    n = df.filter(g.isNotNull() & (g >= 0)).agg(one((g > 0) & (g == p)).alias("tp"), one((p > 0) & (g != p)).alias("fp"), one((g > 0) & (g != p)).alias("fn"))
    n = n.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return n.withColumn("f5", f_beta(F.col("precision"), F.col("recall")))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two scorers' logits: share of rows with the same best class, and the largest difference of a logit."""
    best = lambda c: F.array_position(F.col(c), F.array_max(c))
    gap = F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    return df.agg(F.avg((best(a) == best(b)).cast("int")).alias("same_argmax"), F.max(gap).alias("max_difference"))
