"""Problem 7: evaluation passages inside corpus documents.

A prefix-filtered set join.  Each run of ten item words is a set of which a window must hold every element, so its
rarest word by corpus frequency is a necessary prefix of length one.  Documents without any prefix word go first;
occurrences of prefix words in the rest give, with the word's offset in the run, the only window that could match (positional
bound, window inside the text), and that window is compared word by word.

Runs, words and frequencies stay tables throughout.  What every task gets is a filter of words of fixed size, and a side of a join where
Spark finds its files to be under its limit for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.textkit import NOT_WORD
from spanveil.plans.session import Scratch

RUN = 10
#: Bits of the word filter: 8,192 bytes whatever the number of items.
FILTER_BITS = 1 << 16


def words_of(text) -> Column:
    """Words of a text in order; a text that starts with a separator has an empty string in front."""
    return F.split(F.lower(text), NOT_WORD)


def item_runs(items: DataFrame) -> DataFrame:
    """``item_id, run_no, run``: each run of ten consecutive words of each item."""
    w = items.filter("item_id is not null and text is not null").select("item_id", words_of("text").alias("w"))
    w = w.select("item_id", F.filter("w", lambda x: x != "").alias("w")).filter(F.size("w") >= RUN)
    w = w.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - RUN)).alias("run_no"))
    return w.select("item_id", "run_no", F.slice("w", F.col("run_no") + 1, RUN).alias("run")).distinct()


def _cell(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(FILTER_BITS)).cast("int")


def _filter(words: DataFrame) -> Column:
    """A bit per cell some word of the table falls into, as a constant; the cells, not the words, come to the driver."""
    cells = words.select(_cell(F.col("word")).alias("c")).distinct().toArrow().column("c").to_pylist()
    bits = [0] * (FILTER_BITS // 32)
    for c in cells:
        bits[c >> 5] |= 1 << (c & 31)
    return F.expr("array(" + ",".join(f"{b}L" for b in bits) + ")")


def _may_be(word: Column, bits: Column) -> Column:
    """Whether a word's cell is set; false for words that are certainly not in the table."""
    c = _cell(word)
    return F.get(bits, F.shiftright(c, 5)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), c.bitwiseAND(F.lit(31)))) != 0


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, run_no, position``: a run of an item, and the position in the document's words where it stands.

    Null or blank texts, texts of fewer than ten words and rows without an id give nothing; repeated rows count once.
    """
    scratch = Scratch(documents.sparkSession)
    runs = scratch.stage(item_runs(items), "runs")
    vocabulary = scratch.stage(runs.select(F.explode("run").alias("word")).distinct(), "vocabulary")
    docs = documents.filter("doc_id is not null and text is not null").select("doc_id", words_of("text").alias("w"))
    docs = docs.filter(F.size("w") >= RUN)
    # Each task counts its own documents' words first; the join with the vocabulary comes before anything is shuffled where that is small.
    seen = docs.select(F.explode(F.array_distinct("w")).alias("word")).join(vocabulary, "word", "left_semi")
    frequency = scratch.stage(seen.groupBy("word").agg(F.count("*").alias("df")), "frequency")
    # A run with a word that no document has can't occur.  The rarest word (ties: first in alphabet) is its prefix.
    each = runs.select("item_id", "run_no", F.posexplode("run").alias("at", "word")).join(frequency, "word")
    best = each.groupBy("item_id", "run_no").agg(F.count("*").alias("c"), F.min(F.struct("df", "word", "at")).alias("p"))
    prefixes = best.filter(F.col("c") == RUN).select("item_id", "run_no", F.col("p.word").alias("word"), F.col("p.at").alias("at"))
    prefixes = scratch.stage(prefixes.join(runs, ["item_id", "run_no"]), "prefixes")
    bits = _filter(prefixes.select("word"))
    # Words are tested and joined where they are exploded, in one compiled loop: only those that begin a candidate are ever stored.
    near = docs.select("doc_id", "w", F.posexplode("w").alias("pos", "word")).filter(_may_be(F.col("word"), bits)).join(prefixes, "word")
    position = F.col("pos") - F.col("at")
    near = near.withColumn("position", position).filter((position >= 0) & (position + RUN <= F.size("w")))
    exact = near.filter(F.slice("w", F.col("position") + 1, RUN) == F.col("run"))
    return exact.select("doc_id", "item_id", "run_no", "position").distinct()


def leaked_documents(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id`` pairs."""
    return leaks(documents, items).select("doc_id", "item_id").distinct()


def exposed_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, documents, runs, covered``: exposed items, the documents that expose them, their distinct runs found, and
    the share of the item's runs these are."""
    found = leaks(documents, items)
    total = item_runs(items).groupBy("item_id").agg(F.countDistinct("run_no").alias("all_runs"))
    out = found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("run_no").alias("runs"))
    return out.join(total, "item_id").select("item_id", "documents", "runs", (F.col("runs") / F.col("all_runs")).alias("covered"))
