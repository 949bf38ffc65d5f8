"""Problem 2: the same or nearly the same record in an evaluation split and in training.

Minwise hashes of three-word shingles in banded buckets.  Training classes meet evaluation classes only, and a training key leaves its
task only if an evaluation key can equal it; exact Jaccard similarity decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm import overlap
from spanveil.llm.overlap import BLOCK, blocks, cell_of
from spanveil.llm.textkit import mix
from spanveil.plans.session import Scratch

SHINGLE = 3
THRESHOLD = 0.5
BANDS = 72
ROWS = 4
TRAIN = "train"

_ORDERS = (mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFTS = (mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
_SLICE = 512


def band_keys(distinct: np.ndarray) -> np.ndarray:
    """One bucket key per band of ``ROWS`` minwise hashes of a set.  A pair of similarity s shares none with probability
    (1 - s**ROWS) ** BANDS: 0.0096 at 0.5, 5e-5 at 0.6, 3e-9 at 0.7."""
    least = np.full(len(_ORDERS), np.iinfo(np.uint32).max, dtype=np.uint32)
    short = (distinct >> np.uint64(32)).astype(np.uint32) ^ distinct.astype(np.uint32)
    for k in range(0, len(short), _SLICE):
        np.minimum(least, ((short[k : k + _SLICE, None] ^ _SHIFTS) * _ORDERS).min(axis=0), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key


def bucket_rows(sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """``key, cls, n, train``: the bucket keys of classes with their splits (``t``, ``e``), for each side it has members on.

    Keys that no class of the other side can have are left out, by a sketch of each side's keys.  A bucket of more than ``block`` rows on
    a side is split there, and the other side's rows go to each part.
    """
    each = sets.select("t", "e", F.explode("keys").alias("key"))
    counted = overlap.sketch(each, "key", F.sum(F.col("t").cast("int")), F.sum(F.col("e").cast("int")))
    counts = sets.sparkSession.sparkContext.broadcast(counted)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [-(-c // block) for c in counts.value]
        for b in it:
            flat = b.column("keys").flatten().to_numpy()
            owner = np.repeat(np.arange(b.num_rows), np.diff(b.column("keys").offsets.to_numpy()))
            for train, flag in ((True, "t"), (False, "e")):
                on = b.column(flag).to_numpy(zero_copy_only=False)[owner]
                key, who = flat[on], owner[on]
                cell = cell_of(key)
                own, other = parts[0 if train else 1][cell], parts[1 if train else 0][cell]
                keep = other > 0
                key, who, own, other = key[keep], who[keep], own[keep], other[keep]
                cls, n = b.column("cls").to_numpy()[who], b.column("n").to_numpy()[who]
                mine = (mix(cls.astype(np.uint64)) % own.astype(np.uint64)).astype(np.int64)
                again = np.repeat(np.arange(len(key)), other)
                theirs = np.arange(len(again)) - np.repeat(np.cumsum(other) - other, other)
                key, own, other, mine, cls, n = (x[again] for x in (key, own, other, mine, cls, n))
                i, j = (mine, theirs) if train else (theirs, mine)
                key = blocks(key, own * other, i, j)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(cls), pa.array(n), pa.array(np.full(len(key), train))], ["key", "cls", "n", "train"])

    return sets.select("cls", "n", "t", "e", "keys").mapInArrow(run, "key bigint, cls bigint, n int, train boolean")


def linked_classes(records: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, train: str = TRAIN) -> tuple[DataFrame, DataFrame]:
    """Members of the classes (``document, split, source, cls, in_train``), and links ``a`` (with members in training), ``b`` (with
    others), a class of both kinds linked to itself."""
    members, sets = overlap.classes(records, scratch, SHINGLE, band_keys)
    members = members.withColumn("in_train", F.coalesce(F.col("split") == train, F.lit(False)))
    has = scratch.stage(members.groupBy("cls").agg(F.max("in_train").alias("t"), F.max(~F.col("in_train")).alias("e")), "sides")
    rows = scratch.stage(bucket_rows(sets.join(has, "cls")), "buckets")
    l, r = rows.filter("train").alias("l"), rows.filter("not train").alias("r")
    fit = (F.col("l.key") == F.col("r.key")) & (F.col("l.cls") != F.col("r.cls"))
    fit = fit & (F.least("l.n", "r.n") >= F.greatest("l.n", "r.n") * threshold - 1e-9)
    pairs = l.join(r, fit).select(F.col("l.cls").alias("a"), F.col("r.cls").alias("b"))
    links = overlap.verified(pairs, sets, threshold, scratch).select("a", "b")
    same = has.filter("t and e").select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    links = scratch.stage(links.unionAll(same), "cross")
    scratch.drop("features", "classes", "sides", "buckets", "marks", "near", "named", "links")
    return members, links


def cross_split_pairs(records: DataFrame, threshold: float = THRESHOLD, train: str = TRAIN) -> DataFrame:
    """``document_a, document_b`` (a < b) plus ``train_document, eval_document``: one row per pair of different documents at this
    similarity, of which exactly one is in ``train``.

    A null ``split`` is no training split.  Rows without a ``document`` and texts of fewer than three words (null
    and blank ones too) are in no pair; repeated rows count once.
    """
    members, links = linked_classes(records, Scratch(records.sparkSession), threshold, train)
    x = members.filter("in_train").select(F.col("cls").alias("a"), F.col("document").alias("da")).distinct()
    y = members.filter("not in_train").select(F.col("cls").alias("b"), F.col("document").alias("db")).distinct()
    pairs = overlap.expanded(links, x, y).filter("da <> db")
    return pairs.select(
        F.least("da", "db").alias("document_a"), F.greatest("da", "db").alias("document_b"), F.col("da").alias("train_document"), F.col("db").alias("eval_document")
    ).distinct()


def cross_split_report(records: DataFrame, threshold: float = THRESHOLD, train: str = TRAIN) -> DataFrame:
    """Per evaluation split and source: pairs, evaluation documents and training documents involved.

    Counted from the sizes of classes, never from expanded pairs.  A document that comes with several texts counts its pairs once for
    each of them, one with several splits or sources once in each.
    """
    members, links = linked_classes(records, Scratch(records.sparkSession), threshold, train)
    x = members.filter("in_train").select(F.col("cls").alias("a"), F.col("document").alias("da")).distinct()
    y = members.filter("not in_train").select(F.col("cls").alias("b"), F.col("document").alias("db"), F.col("split").alias("eval_split"), F.col("source").alias("eval_source"))
    group = ["eval_split", "eval_source"]
    many = x.groupBy("a").agg(F.count("*").alias("tc"))
    met = links.join(y.groupBy("b", *group).agg(F.count("*").alias("ec")), "b").join(many, "a")
    # A document on both sides is no pair with itself.
    own = links.join(x.join(y, F.col("da") == F.col("db")), ["a", "b"])
    alone = own.groupBy("b", "db").agg(F.count("*").alias("self"))
    evals = y.join(links.join(many, "a").groupBy("b").agg(F.sum("tc").alias("far")), "b").join(alone, ["b", "db"], "left")
    evals = evals.filter("far > coalesce(self, 0)").groupBy(*group).agg(F.countDistinct("db").alias("n"))
    near = met.groupBy("a", *group).agg(F.sum("ec").alias("far")).join(x, "a").withColumn("self", F.lit(0))
    back = own.select("a", *group, F.lit(0).alias("far"), "da", F.lit(1).alias("self"))
    trains = near.unionByName(back).groupBy("a", "da", *group).agg(F.sum("far").alias("far"), F.sum("self").alias("self"))
    trains = trains.filter("far > self").groupBy(*group).agg(F.countDistinct("da").alias("n"))

    def part(df: DataFrame, n: Column, place: int) -> DataFrame:
        named = ("pairs", "eval_documents", "train_documents")
        return df.select(*group, *[(n if k == place else F.lit(0)).cast("bigint").alias(c) for k, c in enumerate(named)])

    rows = part(met, F.col("ec") * F.col("tc"), 0).unionAll(part(own, F.lit(-1), 0)).unionAll(part(evals, F.col("n"), 1)).unionAll(part(trains, F.col("n"), 2))
    return rows.groupBy(*group).agg(*[F.sum(c).alias(c) for c in ("pairs", "eval_documents", "train_documents")]).filter("pairs > 0")
