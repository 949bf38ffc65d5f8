"""A name found once is found everywhere in its text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.functions import lexicon as X
from spanveil.functions.spans import hits, let, no_spans, quoted, union
from spanveil.operators.detectors import STOP_WORD
from spanveil.schema import NAME_LABELS

# Word length from which a part of a name spreads, its share of the confidence, and the model confidence from
# which a name spreads at all.
LEAST_PART, PART_SHARE, LEAST_MODEL = 3, 0.9, 0.75
NEEDLES_DDL = "array<struct<needle:string,label:string,conf:double>>"


def needles(spans: Column, least_part: int = LEAST_PART, least_model: float = LEAST_MODEL) -> Column:
    """What to look for: full names and their capitalised parts; the first label to claim one keeps it."""
    seeds = F.filter(spans, lambda s: s.label.isin(*NAME_LABELS) & ((s.source != "model") | (s.confidence >= least_model)))

    def of(s: Column) -> Column:
        full = F.regexp_replace(s["text"], r"(?U)^\s+|\s+\z", "")
        words = F.transform(F.split(full, r"(?U)\s+", -1), lambda w: F.regexp_replace(w, r"^\.+|\.+\z", ""))
        parts = F.filter(words, lambda w: (F.length(w) >= least_part) & w.rlike(r"^\p{Lu}") & ~w.rlike(STOP_WORD))
        one = F.struct(full.alias("needle"), s.label.alias("label"), s.confidence.alias("conf"))
        return F.concat(
            F.array(one),
            F.transform(parts, lambda w: F.struct(w.alias("needle"), s.label.alias("label"), (s.confidence * PART_SHARE).alias("conf"))),
        )

    def labelled(label: str) -> Column:
        return F.filter(seeds, lambda s: s.label == label)

    by_label = F.concat(*map(labelled, NAME_LABELS))
    every = F.flatten(F.transform(by_label, of))
    return F.aggregate(
        every,
        F.array().cast(NEEDLES_DDL),
        lambda acc, n: F.when(F.exists(acc, lambda k: k.needle == n.needle), acc).otherwise(F.concat(acc, F.array(n))),
    )


# Nothing that goes on with the word may follow a name: no word character, and no apostrophe but in "'s".
AFTER = r"(?!\w|['’](?!s\b)\w)"


def mentions(text: Column, wanted: Column) -> Column:
    """Spans of every needle as a whole word; "'s" may follow, other apostrophes may not touch it.

    One scan for the places where any needle begins; all needles are then held against each place.
    """
    some = F.array_join(F.transform(wanted, lambda n: quoted(n.needle)), "|")
    places = hits(text, F.concat(F.lit(X.FLAGS + r"(?<![\w'’])(?=(?:"), some, F.lit(")" + AFTER + ")")))

    def here(h: Column) -> Column:
        def fits(n: Column) -> Column:
            size = F.length(n.needle)
            rest = F.substring(text, h["start"] + size + 1, F.lit(3))
            return (F.substring(text, h["start"] + 1, size) == n.needle) & rest.rlike(X.FLAGS + "^" + AFTER)

        return F.transform(
            F.filter(wanted, fits),
            lambda n: F.struct(
                n.label.alias("label"),
                n.needle.alias("text"),
                h["start"].alias("start"),
                (h["start"] + F.length(n.needle)).cast("int").alias("end"),
                n.conf.cast("double").alias("confidence"),
                F.lit("propagated").alias("source"),
                F.lit(40_000_000).alias("seq"),
            ),
        )

    return F.flatten(F.transform(places, here))


def propagate(text: Column, spans: Column, wanted: Column) -> Column:
    """The spans and every other mention of their names (``wanted``: the needles, as a column of their own)."""
    def new(known: Column) -> Column:
        return F.filter(
            mentions(text, wanted),
            lambda m: ~F.exists(
                known,
                lambda k: ((k["start"] == m["start"]) & (k["end"] == m["end"]))
                | (~k.label.isin(*NAME_LABELS) & (k["start"] <= m["start"]) & (m["end"] <= k["end"])),
            ),
        )

    return union([spans, F.when(F.size(wanted) > 0, let(spans, new)).otherwise(no_spans())])
