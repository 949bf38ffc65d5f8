"""The span algebra as column expressions: no UDF, no shuffle.

A span is a struct (``spanveil.schema.SPAN``) with half-open offsets in code points.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.schema import SPANS_DDL

HIT_DDL = "array<struct<start:int,end:int,text:string,groups:array<string>>>"
# Fixed value: characters that never end a span.
TRAILING = r"""[.,;:)\]}'"]+\z"""


def no_spans() -> Column:
    return F.array().cast(SPANS_DDL)


#: Matches that one fold places; more are placed block by block, since a fold copies its result with every match.
BLOCK = 48


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often it is used."""
    return F.transform(F.array(value), body)[0]


def fenced(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row whatever is done with it later.

    A generator stands between it and the rest of the plan, so filters on it aren't rewritten into filters on what it is
    computed from, which would compute that again.
    """
    rest = [c for c in df.columns if c != name]
    return df.select(*[F.col(f"`{c}`") for c in rest], F.explode_outer(F.array(value)).alias(name))


def _placed(rows: Column, at: Column) -> Column:
    start = F.struct(at.cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc.at + F.length(x.g)
        b = a + F.length(x.h)
        one = F.struct(a.alias("start"), b.alias("end"), x.h.alias("text"))
        return F.when(x.h.isNull(), acc).otherwise(F.struct(b.alias("at"), F.concat(acc.out, F.array(one)).alias("out")))

    return F.aggregate(rows, start, step, lambda acc: acc.out)


def _placed_in_blocks(rows: Column) -> Column:
    def whole(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + F.length(x.g) + F.coalesce(F.length(x.h), F.lit(0))))
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(sizes, first, lambda acc, n: F.struct((acc.at + n).alias("at"), F.array_append(acc.out, acc.at).alias("out")), lambda acc: acc.out)
        return F.flatten(F.zip_with(blocks, starts, _placed))

    cuts = F.transform(F.sequence(F.lit(1), F.size(rows), F.lit(BLOCK)), lambda k: F.slice(rows, k, BLOCK))
    return let(cuts, whole)


#: Noncharacters of Unicode that mark matches, their groups and their ends in a text; ``unmarked`` keeps them out of texts.
OPEN, SEP, CLOSE = "\ufdd0", "\ufdd1", "\ufdd2"


def unmarked(text: Column) -> Column:
    """A text without the marks of ``hits``: replaced one for one, so offsets stay."""
    return F.when(text.rlike(f"[{OPEN}-{CLOSE}]"), F.translate(text, OPEN + SEP + CLOSE, "\ufffd" * 3)).otherwise(text)


def hits(text: Column, pattern: str | Column, groups: int = 0) -> Column:
    """Every match of a pattern: ``start, end, text, groups``; groups that took no part are ''.

    One scan: matches and groups are marked in the text, and a fold over the marked pieces gives offsets.  The text
    must be ``unmarked``.
    """
    marks = OPEN + SEP.join(f"${k}" for k in range(groups + 1)) + CLOSE
    return let(F.regexp_replace(text, pattern, F.lit(marks)), lambda m: F.when(m.contains(OPEN), _read(m)).otherwise(F.array().cast(HIT_DDL)))


def _read(marked: Column) -> Column:
    def rows(pieces: Column) -> Column:
        cut = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda p: F.split(p, CLOSE, 2))
        first = F.struct(F.length(pieces[0]).alias("at"), F.array().cast(HIT_DDL).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            def put(fields: Column) -> Column:
                end = acc.at + F.length(fields[0])
                one = F.struct(acc.at.alias("start"), end.alias("end"), fields[0].alias("text"), F.slice(fields, 2, F.size(fields)).alias("groups"))
                return F.struct((end + F.length(x[1])).alias("at"), F.array_append(acc.out, one).alias("out"))

            return let(F.split(x[0], SEP, -1), put)

        return F.aggregate(cut, first, step, lambda acc: acc.out)

    return let(F.split(marked, OPEN, -1), rows)


def pieces(text: Column, pattern: str) -> Column:
    """Every match of a pattern that has hundreds of them or more in a text: ``start, end, text``."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(F.zip_with(gaps, found, lambda g, h: F.struct(g.alias("g"), h.alias("h"))), _placed_in_blocks)


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, TRAILING, "")


def span(label: str, start: Column, value: Column, confidence: Column | float, seq: Column | int, source: str = "rules") -> Column:
    """A span whose value begins at ``start``; trailing punctuation is cut off."""
    t = trimmed(value)
    return F.struct(
        F.lit(label).alias("label"),
        t.alias("text"),
        start.cast("int").alias("start"),
        (start + F.length(t)).cast("int").alias("end"),
        (F.lit(confidence) if isinstance(confidence, float) else confidence).cast("double").alias("confidence"),
        F.lit(source).alias("source"),
        (F.lit(seq) if isinstance(seq, int) else seq).cast("int").alias("seq"),
    )


def drop_blank(spans: Column) -> Column:
    return F.filter(spans, lambda s: s.text.rlike(r"(?U)\S"))


def overlaps(a: Column, b: Column) -> Column:
    """Half-open intervals that share a position."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _by(*keys: tuple[Column, Column]) -> Column:
    out = None
    for x, y in keys:
        out = F.when(x < y, -1).when(x > y, 1) if out is None else out.when(x < y, -1).when(x > y, 1)
    return out.otherwise(0)


def resolve(spans: Column) -> Column:
    """Greedy choice among overlapping spans: higher confidence, then longer, then from the model, then earlier, then in the
    order of emission.  A span beaten only by a span that lost itself survives.  In order of start."""

    def size(s: Column) -> Column:
        return s["end"] - s["start"]

    def rank(s: Column) -> Column:
        return F.when(s.source == "model", 0).otherwise(1)

    ordered = F.array_sort(
        spans,
        lambda a, b: _by((b.confidence, a.confidence), (size(b), size(a)), (rank(a), rank(b)), (a["start"], b["start"]), (a.seq, b.seq)),
    )
    kept = F.aggregate(
        ordered, no_spans(), lambda acc, s: F.when(F.exists(acc, lambda k: overlaps(s, k)), acc).otherwise(F.concat(acc, F.array(s)))
    )
    return by_start(kept)


def by_start(spans: Column) -> Column:
    return F.array_sort(spans, lambda a, b: _by((a["start"], b["start"]), (a["end"], b["end"]), (a.seq, b.seq)))


def quoted(value: Column) -> Column:
    """A regular expression that matches a value literally, whatever is in it."""
    return F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def guarded(text: Column, guard: Column, spans: Column) -> Column:
    """Spans only where a cheap test passes; an empty array elsewhere, also for null."""
    return F.when(text.isNotNull() & guard, spans).otherwise(no_spans())


def union(parts: Sequence[Column]) -> Column:
    return F.concat(*parts) if parts else no_spans()
