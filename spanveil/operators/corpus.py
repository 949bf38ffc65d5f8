"""Labelled documents: rebuilding text and spans from tokens, splitting, renumbering, encoding, projecting labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.functions import lexicon as X
from spanveil.functions.spans import hits, let, pieces
from spanveil.plans.session import stage
from spanveil.schema import CLASS_IDS

GOLD_DDL = "array<struct<label:string,start:int,end:int>>"
# Fixed value: marks an identifier inside a template, label and value.
MARK = r"(?s)⟦([A-Z_]+)\|(.*?)⟧"


def bio(label: Column) -> Column:
    """A BIO string in plain form: upper case, no blanks, '-' after B or I."""
    return F.regexp_replace(F.upper(F.trim(F.coalesce(label, F.lit("O")))), r"^([BI])[^A-Z0-9]\s*", "$1-")


def rebuilt_text(tokens: Column, spaces: Column) -> Column:
    return F.array_join(F.zip_with(tokens, spaces, lambda t, w: F.concat(F.coalesce(t, F.lit("")), F.when(w, " ").otherwise(""))), "")


def rebuilt_spans(tokens: Column, spaces: Column, labels: Column) -> Column:
    """Gold spans from BIO labels: one starts at B, or at I when none is open or the label changes."""
    rows = F.transform(
        F.arrays_zip(tokens.alias("t"), spaces.alias("w"), labels.alias("l")),
        lambda x: F.struct(F.length(F.coalesce(x.t, F.lit(""))).alias("n"), F.when(x.w, 1).otherwise(0).alias("w"), bio(x.l).alias("l")),
    )
    start = F.struct(F.lit(0).alias("at"), F.lit("O").alias("last"), F.array().cast(GOLD_DDL).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        name = F.substring(x.l, F.lit(3), F.length(x.l))
        end = acc.at + x.n
        opens = x.l.startswith("B-") | (x.l.startswith("I-") & (acc.last != name))
        fresh = F.struct(name.alias("label"), acc.at.alias("start"), end.alias("end"))
        tail = F.element_at(acc.out, -1)
        longer = F.concat(F.slice(acc.out, 1, F.size(acc.out) - 1), F.array(F.struct(tail.label.alias("label"), tail["start"].alias("start"), end.alias("end"))))
        out = F.when(opens, F.concat(acc.out, F.array(fresh))).when(x.l.startswith("I-"), longer).otherwise(acc.out)
        last = F.when(x.l.rlike("^[BI]-"), name).otherwise("O")
        return F.struct((end + x.w).alias("at"), last.alias("last"), out.alias("out"))

    return F.aggregate(rows, start, step, lambda acc: acc.out)


def rebuild(docs: DataFrame) -> DataFrame:
    """Add ``text`` and ``gold`` (array of label, start, end).  Null tokens give null, null labels no spans."""
    t, w, l = F.col("tokens"), F.coalesce("trailing_whitespace", F.array().cast("array<boolean>")), F.coalesce("labels", F.array().cast("array<string>"))
    return docs.withColumn("text", rebuilt_text(t, w)).withColumn("gold", rebuilt_spans(t, w, l))


def is_positive(labels: Column) -> Column:
    """Whether any token belongs to a span."""
    return F.exists(labels, lambda l: bio(l) != "O")


def encode(labels: Column) -> Column:
    """Class ids of BIO strings; null for a string that is none."""
    ids = F.create_map(*[F.lit(x) for kv in CLASS_IDS.items() for x in kv])
    return F.transform(labels, lambda l: F.try_element_at(ids, bio(l)))


def renumber(extra: DataFrame, docs: DataFrame, key: str = "document") -> DataFrame:
    """Give ``extra`` ids after the greatest one of ``docs``, in its own order of ids.

    Row numbers come from per-partition counts over a range partitioning, not from one global window.
    """
    top = docs.agg(F.coalesce(F.max(key), F.lit(-1)).alias("top")).first().top
    return numbered(extra, [F.col(key).asc_nulls_first()], "_n").withColumn(key, (F.lit(top + 1) + F.col("_n")).cast("bigint")).drop("_n")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number rows from 0 in a global order, without sending them all through one task."""
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    # The layout must not change between the count and the numbering.
    laid = stage(laid.withColumn("_i", F.monotonically_increasing_id()), "numbered")
    sizes = laid.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("_first"))
    before = sizes.select("_p", "_first", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return laid.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_i") - F.col("_first")).drop("_p", "_i", "_first", "_before")


def turn(key: str, seed: int) -> Column:
    """Position of a document in the seeded shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def split(docs: DataFrame, extra: DataFrame | None = None, neg_ratio: float = 0.3, val_frac: float = 0.1, seed: int = 42, key: str = "document") -> DataFrame:
    """All rows that stay, with ``part``: the first share of a seeded shuffle is validation, untouched; of the rest every positive
    document, a share of the negative ones and all of ``extra`` are train.  Null labels count as negative.
    """
    real = numbered(docs.withColumn("_turn", turn(key, seed)), [F.col("_turn"), F.col(key)], "_n")
    size = docs.count()
    cut = int(size * val_frac)
    val = real.filter(F.col("_n") < cut).withColumn("part", F.lit("validation"))
    rest = real.filter(F.col("_n") >= cut)
    positive = F.coalesce(is_positive(F.col("labels")), F.lit(False))
    negative = numbered(rest.filter(~positive).drop("_n"), [F.col("_turn"), F.col(key)], "_n")
    keep = int(rest.filter(~positive).count() * neg_ratio)
    train = rest.filter(positive).unionByName(negative.filter(F.col("_n") < keep)).withColumn("part", F.lit("train"))
    out = val.unionByName(train).drop("_turn", "_n")
    if extra is not None:
        out = out.unionByName(renumber(extra, docs, key).withColumn("part", F.lit("train")), allowMissingColumns=True)
    return out


def char_labels(tokens: Column, spaces: Column, labels: Column) -> Column:
    """The label of every character of the rebuilt text; blanks after tokens are O."""
    rows = F.arrays_zip(tokens.alias("t"), spaces.alias("w"), labels.alias("l"))
    return F.flatten(F.transform(rows, lambda x: F.concat(F.array_repeat(bio(x.l), F.length(F.coalesce(x.t, F.lit("")))), F.array_repeat(F.lit("O"), F.when(x.w, 1).otherwise(0)))))


def tokenise(text: Column) -> Column:
    """Runs of word characters and single other characters, with offsets."""
    return F.transform(pieces(text, X.TOKEN), lambda h: F.struct(h["text"].alias("token"), h["start"].alias("start"), h["end"].alias("end")))


def unmark(marked: Column) -> Column:
    """Plain text and spans of a text with marked identifiers; adjacent marks stay separate spans."""
    rows = F.zip_with(F.split(marked, MARK, -1), hits(marked, MARK, 2), lambda g, h: F.struct(g.alias("g"), h.alias("h")))
    start = F.struct(F.lit("").alias("text"), F.array().cast(GOLD_DDL).alias("gold"))

    def step(acc: Column, x: Column) -> Column:
        before = F.concat(acc.text, x.g)
        value = x.h.groups[1]
        one = F.struct(x.h.groups[0].alias("label"), F.length(before).alias("start"), (F.length(before) + F.length(value)).alias("end"))
        return F.when(x.h.isNull(), F.struct(before.alias("text"), acc.gold.alias("gold"))).otherwise(
            F.struct(F.concat(before, value).alias("text"), F.concat(acc.gold, F.array(one)).alias("gold"))
        )

    return F.aggregate(rows, start, step)


def to_bio(df: DataFrame, text: str = "text", gold: str = "gold") -> DataFrame:
    """Add ``tokens, trailing_whitespace, labels`` to texts with gold spans; a token takes the span its first character is in."""
    df = df.withColumn("_tok", tokenise(F.col(text)))

    def label(t: Column, spans: Column) -> Column:
        s = F.get(F.filter(spans, lambda s: (s["start"] <= t["start"]) & (t["start"] < s["end"])), 0)
        return F.when(s.isNull(), "O").otherwise(F.concat(F.when(t["start"] == s["start"], "B-").otherwise("I-"), s.label))

    return (
        df.withColumn("tokens", F.transform("_tok", lambda t: t.token))
        .withColumn("trailing_whitespace", let(F.col(text), lambda v: F.transform("_tok", lambda t: F.substring(v, t["end"] + 1, F.lit(1)).rlike(r"(?U)^\s"))))
        .withColumn("labels", let(F.col(gold), lambda spans: F.transform("_tok", lambda t: label(t, spans))))
        .drop("_tok")
    )


def locate_spans(df: DataFrame, sentences: str, values: str) -> DataFrame:
    """``text`` and ``gold`` from sentences and, for each, the values to be found in it (array of array of label, value)."""
    lengths = F.struct(F.lit(0).alias("at"), F.array().cast(GOLD_DDL).alias("gold"))
    pairs = F.zip_with(sentences, values, lambda s, v: F.struct(s.alias("s"), v.alias("v")))

    def step(acc: Column, x: Column) -> Column:
        here = F.transform(
            x.v,
            lambda v: F.struct(
                v.label.alias("label"), (acc.at + F.call_function("instr", x.s, v.value) - 1).cast("int").alias("start"),
                (acc.at + F.call_function("instr", x.s, v.value) - 1 + F.length(v.value)).cast("int").alias("end"),
            ),
        )
        return F.struct((acc.at + F.length(x.s) + 1).alias("at"), F.concat(acc.gold, F.filter(here, lambda g: g["start"] >= acc.at)).alias("gold"))

    return df.withColumn("text", F.array_join(sentences, " ")).withColumn("gold", F.aggregate(pairs, lengths, step, lambda acc: acc.gold))


def align(labels_by_char: Column, text: Column, offsets: Column, ignore: int = -100) -> Column:
    """Class id of each sub-token (``s, e``): that of its first character that is no blank; empty ones are ignored by training."""
    ids = F.create_map(*[F.lit(x) for kv in CLASS_IDS.items() for x in kv])

    def all_of(t: Column, labels: Column) -> Column:
        def one(o: Column) -> Column:
            piece = F.substring(t, o.s + 1, o.e - o.s)
            blank = F.length(piece) - F.length(F.regexp_replace(piece, r"(?U)^\s+", ""))
            at = o.s + blank
            return F.when((o.s == o.e) | (at >= o.e), F.lit(ignore)).otherwise(F.coalesce(F.try_element_at(ids, F.get(labels, at)), F.lit(0)))

        return F.transform(offsets, one)

    # Bound first: inside the lambda their expressions would be computed for every sub-token.
    return let(text, lambda t: let(labels_by_char, lambda labels: all_of(t, labels)))


def token_windows(df: DataFrame, columns: list[str], size: int, stride: int) -> DataFrame:
    """One row per window of parallel arrays: ``size`` long, each sharing ``stride`` elements with the one before."""
    if not 0 <= stride < size:
        raise ValueError("stride must be smaller than the window")
    n = F.size(columns[0])
    last = F.greatest(F.lit(0), F.ceil((n - size) / (size - stride)).cast("int"))
    rest = [c for c in df.columns if c not in columns]
    cut = df.withColumn("window", F.explode_outer(F.sequence(F.lit(0), last)))
    return cut.select(*rest, "window", *[F.slice(c, F.col("window") * (size - stride) + 1, size).alias(c) for c in columns])
