"""Problem 1: cut oversized records at natural boundaries, with overlap.

Cutting is one bounded-quantifier regular expression whose alternatives are ordered by the strength
of the boundary they end at; each consumes as much as the limit allows, and the last one takes plain
characters.  Overlap is a lookback from the start of each cut.  Records limited in tokens are cut the
same way over a string with one boundary letter per token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.textkit import SPACE, TOKEN, record_text

MOST_LIMITS = 1000

# Zero-width ends of a piece of text, strongest first.
CHAR_BOUNDARIES = (
    r"(?<=\n[ \t]{0,8}\n)",
    r"(?<=\n)",
    rf"(?<=[.!?…][\"'”’)\]]{{0,3}}[{SPACE}])",
    rf"(?<=[;:,][\"'”’)\]]{{0,3}}[{SPACE}])",
    rf"(?<=[{SPACE}])",
)
# One letter per token: p paragraph, l line, s sentence, c clause, w blank after it, x glued to the next.
TOKEN_BOUNDARIES = ("(?<=p)", "(?<=l)", "(?<=s)", "(?<=c)", "(?<=[plscw])")


def cutter(size: int, overlap: int, boundaries: tuple[str, ...]) -> str:
    """The cutting pattern.  Only the first piece has no overlap and may fill the whole limit.

    Every boundary is tried first in the second half of the piece, then anywhere past the overlap,
    so that a piece is never shorter than what the next one repeats.
    """
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("a limit needs max_size >= 1 and 0 <= overlap_size < max_size")

    def ways(most: int) -> str:
        low = min(most, max(1, overlap))
        half = min(most, max(low, most // 2))
        steps = [rf".{{{half},{most}}}{b}" for b in boundaries]
        if low < half:
            steps += [rf".{{{low},{half}}}{b}" for b in boundaries]
        return "|".join([rf".{{1,{most}}}\z", *steps, rf".{{1,{most}}}"])

    first, rest = ways(size), ways(size - overlap)
    return rf"(?s)\A(?:{first})|(?:{rest})"


PIECES = "array<struct<piece_no:int,piece_start:int,piece_end:int>>"


def _spans(cuts: Column, overlap: int) -> Column:
    """Number, start and end of each piece from the cut strings, looking back by the overlap.

    One fold that carries the position: nothing that depends on the text may stand inside its lambda,
    which would evaluate it again for every piece.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast(PIECES).alias("done"))

    def add(acc: Column, cut: Column) -> Column:
        end = acc.at + F.length(cut)
        one = F.struct(
            (F.size(acc.done) + 1).alias("piece_no"),
            (acc.at - F.when(acc.at > 0, overlap).otherwise(0)).alias("piece_start"),
            end.alias("piece_end"),
        )
        return F.struct(end.alias("at"), F.concat(acc.done, F.array(one)).alias("done"))

    return F.aggregate(cuts, start, add, lambda acc: acc.done)


def _token_classes():
    """Tokens with the gap after each, from the text where its tokens are these, else from the flags;
    and the boundary letter of a token, given the one before."""
    gaps = F.split(F.col("full_text"), TOKEN, -1)
    fits = F.size(gaps) == F.size("tokens") + 1
    flags = F.zip_with(
        F.col("tokens"),
        F.coalesce(F.col("trailing_whitespace"), F.array().cast("array<boolean>")),
        lambda t, w: F.struct(t.alias("t"), F.when(w, " ").otherwise("").alias("g")),
    )
    exact = F.zip_with("tokens", F.slice(gaps, 2, F.size("tokens")), lambda t, g: F.struct(t.alias("t"), g.alias("g")))
    pairs = F.when(fits, exact).otherwise(flags)
    closing = r"^[\"'”’)\]]$"

    def letter(x: Column, before: Column) -> Column:
        ends = x.t.isin(".", "!", "?", "…") | (x.t.rlike(closing) & F.coalesce(before.t.isin(".", "!", "?", "…"), F.lit(False)))
        return (
            F.when(x.g.rlike(r"\n[^\n]*\n"), "p")
            .when(x.g.contains("\n"), "l")
            .when(ends & (x.g != ""), "s")
            .when(x.t.isin(",", ";", ":") & (x.g != ""), "c")
            .when(x.g != "", "w")
            .otherwise("x")
        )

    return pairs, letter


def split_records(records: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of every record that exceeds a limit: ``limit_id, document, unit, piece_no, piece_start, piece_end, piece``.

    ``limits`` has ``limit_id, unit (chars, tokens), max_size, overlap_size``; it is configuration and may hold
    at most ``MOST_LIMITS`` rows.  Offsets are half-open, in characters of the record's text or in tokens.  Each piece
    is within its limit, repeats exactly ``overlap_size`` units of the piece before, and together they cover
    the record.  A null overlap counts as 0.  Records within all limits, with null or empty text (chars) or null
    or empty tokens give no piece; repeated rows of a ``document`` give the same pieces once.  A null
    ``document`` is kept as null.
    """
    rows = limits.select("limit_id", "unit", "max_size", "overlap_size").distinct().limit(MOST_LIMITS + 1).collect()
    if len(rows) > MOST_LIMITS:
        raise ValueError(f"more than {MOST_LIMITS} limits")
    schema = "limit_id int, document bigint, unit string, piece_no int, piece_start int, piece_end int, piece string"
    out = []
    base = records.select("document", "full_text", "tokens", "trailing_whitespace")
    by_text = base.select("document", record_text().alias("_text"))
    for r in rows:
        if r.max_size is None or r.unit not in ("chars", "tokens"):
            continue
        overlap = r.overlap_size or 0
        if r.unit == "chars":
            part = by_text.filter(F.length("_text") > r.max_size)
            cuts = F.regexp_extract_all("_text", F.lit(cutter(r.max_size, overlap, CHAR_BOUNDARIES)), F.lit(0))
            part = part.select("document", "_text", F.explode_outer(_spans(cuts, overlap)).alias("s")).filter("s is not null")
            piece = F.substring(F.col("_text"), F.col("s.piece_start") + 1, F.col("s.piece_end") - F.col("s.piece_start"))
        else:
            pairs, letter = _token_classes()
            part = base.filter(F.size("tokens") > r.max_size).withColumn("_pairs", pairs)
            earlier = F.slice(F.concat(F.slice("_pairs", 1, 1), F.col("_pairs")), 1, F.size("_pairs"))
            part = part.select("document", "_pairs", F.array_join(F.zip_with("_pairs", earlier, letter), "").alias("_classes"))
            cuts = F.regexp_extract_all("_classes", F.lit(cutter(r.max_size, overlap, TOKEN_BOUNDARIES)), F.lit(0))
            part = part.select("document", "_pairs", F.explode_outer(_spans(cuts, overlap)).alias("s")).filter("s is not null")
            inside = F.slice("_pairs", F.col("s.piece_start") + 1, F.col("s.piece_end") - F.col("s.piece_start"))
            piece = F.array_join(F.transform(inside, lambda x: F.concat(F.coalesce(x.t, F.lit("")), F.coalesce(x.g, F.lit("")))), "")
        out.append(
            part.select(F.lit(r.limit_id).cast("int").alias("limit_id"), "document", F.lit(r.unit).alias("unit"), "s.*", piece.alias("piece"))
        )
    if not out:
        return records.sparkSession.createDataFrame([], schema)
    every = out[0]
    for part in out[1:]:
        every = every.unionAll(part)
    return every.dropDuplicates(["limit_id", "document", "piece_no", "piece_start", "piece_end"])


def oversized(records: DataFrame, limits: DataFrame) -> DataFrame:
    """``limit_id, document`` of the records that had to be cut."""
    return split_records(records, limits).filter("piece_no = 1").select("limit_id", "document").distinct()


def split_summary(records: DataFrame, limits: DataFrame) -> DataFrame:
    """Per limit: documents cut, pieces, and the share of cuts that end at white space or the end of the record."""
    pieces = split_records(records, limits)
    natural = F.col("piece").rlike(rf"[{SPACE}]\z").cast("int")
    return pieces.groupBy("limit_id", "unit").agg(
        F.countDistinct("document").alias("documents"), F.count("*").alias("pieces"), F.sum(natural).alias("ends_at_space")
    )
