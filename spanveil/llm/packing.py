"""Problem 6: fill fixed-capacity containers with texts.

Bounded-space online best fit.  A fixed number of containers is open at a time; a bitset keyed by free space finds the
tightest one that still takes the item, and when none does and all are open, the fullest closes.  Shards of bounded
size are filled independently, so the work spreads over the cluster and only ids and sizes are shuffled.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.textkit import TOKEN

OPEN = 256
SHARD_ITEMS = 50_000
#: Capacities filled by one plan; more are filled by several.
CAPACITIES_AT_ONCE = 1000


def token_count(text) -> Column:
    """Tokens of a text as the corpus scripts cut it: runs of word characters, or one other character that isn't space."""
    return F.regexp_count(F.col(text), F.lit(TOKEN))


#: Pre-tokenisation of the public byte-level vocabularies.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def bpe_token_count(text: str, vocabulary: str, pattern: str = BYTE_PATTERN) -> Column:
    """Tokens by a public byte-level vocabulary: ``vocabulary`` is the path of a rank file every executor can read.  A null
    text has null tokens, special tokens in a text are ordinary text."""

    @F.pandas_udf("int")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for part in parts:
            yield part.map(lambda t: None if t is None else len(coder.encode_ordinary(t))).astype("Int32")

    return count(F.col(text))


class BestFit:
    """Open containers of one capacity.  ``put`` returns the container's number."""

    def __init__(self, capacity: int, most_open: int = OPEN):
        self.capacity, self.most_open = capacity, most_open
        self.bits, self.by_free, self.open, self.made = 0, {}, 0, 0

    def _add(self, free: int, number: int) -> None:
        if free:
            self.by_free.setdefault(free, []).append(number)
            self.bits |= 1 << free
            self.open += 1

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        number = stack.pop()
        if not stack:
            del self.by_free[free]
            self.bits ^= 1 << free
        self.open -= 1
        return number

    def put(self, size: int) -> int:
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.most_open:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.made
            self.made += 1
        self._add(free - size, number)
        return number


def pack(items: Iterable[tuple[int, int]], capacity: int, most_open: int = OPEN) -> list[tuple]:
    """``(id, piece_no, start, end, container)`` for items of known size; only items above the capacity are split."""
    fit, out = BestFit(capacity, most_open), []
    for name, size in items:
        whole = size // capacity if size > capacity else 0
        for k in range(whole):
            out.append((name, k + 1, k * capacity, (k + 1) * capacity, fit.put(capacity)))
        if size > whole * capacity or not size:
            out.append((name, whole + 1, whole * capacity, size, fit.put(size - whole * capacity)))
    return out


def fill(documents: DataFrame, limits: DataFrame, size: Column | None = None, most_open: int = OPEN, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``limit_id, doc_id, piece_no, token_start, token_end, container``: every document assigned for every capacity.

    ``limits`` has ``limit_id, max_size``, a table of configuration.  ``container`` is
    "shard-number".  Documents without tokens (null, empty or blank text) need no container and give no row; repeated
    rows of a ``doc_id`` count once, by their largest size.
    """
    rows = limits.select("limit_id", "max_size").distinct().collect()
    capacities = [(r.limit_id, r.max_size) for r in rows if r.max_size]
    parts = [capacities[k : k + CAPACITIES_AT_ONCE] for k in range(0, len(capacities), CAPACITIES_AT_ONCE)] or [[]]
    out = _fill(documents, parts[0], size, most_open, shard_items)
    for part in parts[1:]:
        out = out.unionAll(_fill(documents, part, size, most_open, shard_items))
    return out


def _fill(documents: DataFrame, capacities: list[tuple[int, int]], size: Column | None, most_open: int, shard_items: int) -> DataFrame:
    sizes = documents.select("doc_id", (token_count("text") if size is None else size).alias("tokens"))
    sizes = sizes.filter("tokens > 0").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
    schema = "limit_id int, doc_id bigint, piece_no int, token_start int, token_end int, container string"
    if not capacities:
        return documents.sparkSession.createDataFrame([], schema)
    shards = max(1, -(-documents.count() // shard_items))
    each = sizes.withColumn("limit", F.explode(F.array(*[F.struct(F.lit(i).alias("limit_id"), F.lit(c).alias("capacity")) for i, c in capacities])))
    order = F.xxhash64("doc_id")
    each = each.select("limit.limit_id", "limit.capacity", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(shards)).cast("int").alias("shard"), order.alias("turn"), "doc_id", "tokens")
    each = each.repartition("limit_id", "shard").sortWithinPartitions("limit_id", "shard", "turn", "doc_id")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, fit = None, None
        for part in parts:
            out = []
            for limit, capacity, shard, doc, n in zip(part.limit_id, part.capacity, part.shard, part.doc_id, part.tokens):
                if at != (limit, shard):
                    at, fit = (limit, shard), BestFit(int(capacity), most_open)
                n = int(n)
                whole = n // fit.capacity if n > fit.capacity else 0
                for k in range(whole):
                    out.append((limit, doc, k + 1, k * fit.capacity, (k + 1) * fit.capacity, f"{shard}-{fit.put(fit.capacity)}"))
                if n > whole * fit.capacity:
                    out.append((limit, doc, whole + 1, whole * fit.capacity, n, f"{shard}-{fit.put(n - whole * fit.capacity)}"))
            yield pd.DataFrame(out, columns=["limit_id", "doc_id", "piece_no", "token_start", "token_end", "container"])

    return each.mapInPandas(run, schema)


def oversized(filled: DataFrame) -> DataFrame:
    """``limit_id, doc_id`` of the documents that had to be split."""
    return filled.filter("piece_no = 2").select("limit_id", "doc_id").distinct()


def fill_report(filled: DataFrame, limits: DataFrame) -> DataFrame:
    """Per limit: containers, tokens, pieces, documents, and the share of capacity in use."""
    boxes = filled.groupBy("limit_id", "container").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("used"), F.count("*").alias("pieces"))
    per = boxes.groupBy("limit_id").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.sum("pieces").alias("pieces"))
    caps = limits.select("limit_id", "max_size").distinct()
    return per.join(caps, "limit_id").withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("max_size"))).drop("max_size")
