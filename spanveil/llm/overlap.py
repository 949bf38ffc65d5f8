"""Exact set overlap of shingled records: shared ground of problems 2 and 5.

Records with equal shingle sets form a *class*, named by one of its rows.  Candidates and verification work on classes, so
copies cost nothing; pairs are expanded to documents only at the end, in blocks.

Counts of shingles and keys are kept in a *sketch*: a fixed number of cells, each the count of all values that hash to it, over
all records.  It never counts a value too low, its size doesn't depend on the data, and so it may be sent to every task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Accumulator, Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.textkit import mix, record_text, shingles_of_batch
from spanveil.plans.session import Scratch

#: Cells of a sketch, as a power of two: 262,144 counts of 8 bytes, whatever the size of the data.
CELL_BITS = 18
#: The same for the rarity of shingles, which are far more than keys: 2,097,152 counts.
RARITY_BITS = 21
#: Elements that are counted for it, of a sample of the sets if there are more.
COUNTED = 1 << 24
#: Sets that a task orders at a time.
SLICE = 1024
#: Rows that a batch of the prefix join has at most, but for the blocks of one key.
REPEATED = 1 << 18
#: Bits of a parity fingerprint, in words of 64.
PARITY_WORDS = 16
#: Rows of one key, or documents of one class, that meet in one block; larger groups are split into blocks.
BLOCK = 2048
#: 64-bit words of the fingerprint in a row of the prefix join.
MARK_WORDS = 4
#: Keys are joined in rounds, each a range of their lowest 32 bits.  A round may write so many bytes, or this share of what all sets take
#: (8 bytes an element) if that is more; the first one has about so many rows and tells what the next ones will write.
ROUND_BYTES = 200 << 20
ROUND_SHARE = 0.8
FIRST_ROWS = 1 << 22
#: Bytes written for a row of the prefix join, for a pair that comes out of it, and for a pair that meets its fingerprints.
ROW_BYTES, PAIR_BYTES, MARKED_BYTES = 52, 20, 170
SPAN = 1 << 32
#: Words of a filter of rows, 8 MB; a prime, as numbers of rows have the task in their upper bits.
FILTER_WORDS = 1_048_573
#: Sets wanted for verification from which on they are filtered before they are shuffled; fewer are broadcast.
FILTERED = 1 << 15
FEATURES = "document bigint, split string, source string, name binary, n int, shingles array<bigint>, parity array<bigint>"


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))


def parity(distinct: np.ndarray) -> np.ndarray:
    """1,024 bits, each whether an odd number of a set's elements hash to it.  Two fingerprints differ in no more bits than their
    sets do in elements."""
    odd = np.bincount((distinct >> np.uint64(7)).astype(np.int64) & (64 * PARITY_WORDS - 1), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def features(records: DataFrame, size: int, keys_of: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """One row per record with at least ``size`` words and a ``document``: name of its class, its distinct shingles in ascending
    order and their parity fingerprint, with ``keys_of`` the candidate keys too.

    Of the records of one class in a task only the first carries its set.
    """
    seen_limit = 1 << 20

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        seen: set = set()
        none = np.empty(0, np.int64)
        for b in it:
            keep, names, sizes, sets, marks, keys = [], [], [], [], [], []
            for i, by_pos in enumerate(shingles_of_batch(b.column("_text").to_pylist(), size, cache)):
                if not len(by_pos):
                    continue
                s = np.sort(by_pos)
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
                name = xxhash.xxh3_128_digest(s.tobytes())
                fresh = name not in seen
                if fresh:
                    if len(seen) >= seen_limit:
                        seen.clear()
                    seen.add(name)
                keep.append(i)
                names.append(name)
                sizes.append(len(s))
                sets.append(s.view(np.int64) if fresh else none)
                marks.append(parity(s) if fresh else none)
                if keys_of:
                    keys.append(keys_of(s).view(np.int64) if fresh else none)
            rest = b.select(["document", "split", "source"]).take(pa.array(keep, pa.int64()))
            columns = [*rest.columns, pa.array(names, pa.binary()), pa.array(sizes, pa.int32()), _lists(sets), _lists(marks)]
            named = ["document", "split", "source", "name", "n", "shingles", "parity"]
            if keys_of:
                columns.append(_lists(keys))
                named.append("keys")
            yield pa.RecordBatch.from_arrays(columns, named)

    base = records.select("document", "split", "source", record_text().alias("_text"))
    schema = FEATURES + (", keys array<bigint>" if keys_of else "")
    return base.filter("document is not null and _text is not null").mapInArrow(batches, schema)


def class_rows(records: DataFrame, scratch: Scratch, size: int, keys_of=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (``document, split, source, cls``, distinct), the classes' numbers (``cls``), and the rows that carry a set (``cls, n, shingles,
    parity`` and ``keys``): one per class, and further ones where a class occurs in several tasks, under numbers that no class has.

    ``cls`` is the number of the class's first row; only numbers and names are shuffled for it.
    """
    feats = scratch.stage(features(records, size, keys_of).withColumn("row", F.monotonically_increasing_id()), "features")
    firsts = scratch.stage(feats.groupBy("name").agg(F.min("row").alias("cls")), "classes")
    members = feats.select("document", "split", "source", "name").distinct().join(firsts, "name").drop("name")
    columns = ["n", "shingles", "parity", *(["keys"] if keys_of else [])]
    return scratch.stage(members, "members"), firsts.select("cls"), feats.select(F.col("row").alias("cls"), *columns)


def classes(records: DataFrame, scratch: Scratch, size: int, keys_of=None) -> tuple[DataFrame, DataFrame]:
    """Members as in ``class_rows`` and one row per class (``cls, n, shingles, parity`` and ``keys``).

    The sets are shuffled for it wherever the classes' numbers are too many to be broadcast.
    """
    members, firsts, rows = class_rows(records, scratch, size, keys_of)
    return members, rows.join(firsts, "cls", "left_semi")


def row_filter(rows: DataFrame) -> np.ndarray:
    """A filter of fixed size for the numbers ``cls``: a bit each, which numbers may share once there are some ten millions."""
    words = rows.groupBy(F.expr(f"cast(shiftrightunsigned(cls, 6) % {FILTER_WORDS} as int)").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(cls & 63 as int)))").alias("bits")
    )
    words = words.toArrow()
    out = np.zeros(FILTER_WORDS, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def may_hold(held: np.ndarray, cls: np.ndarray) -> np.ndarray:
    return (held[(cls >> 6) % FILTER_WORDS] >> (cls & 63)) & 1 == 1


def held_rows(sets: DataFrame, held: Broadcast) -> DataFrame:
    """The rows that may be in a ``row_filter``, so that only few are shuffled."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield b.filter(pa.array(may_hold(held.value, b.column("cls").to_numpy())))

    return sets.mapInArrow(run, sets.schema)


def cell_of(values: np.ndarray, bits: int = CELL_BITS) -> np.ndarray:
    return (values.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def sketch(values: DataFrame, value: str, *counts: Column, bits: int = CELL_BITS) -> list[np.ndarray]:
    """Counts of the cells over all rows of ``values``, one array per aggregate (``count(*)`` if none is given).

    Aggregated in each task first; what reaches the driver are the cells.
    """
    wanted = counts or (F.count("*"),)
    cell = F.shiftrightunsigned(F.col(value), 64 - bits).cast("int").alias("cell")
    rows = values.groupBy(cell).agg(*[c.cast("bigint").alias(f"c{i}") for i, c in enumerate(wanted)]).toArrow()
    out = []
    for i in range(len(wanted)):
        cells = np.zeros(1 << bits, np.int64)
        cells[rows.column("cell").to_numpy()] = rows.column(f"c{i}").to_numpy()
        out.append(cells)
    return out


def least_shared(n, other, threshold: float):
    """Elements that sets of these sizes share at least, at this Jaccard similarity."""
    return F.ceil((n + other) * (threshold / (1 + threshold)) - 1e-9)


def blocks(key: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Key of block (i, j) of a key; that of the only block is the key itself."""
    split = own > 1
    return np.where(split, mix(key.view(np.uint64) + mix(i.astype(np.uint64) << np.uint64(32) | j.astype(np.uint64)) + np.uint64(1)).view(np.int64), key)


def rarity(sets: DataFrame, counted: int = COUNTED) -> tuple[np.ndarray, int, int]:
    """The sketch of the elements of one in so many sets, that number, and the number of elements in all.  So many that about ``counted``
    elements are counted; all of fewer."""
    elements = sets.agg(F.sum("n").alias("n")).first().n or 0
    rate = max(1, round(elements / counted))
    some = sets if rate == 1 else sets.filter(F.pmod(F.xxhash64("cls"), F.lit(rate)) == 0)
    return np.minimum(sketch(some.select(F.explode("shingles").alias("v")), "v", bits=RARITY_BITS)[0], np.iinfo(np.int32).max).astype(np.int32), rate, elements


def suffix_marks(flat: np.ndarray, starts: np.ndarray, at: np.ndarray, many: np.ndarray) -> list[np.ndarray]:
    """Parity fingerprints, one array per word, of what a set has left from each of its prefix elements on, that element included.

    ``flat`` holds the elements of all sets, ``starts`` where each begins; ``at`` the places of the prefix elements in their order, set by set,
    ``many`` how many each set has.
    """
    bit = (flat.view(np.uint64) >> np.uint64(17)) & np.uint64(64 * MARK_WORDS - 1)
    one = np.uint64(1) << (bit & np.uint64(63))
    begin = np.cumsum(many) - many
    out = []
    for word in range(MARK_WORDS):
        mine = np.where(bit >> np.uint64(6) == np.uint64(word), one, np.uint64(0))
        whole = np.bitwise_xor.reduceat(mine, starts)
        before = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(mine[at])])
        out.append((np.repeat(whole ^ before[begin], many) ^ before[:-1]).view(np.int64))
    return out


def prefix_rows(
    sets: DataFrame, threshold: float, counts: Broadcast, block: int = BLOCK, low: int = 0, high: int = SPAN,
    held: Broadcast | None = None, emitted: Accumulator | None = None,
) -> DataFrame:
    """``key, cls, size, side`` and a fingerprint ``m0, m1, ...``: the rarest elements of each set, as many as guarantee that sets of this
    similarity share one; of these the ones whose lowest 32 bits are from ``low`` to below ``high``.

    ``counts`` holds the sketch and of how many sets it counts one (``rarity``).  Rarity is that of the sketch, ties by hash: one order for
    all sets, which is all the guarantee needs.  ``size`` holds two numbers (``sizes_of``): the set's elements, and those from this one on,
    whose fingerprint it is.  Where all sets are counted, an element whose cell counts one row is in one set only and is left out.  A key whose cell counts over ``block`` rows
    more than cells usually do is split into blocks of rows; every row goes to the blocks it shares with the others, and ``side`` is its own
    block, or -1 where all rows of a key meet.  Sets that are not in the filter ``held`` are
    left out; ``emitted`` counts the rows.
    """
    marks = [f"m{k}" for k in range(MARK_WORDS)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, rate = counts.value
        # What a cell counts without any frequent element: all cells fill up as the data grows.
        usual = int(np.median(cells))
        for b in (whole.slice(k, SLICE) for whole in it for k in range(0, whole.num_rows, SLICE)):
            if held is not None:
                b = b.filter(pa.array(may_hold(held.value, b.column("cls").to_numpy())))
            cls, flat = b.column("cls").to_numpy(), b.column("shingles").flatten().to_numpy()
            ends = b.column("shingles").offsets.to_numpy()
            ends = ends - ends[0]
            often = cells[cell_of(flat, RARITY_BITS)].astype(np.int64)
            # Count above, hash below: equal upper hash bits keep the ascending order of the set in every set.
            order = (np.minimum(often, (1 << 20) - 1).astype(np.uint64) << np.uint64(44)) | (mix(flat.view(np.uint64)) >> np.uint64(20))
            at, left, many = [], [], []
            for s, e in zip(ends[:-1], ends[1:]):
                n = int(e - s)
                m = n - int(np.ceil(n * threshold - 1e-9)) + 1
                at.append(s + np.argsort(order[s:e], kind="stable")[:m])
                left.append(n - np.arange(m))
                many.append(m)
            if not at:
                continue
            at, left, owner = np.concatenate(at), np.concatenate(left), np.repeat(np.arange(len(many)), many)
            words = suffix_marks(flat, ends[:-1], at, np.array(many))
            place = flat[at] & (SPAN - 1)
            keep = (place >= low) & (place < high)
            if rate == 1:
                keep &= often[at] > 1
            at, left, owner, words = at[keep], left[keep], owner[keep], [w[keep] for w in words]
            key, size, cls, n = flat[at], -(-np.maximum(often[at] - usual, 1) * rate // block), cls[owner], np.diff(ends)[owner]
            mine = (mix(cls.astype(np.uint64)) % size.astype(np.uint64)).astype(np.int64)
            # The row once per block of its key, with the pair of blocks in ascending order; a part of the rows at a time, as a row may
            # have many blocks.
            upto = np.cumsum(size)
            for rows in np.split(np.arange(len(key)), np.searchsorted(upto, np.arange(REPEATED, upto[-1] if len(upto) else 0, REPEATED))):
                again = np.repeat(rows, size[rows])
                if not len(again):
                    continue
                other = np.arange(len(again)) - np.repeat(np.cumsum(size[rows]) - size[rows], size[rows])
                own = mine[again]
                side = np.where(own == other, -1, own).astype(np.int32)
                if emitted is not None:
                    emitted.add(len(again))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(blocks(key[again], size[again], np.minimum(own, other), np.maximum(own, other))), pa.array(cls[again]),
                        pa.array(n[again].astype(np.int64) << 32 | left[again]), pa.array(side), *(pa.array(w[again]) for w in words),
                    ],
                    ["key", "cls", "size", "side", *marks],
                )

    return sets.select("cls", "shingles").mapInArrow(run, "key bigint, cls bigint, size bigint, side int" + "".join(f", {m} bigint" for m in marks))


def sizes_of(size: Column) -> tuple[Column, Column]:
    return F.shiftright(size, 32), size.bitwiseAND(F.lit((1 << 32) - 1))


def meetings(keys: DataFrame, threshold: float) -> DataFrame:
    """``a, b`` (a < b, with repetitions): pairs of classes with a common key that may reach this similarity.

    The first element a pair shares lies in the shorter prefix of its smaller set, and from there on both sets must still be long enough and
    their fingerprints, which differ in no more bits than those rests do in elements, near enough; other meetings are left out.
    """
    l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    # Both sides are the same shuffle, so conditions on one side stay in the join.
    (nl, restl), (nr, restr) = sizes_of(l("size")), sizes_of(r("size"))
    shortl, shortr = restl >= least_shared(nl, nl, threshold), restr >= least_shared(nr, nr, threshold)
    smaller = F.when(nl < nr, shortl).when(nr < nl, shortr).otherwise(shortl | shortr)
    apart = sum((F.bit_count(l(f"m{k}").bitwiseXOR(r(f"m{k}"))) for k in range(MARK_WORDS)), F.lit(0))
    least = least_shared(nl, nr, threshold)
    fit = (
        (l("key") == r("key")) & (l("cls") < r("cls")) & ((l("side") != r("side")) | (l("side") == -1))
        & (F.least(restl, restr) >= least) & smaller
        & (F.least(nl, nr) >= F.greatest(nl, nr) * threshold - 1e-9)
        & (apart <= restl + restr - 2 * least)
    )
    return keys.alias("l").hint("merge").join(keys.alias("r"), fit).select(l("cls").alias("a"), r("cls").alias("b"))


def prefix_pairs(sets: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """``a, b`` (a < b, with repetitions): every pair of classes of this similarity, and some below, joined on the rarest elements."""
    counts = sets.sparkSession.sparkContext.broadcast(rarity(sets)[:2])
    return meetings(prefix_rows(sets, threshold, counts, block), threshold)


def prefix_links(
    sets: DataFrame, firsts: DataFrame, threshold: float, scratch: Scratch, block: int = BLOCK,
    first_rows: int = FIRST_ROWS, round_bytes: int = ROUND_BYTES, share: float = ROUND_SHARE, counted: int = COUNTED,
) -> DataFrame:
    """``a, b, jaccard``: all pairs of classes (a < b) of this similarity, from the rows of ``class_rows``.

    The disk it takes beside the sets is bounded by their size, however many rows a key has or pairs meet: the sets themselves are never
    shuffled, keys are joined a range at a time, of each range only the pairs whose parity fingerprints are near enough stay, and these are
    verified a part at a time, over a table of the sets they need; the table of all sets goes before.
    """
    context = sets.sparkSession.sparkContext
    sets = sets.filter(F.size("shingles") > 0)
    held = context.broadcast(row_filter(firsts))
    cells, rate, elements = rarity(sets, counted)
    counts = context.broadcast((cells, rate))
    limit = max(round_bytes, share * 8 * elements)
    marks = scratch.stage(sets.select("cls", "n", "parity").join(firsts, "cls", "left_semi"), "marks")
    low, round, written = 0, 0, 0.0
    step = min(1.0, first_rows / max(1.0, elements * (1 - threshold)))
    while low < SPAN:
        # A small rest isn't worth a round of its own.
        high = SPAN if low / SPAN + step > 0.98 else low + int(max(step, 1e-5) * SPAN)
        emitted = context.accumulator(0)
        keys = prefix_rows(sets, threshold, counts, block, low, high, held, emitted)
        pairs = scratch.stage(meetings(keys, threshold).distinct(), "pairs")
        met = pairs.count()
        scratch.stage(near_pairs(pairs, marks, threshold), f"near/{round}")
        now = max(ROW_BYTES * emitted.value + PAIR_BYTES * met, MARKED_BYTES * met)
        written += now
        # By the last round or by all, whichever had more; by degrees, as the first ones tell little of keys that many rows have.
        step = min(16 * step, limit / max(1.0, now * SPAN / (high - low), written * SPAN / high))
        low, round = high, round + 1
    scratch.drop("pairs")
    near = scratch.stage(scratch.read("near/*", "a bigint, b bigint, na int, nb int").distinct(), "found")
    scratch.drop("near")
    size, many = near.agg(F.sum((2 * F.col("na") + F.col("nb")) * 8), F.count("*")).first()
    wanted = scratch.stage(sets_of(near, sets, scratch, 2 * many > FILTERED), "wanted")
    scratch.drop("features")
    # What joins of a part write: the sets of both sides, and that of a again with each of its pairs.  There is room for what went, too.
    room = limit + (share and 8 * (elements - (wanted.agg(F.sum("n")).first()[0] or 0)))
    parts = max(1, int(-(-(size or 0) // room)))
    for part in range(parts):
        some = near.filter(F.pmod(F.xxhash64("a"), F.lit(parts)) == part).select("a", "b")
        scratch.stage(similar(some, sets_of(some, wanted, scratch, True) if parts > 1 else wanted, threshold), f"links/{part}")
    scratch.drop("marks", "found", "named", "wanted")
    for sent in (held, counts):
        sent.destroy()
    return scratch.read("links/*", "a bigint, b bigint, jaccard double")


def _side(s: DataFrame, name: str, what: str) -> DataFrame:
    return s.select(F.col("cls").alias(name), F.col("n").alias(f"n{name}"), F.col(what).alias(f"s{name}"))


def near_pairs(pairs: DataFrame, marks: DataFrame, threshold: float) -> DataFrame:
    """``a, b, na, nb`` (distinct): the pairs that their parity fingerprints don't rule out, with the sizes of their sets."""
    near = pairs.join(_side(marks, "a", "parity"), "a").join(_side(marks, "b", "parity"), "b")
    apart = sum((F.bit_count(F.get("sa", k).bitwiseXOR(F.get("sb", k))) for k in range(PARITY_WORDS)), F.lit(0))
    total = F.col("na") + F.col("nb")
    return near.filter(apart <= total - 2 * least_shared(F.col("na"), F.col("nb"), threshold)).select("a", "b", "na", "nb").distinct()


def sets_of(near: DataFrame, sets: DataFrame, scratch: Scratch, many: bool = False) -> DataFrame:
    """The sets that pairs ``a, b`` need, and of ``many``, where a filter takes them out of a table without a shuffle, perhaps a few others.

    Spark broadcasts a side of a join only where its size, known from the table's files, is under its limit.
    """
    named = scratch.stage(near.select(F.col("a").alias("cls")).unionAll(near.select(F.col("b").alias("cls"))).distinct(), "named")
    if many:
        return held_rows(sets.select("cls", "n", "shingles"), sets.sparkSession.sparkContext.broadcast(row_filter(named)))
    return sets.join(named, "cls", "left_semi").select("cls", "n", "shingles")


def similar(near: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``a, b, jaccard`` of the pairs whose exact similarity reaches the threshold."""
    both = F.size(F.array_intersect("sa", "sb"))
    joined = near.join(_side(sets, "a", "shingles"), "a").join(_side(sets, "b", "shingles"), "b").select("a", "b", "na", "nb", both.alias("i"))
    joined = joined.select("a", "b", (F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))).alias("jaccard"))
    return joined.filter(F.col("jaccard") >= threshold)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """``a, b, jaccard`` of the pairs whose exact similarity reaches the threshold.

    First by parity fingerprints, which never rule out a pair of the threshold; then the sets of what is left are fetched and intersected.
    """
    marks = scratch.stage(sets.select("cls", "n", "parity"), "marks")
    near = scratch.stage(near_pairs(pairs, marks, threshold).select("a", "b"), "near")
    return scratch.stage(similar(near, sets_of(near, sets, scratch), threshold), "links")


def expanded(links: DataFrame, left: DataFrame, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links of classes (``a, b``) as rows of their members: ``left`` has ``a, da`` and more, ``right`` ``b, db`` and more.

    Classes of more than ``block`` members are split, and a link becomes one row per pair of blocks, so no task gets a whole group of
    copies.
    """

    def split(side: DataFrame, cls: str, doc: str, at: str) -> tuple[DataFrame, DataFrame]:
        sizes = side.groupBy(cls).agg(F.ceil(F.count("*") / block).cast("int").alias(f"_n{at}"))
        return sizes, side.join(sizes, cls).withColumn(at, F.pmod(F.xxhash64(doc), F.col(f"_n{at}")).cast("int")).drop(f"_n{at}")

    ns, l = split(left, "a", "da", "_i")
    ms, r = split(right, "b", "db", "_j")
    rows = links.select("a", "b").join(ns, "a").join(ms, "b")
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n_i") - 1))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n_j") - 1)))
    return rows.drop("_n_i", "_n_j").join(l, ["a", "_i"]).join(r, ["b", "_j"]).drop("_i", "_j")
