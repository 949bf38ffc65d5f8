"""Problem 3: a sample whose categories have target proportions.

Records are counted in cells (category by stratum, the strata cutting across the categories).  A min-cost flow over
these counts decides how many to draw from each cell: arcs from the source carry what each category needs, split into its
floor and the rest; arcs into cells carry what is available; arcs from the strata to the sink carry each stratum's
proportional share first and more at a price; slack arcs past all cells are the dearest and expose shortfalls.  The
quotas are integers; the records of a cell are drawn by a seeded hash order.
"""

from __future__ import annotations

import heapq
import random
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells and targets the driver solves for; more strata than this are refused.
MOST_CELLS = 100_000
NO_PII = "NO_PII"
#: Buckets of the hash order of a cell; only the bucket in which a quota ends is sorted.
BUCKETS = 4096


def main_category(labels: Column) -> Column:
    """The label with most spans in an array of BIO strings (ties: first in alphabet), ``NO_PII`` without any; null for null.

    Case, blanks and the character after B/I don't matter.  A span starts at B, or at I when the element before is O or
    has another label; a null element counts as O.
    """
    clean = F.transform(labels, lambda x: F.upper(F.trim(F.coalesce(x, F.lit("O")))))
    parts = F.transform(
        clean,
        lambda x: F.struct(
            F.when(x.rlike(r"^[BI][^A-Z0-9]\s*\S"), F.substring(x, 1, 1)).otherwise("O").alias("t"),
            F.regexp_extract(x, r"^[BI][^A-Z0-9]\s*(\S.*)$", 1).alias("l"),
        ),
    )
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        opens = (x.t == "B") | ((x.t == "I") & (x.l != acc.last))
        return F.struct(x.l.alias("last"), F.when(opens, F.array_append(acc.found, x.l)).otherwise(acc.found).alias("found"))

    def pick(acc: Column) -> Column:
        found = acc.found
        counts = F.transform(
            F.array_distinct(found), lambda v: F.struct((-F.size(F.filter(found, lambda y: y == v))).alias("n"), v.alias("v"))
        )
        return F.when(F.size(found) == 0, NO_PII).otherwise(F.array_min(counts).v)

    return F.aggregate(parts, start, step, pick)


class Flow:
    """Min-cost flow by successive shortest paths with potentials, on integer capacities and costs >= 0."""

    def __init__(self, nodes: int):
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def arc(self, a: int, b: int, cap: int, cost: int) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def solve(self, s: int, t: int) -> int:
        n = len(self.out)
        rank = [0] * n
        total = 0
        while True:
            far, via = [None] * n, [-1] * n
            far[s] = 0
            heap = [(0, s)]
            while heap:
                d, x = heapq.heappop(heap)
                if d > far[x]:
                    continue
                for e in self.out[x]:
                    if self.cap[e]:
                        y, nd = self.to[e], d + self.cost[e] + rank[x] - rank[self.to[e]]
                        if far[y] is None or nd < far[y]:
                            far[y], via[y] = nd, e
                            heapq.heappush(heap, (nd, y))
            if far[t] is None:
                return total
            for x in range(n):
                if far[x] is not None:
                    rank[x] += far[x]
            push, x = None, t
            while x != s:
                e = via[x]
                push = self.cap[e] if push is None else min(push, self.cap[e])
                x = self.to[e ^ 1]
            x = t
            while x != s:
                e = via[x]
                self.cap[e] -= push
                self.cap[e ^ 1] += push
                x = self.to[e ^ 1]
            total += push


PRICE_OVER, PRICE_SHORT, PRICE_FLOOR = 1, 1000, 1_000_000


def quotas(available: dict[tuple[str, str], int], needs: dict[str, tuple[int, int]], seed: int = 42) -> tuple[dict[tuple[str, str], int], dict[str, int]]:
    """Draws per (category, stratum) and shortfall per category.

    ``needs`` gives (floor, share) per category: the larger is drawn, the floor first.  Strata keep to their
    share of all available records where the categories allow it; the rounding of shares and the choice among flows of
    equal cost are random under ``seed``.
    """
    dice = random.Random(seed)
    cats, strata = sorted(needs), sorted({s for _, s in available})
    want = {c: max(needs[c]) for c in cats}
    total, asked = sum(available.values()), sum(want.values())
    by = {s: sum(n for (_, t), n in available.items() if t == s) for s in strata}
    # Shares of the strata, rounded at random without bias: one uniform shift of their running sum.
    dice.shuffle(strata)
    shift, run, share = dice.random(), 0, {}
    for s in strata:
        low, run = run, run + by[s] * asked
        share[s] = int(run / total + shift) - int(low / total + shift) if total else 0
    node = {("c", c): 2 + i for i, c in enumerate(cats)} | {("s", s): 2 + len(cats) + i for i, s in enumerate(strata)}
    flow, cell, slack = Flow(2 + len(node)), {}, {}
    for c in cats:
        floor = min(needs[c][0], want[c])
        flow.arc(0, node["c", c], floor, 0)
        flow.arc(0, node["c", c], want[c] - floor, 0)
        slack[c] = [flow.arc(node["c", c], 1, want[c] - floor, PRICE_SHORT), flow.arc(node["c", c], 1, floor, PRICE_FLOOR)]
        for s in dice.sample(strata, len(strata)):
            if n := available.get((c, s), 0):
                cell[c, s] = flow.arc(node["c", c], node["s", s], n, 0)
    for s in strata:
        flow.arc(node["s", s], 1, share[s], 0)
        flow.arc(node["s", s], 1, max(0, by[s] - share[s]), PRICE_OVER)
    flow.solve(0, 1)
    used = lambda e: flow.cap[e ^ 1]
    return {k: used(e) for k, e in cell.items()}, {c: sum(map(used, es)) for c, es in slack.items()}


def pool(records: DataFrame, stratum: Iterable[str] = ("source", "genre")) -> DataFrame:
    """``document, category, stratum`` of the train records with labels, once each.

    A document that comes with different labels counts in the first of its categories by alphabet.
    """
    cell = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in stratum])
    rows = records.filter("split = 'train' and labels is not null and document is not null")
    rows = rows.select("document", F.struct(main_category(F.col("labels")).alias("category"), cell.alias("stratum")).alias("x"))
    return rows.groupBy("document").agg(F.min("x").alias("x")).select("document", "x.category", "x.stratum")


def _needed(r) -> int:
    return int((r.target_share or 0.0) * (r.sample_size or 0) + 0.5 + 1e-9)


def _solved(base: DataFrame, targets: DataFrame, seed: int = 42):
    cells = base.groupBy("category", "stratum").agg(F.count("*").alias("n")).limit(MOST_CELLS + 1).collect()
    rows = targets.filter("plan_id is not null and category is not null").distinct().limit(MOST_CELLS + 1).collect()
    if len(cells) > MOST_CELLS or len(rows) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells or targets")
    available = {(r.category, r.stratum): r.n for r in cells}
    plans: dict[str, dict[str, tuple[int, int]]] = {}
    for r in rows:
        plans.setdefault(r.plan_id, {})[r.category] = (r.min_count or 0, _needed(r))
    for plan, needs in sorted(plans.items()):
        mine = {k: n for k, n in available.items() if k[0] in needs}
        yield plan, needs, mine, *quotas(mine, needs, seed)


REPORT = "plan_id string, category string, needed bigint, available bigint, drawn bigint, shortfall bigint"


def target_report(records: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per plan and category: what it needs (the larger of floor and rounded share), what is available and drawn, and the
    shortfall on the slack arcs.  Null shares, floors and sizes count as 0; targets without plan or category are left out."""
    out = []
    for plan, needs, mine, draw, short in _solved(pool(records), targets):
        for c in needs:
            out.append((plan, c, max(needs[c]), sum(n for (k, _), n in mine.items() if k == c), sum(n for (k, _), n in draw.items() if k == c), short[c]))
    return records.sparkSession.createDataFrame(out, REPORT)


def unreachable(records: DataFrame, targets: DataFrame) -> DataFrame:
    """``plan_id, category`` of the targets that fall short."""
    return target_report(records, targets).filter("shortfall > 0").select("plan_id", "category")


def draw_sample(records: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """``plan_id, document, category, stratum``: the sample of every plan.

    Within a cell records come in the order of a seeded hash.  Hash buckets before the one in which the quota ends are
    taken whole, and only that bucket is sorted, so no cell is gathered in one task however large it is.
    """
    spark = records.sparkSession
    base = pool(records)
    schema = "plan_id string, category string, stratum string, quota bigint"
    plan = [(p, c, s, n) for p, _, _, draw, _ in _solved(base, targets, seed) for (c, s), n in draw.items() if n]
    wanted = F.broadcast(spark.createDataFrame(plan, schema))
    turn = F.xxhash64(F.lit(seed), "plan_id", "document")
    rows = base.join(wanted, ["category", "stratum"]).withColumn("turn", turn).withColumn("bucket", F.pmod("turn", F.lit(BUCKETS)))
    sizes = rows.groupBy("plan_id", "category", "stratum", "bucket", "quota").agg(F.count("*").alias("n"))
    w = Window.partitionBy("plan_id", "category", "stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    left = sizes.withColumn("rest", F.col("quota") - F.coalesce(F.sum("n").over(w), F.lit(0))).filter("rest > 0").drop("quota", "n")
    rows = rows.join(left, ["plan_id", "category", "stratum", "bucket"])
    inner = Window.partitionBy("plan_id", "category", "stratum", "bucket").orderBy("turn", "document")
    rows = rows.withColumn("at", F.row_number().over(inner)).filter(F.col("at") <= F.col("rest"))
    return rows.select("plan_id", "document", "category", "stratum")
