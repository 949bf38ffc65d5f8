import itertools
import random

from pyspark.sql import functions as F

from spanveil.llm import sampling

SCHEMA = "document bigint, split string, source string, genre string, labels array<string>, category string, n int"
TARGETS = "plan_id string, category string, target_share double, min_count int, sample_size int"


def category(labels):
    if labels is None:
        return None
    counts, last = {}, ""
    for x in labels:
        x = (x or "O").strip().upper()
        t, l = (x[0], x[2:].strip()) if x[:1] in "BI" and len(x) > 2 else ("O", "")
        if l and (t == "B" or l != last):
            counts[l] = counts.get(l, 0) + 1
        last = l
    return min(counts, key=lambda k: (-counts[k], k)) if counts else "NO_PII"


def test_category(spark):
    cases = [["O", "o"], [], None, ["B-EMAIL", " i_email ", "I-EMAIL"], ["I-ID_NUM", "O", "I-ID_NUM", "b-email"], ["B-X", "B-A"], [None, "B-A", "I-B", "I-B"], ["b name_student"]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "id int, l array<string>")
    got = {r.id: r.c for r in df.select("id", sampling.main_category(F.col("l")).alias("c")).collect()}
    assert [got[i] for i in range(len(cases))] == [category(c) for c in cases]


def test_quotas_are_optimal_and_within_stock():
    rng = random.Random(1)
    for turn in range(60):
        stock = {(c, s): rng.randrange(0, 6) for c, s in itertools.product("abc", "xy")}
        needs = {c: (rng.randrange(0, 5), rng.randrange(0, 9)) for c in "abc"}
        draw, short = sampling.quotas(stock, needs, turn)
        for c in "abc":
            have = sum(n for (k, _), n in stock.items() if k == c)
            want = max(needs[c])
            assert short[c] == max(0, want - have)
            assert sum(n for (k, _), n in draw.items() if k == c) == min(want, have)
        assert all(0 <= n <= stock[k] for k, n in draw.items())


def test_strata_keep_their_share():
    stock = {("a", "x"): 300, ("a", "y"): 100}
    draw, _ = sampling.quotas(stock, {"a": (0, 40)})
    assert draw == {("a", "x"): 30, ("a", "y"): 10}


def records(n=400):
    rng = random.Random(6)
    pick = [["O"], ["B-EMAIL"], ["B-ID_NUM", "B-ID_NUM", "I-EMAIL"], None]
    rows = [(i, rng.choice(["train", "train", "test"]), rng.choice(["real", "synthetic"]), rng.choice(["essay", None]), rng.choice(pick), "clash", 1) for i in range(n)]
    return rows + rows[:20] + [(None, "train", "real", None, ["O"], None, None)]


def test_sample_and_report(spark):
    rows = records()
    df = spark.createDataFrame(rows, SCHEMA)
    plans = [("p", "NO_PII", 0.5, 3, 60), ("p", "EMAIL", 0.4, 3, 60), ("p", "ID_NUM", 0.05, 7, 60), ("p", "SSN", 0.05, 2, 60), ("q", "EMAIL", 1.0, 0, 5000), ("q", None, 1.0, 0, 5), (None, "EMAIL", 1.0, 0, 5), ("z", "EMAIL", None, None, None)]
    t = spark.createDataFrame(plans, TARGETS)
    have = {}
    for d, c in {(r[0], category(r[4])) for r in rows if r[0] is not None and r[1] == "train" and r[4] is not None}:
        have.setdefault(c, set()).add(d)
    report = {(r.plan_id, r.category): r for r in sampling.target_report(df, t).collect()}
    assert len(report) == 6
    for (p, c), r in report.items():
        assert r.available == len(have.get(c, ())) and r.drawn == min(r.needed, r.available) and r.shortfall == r.needed - r.drawn
    assert {tuple(r) for r in sampling.unreachable(df, t).collect()} == {("p", "SSN"), ("q", "EMAIL")}
    sample = sampling.draw_sample(df, t).collect()
    assert len({(r.plan_id, r.document) for r in sample}) == len(sample)
    for (p, c), r in report.items():
        mine = [x.document for x in sample if (x.plan_id, x.category) == (p, c)]
        assert len(mine) == r.drawn and set(mine) <= have.get(c, set())
    assert sorted(map(str, sample)) == sorted(map(str, sampling.draw_sample(df, t).collect()))
    assert sorted(map(str, sample)) != sorted(map(str, sampling.draw_sample(df, t, seed=7).collect()))


def test_empty(spark):
    none, t = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("p", "EMAIL", 0.5, 2, 10)], TARGETS)
    assert [tuple(r) for r in sampling.unreachable(none, t).collect()] == [("p", "EMAIL")] and sampling.draw_sample(none, t).collect() == []
    assert sampling.target_report(spark.createDataFrame(records(30), SCHEMA), spark.createDataFrame([], TARGETS)).collect() == []
