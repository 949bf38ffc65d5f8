"""Problems 2 and 5 against brute force."""

import itertools
import random

import numpy as np
import pytest

from spanveil.llm import crosssplit, golay, neardup, overlap
from spanveil.llm.textkit import WORD
from spanveil.plans.session import Scratch

SCHEMA = "document bigint, split string, source string, full_text string, tokens array<string>, trailing_whitespace array<boolean>, keys string, cls int"


def shingles(text):
    w = WORD.findall(text.lower())
    return set(zip(w, w[1:], w[2:]))


def jaccard(a, b):
    return len(a & b) / len(a | b)


def make(n=60, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, doc = [], 0
    for _ in range(n):
        words = rng.choices(vocabulary, k=rng.randrange(3, 160))
        for kind in rng.sample(["same", "edit", "move", "more", "less", "case"], rng.randrange(0, 4)) + [None]:
            w = list(words)
            if kind == "edit":
                for _ in range(max(1, len(w) // 25)):
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            elif kind == "move":
                k = len(w) // 2
                w = w[k:] + w[:k]
            elif kind == "more":
                w += rng.choices(vocabulary, k=len(w) // 2)
            elif kind == "less":
                w = w[: max(3, int(len(w) * 0.7))]
            text = " ".join(w)
            rows.append((doc, rng.choice(["train", "train", "test", "validation", None]), rng.choice(["real", "synthetic"]), text.upper() + "!" if kind == "case" else text, None, None, "clash", 1))
            doc += 1
    rows += [rows[0], rows[5]]
    rows += [(None, "train", "real", rows[0][3], None, None, None, None), (doc, "train", "real", None, None, None, None, None), (doc + 1, "train", None, " \n ", None, None, None, None)]
    rows += [(doc + 2, "test", "real", None, ["w1", "w2", ",", "w3"], [True, False, True, False], None, None), (doc + 3, "train", "real", "W1 w2, w3", None, None, None, None)]
    rows += [(doc + 4, "train", "real", "two words", None, None, None, None)]
    return rows


def text_of(r):
    if r[3] is not None:
        return r[3]
    return None if r[4] is None else "".join(t + (" " if w else "") for t, w in zip(r[4], r[5]))


def truth(rows, least=0.5):
    sets = {r[0]: shingles(text_of(r)) for r in rows if r[0] is not None and text_of(r)}
    return {(a, b) for a, b in itertools.combinations(sorted(d for d, s in sets.items() if s), 2) if jaccard(sets[a], sets[b]) >= least}


def test_golay_code_keeps_its_promise():
    assert len(set(golay.UPPER.tolist())) <= 2048 and set(golay.NUMBER.tolist()) == {1, 6}
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 23, 3000)
    for errors in range(3):
        u = v.copy()
        for k in range(errors):
            u ^= 1 << rng.integers(0, 23, len(u))
        a, at = golay.keys(v)
        b, bt = golay.keys(u)
        left = set(zip(at.tolist(), a.tolist()))
        assert {i for i, _ in left & set(zip(bt.tolist(), b.tolist()))} == set(range(len(v)))


def test_near_duplicates_equal_brute_force(spark):
    rows = make()
    want = truth(rows)
    got = [tuple(r) for r in neardup.near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and len(want) > 60
    assert set(got) <= want and len(set(got)) >= 0.99 * len(want)


@pytest.mark.parametrize("block", [1, 3])
def test_split_buckets_lose_nothing(spark, block):
    rows = make(25, 8)
    assert {tuple(r) for r in neardup.near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA), block=block).collect()} == truth(rows)


def test_split_buckets_lose_nothing_across_splits(spark, monkeypatch):
    rows = make(30, 8)
    train = {r[0]: r[1] == "train" for r in rows}
    df = spark.createDataFrame(rows, SCHEMA)
    whole = {tuple(r)[:2] for r in crosssplit.cross_split_pairs(df).collect()}
    monkeypatch.setattr(crosssplit.bucket_rows, "__defaults__", (1,))
    monkeypatch.setattr(overlap.expanded, "__defaults__", (1,))
    got = [tuple(r)[:2] for r in crosssplit.cross_split_pairs(df).collect()]
    assert set(got) == whole and len(got) == len(whole) >= 0.99 * len([1 for a, b in truth(rows) if train[a] != train[b]])


def test_shared_boilerplate_is_no_link(spark):
    """5,000 records with one paragraph in common, a little under half of each: no pair, and no join on the paragraph."""
    rng = random.Random(2)
    same = " ".join(f"same{i}" for i in range(60))
    rows = [(i, "train", "real", " ".join(rng.choices([f"w{k}" for k in range(9000)], k=66)) + " " + same, None, None, None, None) for i in range(5000)]
    rows += [(5000, "test", "real", rows[0][3] + " more words", None, None, None, None)]
    scratch = Scratch(spark)
    _, sets = overlap.classes(spark.createDataFrame(rows, SCHEMA), scratch, 3)
    pairs = overlap.prefix_pairs(sets, 0.5)
    assert pairs.count() < 20_000
    assert [tuple(r)[:2] for r in overlap.verified(pairs, sets, 0.5, scratch).collect()].__len__() == 1
    scratch.drop()


def test_intermediate_tables_go(spark):
    import os

    root = spark.conf.get("spark.checkpoint.dir") + "/spanveil"
    rows = make(10, 1)
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    out = neardup.near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA))
    (new,) = set(os.listdir(root)) - before
    assert set(os.listdir(f"{root}/{new}")) <= {"members", "links"} and {tuple(r) for r in out.collect()} == truth(rows)


def test_groups(spark):
    rows = make(30, 4)
    want = truth(rows)
    got = {r.document: r for r in neardup.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    near = {}
    for a, b in want:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for d, r in got.items():
        assert r.links == len(near.get(d, ())), d
        seen, todo = {d}, [d]
        while todo:
            for x in near.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        assert r.group_id == min(seen)


def test_cross_split_pairs_and_report(spark):
    rows = make(60, 9)
    train = {r[0]: r[1] == "train" for r in rows}
    want = {(a, b) for a, b in truth(rows) if train[a] != train[b]}
    df = spark.createDataFrame(rows, SCHEMA)
    got = crosssplit.cross_split_pairs(df).collect()
    pairs = [(r.document_a, r.document_b) for r in got]
    assert len(pairs) == len(set(pairs)) and set(pairs) <= want and len(pairs) >= 0.99 * len(want)
    assert all(train[r.train_document] and not train[r.eval_document] for r in got)
    assert sum(r.pairs for r in crosssplit.cross_split_report(df).collect()) == len(pairs)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    for q in (neardup.near_duplicate_pairs, neardup.near_duplicate_groups, crosssplit.cross_split_pairs, crosssplit.cross_split_report):
        assert q(df).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100])
def test_prefix_never_loses_a_pair(n):
    for other in range(1, 2 * n + 1):
        for shared in range(0, min(n, other) + 1):
            if shared / (n + other - shared) >= 0.5:
                assert shared > 0 and n - int(np.ceil(n * 0.5 - 1e-9)) + 1 > n - shared


def rewritten(kind, n=60, seed=11):
    """Pairs of texts over few long runs: every tenth word replaced, or passages of seven words in another order."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randrange(70, 200))
        if kind == "edits":
            other = [rng.choice(vocabulary) if k % 10 == 9 else w for k, w in enumerate(words)]
        else:
            passages = [words[k : k + 7] for k in range(0, len(words), 7)]
            rng.shuffle(passages)
            other = [w for p in passages for w in p]
        rows += [(2 * i, "train", "real", " ".join(words), None, None, None, None), (2 * i + 1, "test", "real", " ".join(other), None, None, None, None)]
    return rows


@pytest.mark.parametrize("kind", ["edits", "passages"])
def test_rewritten_texts_are_all_found(spark, kind):
    rows = rewritten(kind)
    want = truth(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert len(want) >= 50
    assert {tuple(r) for r in neardup.near_duplicate_pairs(df).collect()} == want
    assert sum(r.links for r in neardup.near_duplicate_groups(df).collect()) == 2 * len(want)


def test_parity_rules_out_no_pair():
    rng = np.random.default_rng(4)
    for n in (3, 40, 300, 5000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, n // 3).astype(np.uint64)])
        apart = sum(bin(int(x)).count("1") for x in (overlap.parity(a) ^ overlap.parity(b)).view(np.uint64))
        assert apart <= len(np.setxor1d(a, b))


def written(root):
    import os

    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(root) for f in files)


@pytest.mark.parametrize("limits", [{}, {"block": 2}, {"counted": 500}])
def test_rounds_and_parts_lose_nothing(spark, limits, monkeypatch):
    """Keys in many rounds and pairs in many parts, by limits far under what the records take: the same pairs as brute force."""
    rows = make(30, 5) + [(1000 + i, "test", "real", r[3], None, None, None, None) for i, r in enumerate(make(30, 5)[:40])]
    monkeypatch.setattr(overlap, "FILTERED", 0)
    scratch, seen = Scratch(spark), []
    stage = scratch.stage
    monkeypatch.setattr(scratch, "stage", lambda df, what: (seen.append(what), stage(df, what))[1])
    members, firsts, sets = overlap.class_rows(spark.createDataFrame(rows, SCHEMA).repartition(7), scratch, 3)
    links = overlap.prefix_links(sets, firsts, 0.5, scratch, first_rows=200, round_bytes=15_000, share=0, **limits)
    of = {}
    for r in members.collect():
        of.setdefault(r.cls, set()).add(r.document)
    got = {(min(x, y), max(x, y)) for r in links.collect() for x in of[r.a] for y in of[r.b]}
    own = {(x, y) for docs in of.values() for x in docs for y in docs if x < y}
    assert got | own == truth(rows) and not got & own and links.count() == links.select("a", "b").distinct().count()
    assert sum(s.startswith("near/") for s in seen) > 3 and sum(s.startswith("links/") for s in seen) > 2
    scratch.drop()


def test_near_duplicates_take_bounded_disk(spark, monkeypatch):
    """Sets are written once and never shuffled whole, and shuffle files go with their query: whenever a table has been written, there is
    less than 1.5 times the sets on disk."""
    rng = random.Random(6)
    rows = [(i, "train", "real", " ".join(f"w{int(rng.paretovariate(0.5)) % 20000}" for _ in range(120)), None, None, None, None) for i in range(4000)]
    sets = 8 * sum(len(shingles(r[3])) for r in rows)
    local = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).cache()
    df.count()
    scratch, most, before = Scratch(spark), [0], sum(map(written, local))
    stage = scratch.stage

    def watched(df, what):
        out = stage(df, what)
        most[0] = max(most[0], written(scratch.root.removeprefix("file://")) + sum(map(written, local)) - before)
        return out

    monkeypatch.setattr(scratch, "stage", watched)
    monkeypatch.setattr(neardup, "Scratch", lambda session: scratch)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        assert neardup.near_duplicate_pairs(df).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        df.unpersist()
    assert 0.5 * sets < most[0] < 1.5 * sets, most[0] / sets
