import random

from spanveil.llm import packing
from spanveil.llm.packing import BestFit, pack

DOCS, LIMITS = "doc_id bigint, text string, limit_id string", "limit_id int, max_size int"


def test_best_fit_against_a_plain_version():
    rng = random.Random(2)
    for capacity, most in ((50, 4), (9, 1), (512, 64)):
        fit, open_, made = BestFit(capacity, most), {}, 0
        for _ in range(2000):
            n = rng.randrange(1, capacity + 1)
            fits = [(free, k) for k, free in open_.items() if free >= n]
            if fits:
                tight = min(f for f, _ in fits)
                got = fit.put(n)
                assert open_[got] == tight
            else:
                if len(open_) >= most:
                    fullest = min(open_.values())
                    before = [k for k, f in open_.items() if f == fullest]
                got = fit.put(n)
                assert got == made
                made += 1
                if len(open_) >= most:
                    gone = [k for k in before if k not in sum(fit.by_free.values(), [])]
                    assert len(gone) == 1
                    del open_[gone[0]]
                open_[got] = capacity
            open_[got] -= n
            if not open_[got]:
                del open_[got]
            assert sorted(sum(fit.by_free.values(), [])) == sorted(open_) and fit.open == len(open_) <= most


def test_pieces_of_large_items():
    rows = pack([(1, 25), (2, 10), (3, 5), (4, 20)], 10)
    assert [(a, s, e) for a, _, s, e, _ in rows] == [(1, 0, 10), (1, 10, 20), (1, 20, 25), (2, 0, 10), (3, 0, 5), (4, 0, 10), (4, 10, 20)]
    used = {}
    for _, _, s, e, c in rows:
        used[c] = used.get(c, 0) + e - s
    assert max(used.values()) <= 10 and len(used) == 6


def test_fill(spark):
    rng = random.Random(4)
    docs = [(i, " ".join("w" for _ in range(rng.randrange(0, 60))) + rng.choice(["", "!", "…"]), "clash") for i in range(300)]
    docs += [docs[0], (400, None, None), (401, "  \n", None), (402, "a_b-c é9 😀", None)]
    limits = spark.createDataFrame([(1, 40), (2, 64), (2, 64), (3, None)], LIMITS)
    df = spark.createDataFrame(docs, DOCS)
    rows = packing.fill(df, limits, shard_items=120).collect()
    cap = {1: 40, 2: 64}
    used, pieces = {}, {}
    for r in rows:
        used[r.limit_id, r.container] = used.get((r.limit_id, r.container), 0) + r.token_end - r.token_start
        pieces.setdefault((r.limit_id, r.doc_id), []).append((r.token_start, r.token_end))
    assert all(n <= cap[k] for (k, _), n in used.items())
    size = {d: t.count("w") + t.count("!") + t.count("…") for d, t, _ in docs if t and d < 400} | {402: 5}
    for k in cap:
        assert {d for x, d in pieces if x == k} == {d for d, n in size.items() if n}
        for d, n in size.items():
            if n:
                p = sorted(pieces[k, d])
                assert p[0][0] == 0 and p[-1][1] == n and all(a[1] == b[0] for a, b in zip(p, p[1:]))
                assert (len(p) > 1) == (n > cap[k])
    got = {tuple(r) for r in packing.oversized(packing.fill(df, limits)).collect()}
    assert got == {(k, d) for k in cap for d, n in size.items() if n > cap[k]}
    report = {r.limit_id: r for r in packing.fill_report(packing.fill(df, limits), limits).collect()}
    assert all(report[k].tokens == sum(size.values()) and report[k].fill > 0.8 for k in cap)


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert packing.fill(none, spark.createDataFrame([(1, 5)], LIMITS)).collect() == []
    assert packing.fill(spark.createDataFrame([(1, "a", None)], DOCS), spark.createDataFrame([], LIMITS)).collect() == []


def test_public_tokenizer(spark, tmp_path):
    import base64

    ranks = [bytes([i]) for i in range(256)] + [b"ab", b" a"]
    path = tmp_path / "tiny.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(r) + b" " + str(i).encode() for i, r in enumerate(ranks)))
    df = spark.createDataFrame([(1, "ab ab", None), (2, None, None), (3, "", None), (4, "é", None)], DOCS)
    got = {r.doc_id: r.n for r in df.select("doc_id", packing.bpe_token_count("text", str(path)).alias("n")).collect()}
    assert got == {1: 3, 2: None, 3: 0, 4: 2}
    rows = packing.fill(df, spark.createDataFrame([(1, 2)], LIMITS), packing.bpe_token_count("text", str(path))).collect()
    assert sorted((r.doc_id, r.token_start, r.token_end) for r in rows) == [(1, 0, 2), (1, 2, 3), (4, 0, 2)]
