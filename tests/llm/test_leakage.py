import random

from spanveil.llm import leakage
from spanveil.llm.textkit import WORD

DOCS, ITEMS = "doc_id bigint, text string, item_id string", "item_id bigint, text string, doc_id int"


def truth(docs, items):
    out = set()
    for d, t, *_ in docs:
        w = WORD.findall((t or "").lower())
        have = {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
        for k, p, *_ in items:
            v = WORD.findall((p or "").lower())
            if d is not None and k is not None and any(tuple(v[i : i + 10]) in have for i in range(len(v) - 9)):
                out.add((d, k))
    return out


def data(seed):
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(15)], [f"r{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(rare if rng.random() < 0.3 else common) for _ in range(rng.randrange(5, 40))) + "?", 0) for k in range(20)]
    items += [(20, items[3][1].upper(), 0), (21, None, 0), (22, "", 0), (23, "c1 " * 12, 0), (None, items[0][1], 0)]
    docs = []
    for d in range(60):
        words = rng.choices(common, k=rng.randrange(0, 80))
        if rng.random() < 0.6:
            v = WORD.findall(rng.choice(items[:20])[1])
            a = rng.randrange(0, max(1, len(v) - 8))
            part = v[a : a + rng.choice([9, 10, 11, 40])]
            at = rng.randrange(0, len(words) + 1)
            words[at:at] = part
        docs.append((d, "… " + rng.choice([" ", ", ", "_"]).join(words), "x"))
    docs += [docs[0], (100, None, "x"), (101, " ", "x"), (None, docs[1][1], "x"), (102, "c1 " * 30, "x")]
    return docs, items


def test_equals_brute_force(spark):
    for seed in (1, 2):
        docs, items = data(seed)
        want = truth(docs, items)
        d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
        for limit in ("10m", "-1"):
            # Broadcast by size, and never.
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            got = [tuple(r) for r in leakage.leaked_documents(d, i).collect()]
            assert len(got) == len(set(got)) and set(got) == want and len(want) > 10
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
        exposed = {r.item_id: r.documents for r in leakage.exposed_items(d, i).collect()}
        assert exposed == {k: len({x for x, y in want if y == k}) for k in {k for _, k in want}}


def test_empty(spark):
    docs, items = data(1)
    none_d, none_i = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert leakage.leaked_documents(none_d, spark.createDataFrame(items, ITEMS)).collect() == []
    assert leakage.leaked_documents(spark.createDataFrame(docs, DOCS), none_i).collect() == []
