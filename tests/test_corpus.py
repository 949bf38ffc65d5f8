import re

import pytest
from pyspark.sql import functions as F

from spanveil.operators import corpus, generators, metrics, scorer
from spanveil.sources import readers, writers

CLASSES = ["O", "B-NAME_STUDENT", "I-NAME_STUDENT", "B-EMAIL"]
DOC = "document bigint, tokens array<string>, trailing_whitespace array<boolean>, labels array<string>"


def test_rebuild(spark):
    rows = [
        (1, ["Ask", "Ona", "Vale", "."], [True, True, False, False], ["O", "B-NAME_STUDENT", "I-NAME_STUDENT", "O"]),
        (2, ["a", "b", "c"], [True, True, True], [" i-email ", "I_EMAIL", "B-EMAIL"]),
        (3, None, None, None),
        (4, ["a"], [True], None),
        (5, ["x", "y"], [False, False], ["I-EMAIL", "I-USERNAME"]),
    ]
    got = {r.document: r for r in corpus.rebuild(spark.createDataFrame(rows, DOC)).collect()}
    spans = {d: [tuple(s) for s in (r.gold or [])] for d, r in got.items()}
    assert got[1].text == "Ask Ona Vale." and spans[1] == [("NAME_STUDENT", 4, 12)]
    assert spans[2] == [("EMAIL", 0, 3), ("EMAIL", 4, 5)] and spans[3] == [] and spans[4] == []
    assert spans[5] == [("EMAIL", 0, 1), ("USERNAME", 1, 2)]


def test_split_and_renumber(spark):
    docs = spark.createDataFrame([(i, ["a"], [False], ["B-EMAIL" if i % 4 == 0 else "O"]) for i in range(200)], DOC)
    extra = spark.createDataFrame([(i, ["z"], [False], ["O"]) for i in range(5)], DOC)
    a = corpus.split(docs, extra).collect()
    assert sorted(map(str, a)) == sorted(map(str, corpus.split(docs, extra).collect()))
    val = [r for r in a if r.part == "validation"]
    train = [r for r in a if r.part == "train" and r.tokens == ["a"]]
    assert len(val) == 20 and sorted(r.document for r in a if r.tokens == ["z"]) == [200, 201, 202, 203, 204]
    pos = sum(1 for r in val if r.document % 4 == 0)
    neg_left = 150 - (20 - pos)
    assert len(train) == 50 - pos + int(neg_left * 0.3) and not {r.document for r in val} & {r.document for r in train}


def test_round_trip_of_generated_documents(spark):
    for style in ("cued", "hard"):
        docs = generators.documents(spark, 40, style)
        rows = corpus.rebuild(docs).collect()
        assert len(rows) == 40 and any(r.gold for r in rows)
        for r in rows:
            assert len(r.tokens) == len(r.labels) == len(r.trailing_whitespace)
            assert r.text.split() == r.full_text.split()


def test_scores(spark):
    cols = "document bigint, label string, start int, end int"
    gold = spark.createDataFrame([(1, "EMAIL", 0, 5), (1, "EMAIL", 6, 9), (2, "EMAIL", 0, 4), (2, "SSN", 0, 9)], cols)
    pred = spark.createDataFrame([(1, "EMAIL", 0, 2), (1, "EMAIL", 3, 5), (1, "USERNAME", 6, 7), (3, "EMAIL", 0, 1)], cols)
    got = {r.label: r for r in metrics.prf(metrics.judged(gold, pred)).collect()}
    assert (got[None].tp, got[None].fp, got[None].fn, got[None].exposed) == (1, 2, 2, 1)
    assert (got["EMAIL"].precision, got["EMAIL"].recall) == (0.5, 0.3333)
    empty = spark.createDataFrame([], cols)
    assert metrics.prf(metrics.judged(empty, empty)).collect() == []


def test_windows_tile(spark):
    texts = [("word " * 100 + "\n") * 30, "x" * 5000, "", "short", "a\u3000b " * 900 + "\n" + "é" * 900]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", scorer.windows(F.col("t"), 700, 100).alias("w"))
    for t, w in df.collect():
        if t is None:
            assert w is None
            continue
        assert w[0].keep_from == 0 and w[-1].keep_to == len(t) and all(a.keep_to == b.keep_from for a, b in zip(w, w[1:]))
        assert all(b.start < a.end and a.start < b.start for a, b in zip(w, w[1:])) and all(x.end - x.start <= 700 for x in w)
        # Only a text without any place to cut is cut inside a word.
        assert "x" * 700 in t or "é" * 300 in t or all(t[x.end - 1].isspace() for x in w[:-1])
    first = df.collect()[0].w[0]
    assert texts[0][first.end - 1] == "\n"


def test_decode_and_model(spark):
    text = "By Ona Vale, C. <a@b.example>, 7"
    hot = lambda k, p=0.9: [p if i == k else (1 - p) / 3 for i in range(4)]
    toks = [(0, 0, hot(0)), (0, 2, hot(0)), (2, 6, hot(1)), (7, 11, hot(2)), (13, 14, hot(1)), (18, 19, hot(3)), (22, 25, hot(3, 0.8))]
    weak = [(3, 6, [0.6, 0.4, 0.0, 0.0])]
    rows = [(1, text, toks), (2, text, weak), (3, None, toks), (4, text, None), (5, "", [])]
    df = spark.createDataFrame(rows, f"id int, text string, tokens {scorer.TOKENS_DDL}")
    t, x = F.col("text"), F.col("tokens")
    df = df.select("id", scorer.decode(t, scorer.chosen(x), CLASSES).alias("a"), scorer.decode(t, scorer.chosen(x, 0, 0.7), CLASSES, None).alias("b"))
    got = {r.id: r for r in df.collect()}
    # The address grows from each of its pieces, and the pieces join at the lower confidence.
    assert [(s["label"], s["text"], round(s["confidence"], 3)) for s in got[1].a] == [("NAME_STUDENT", "Ona Vale", 0.9), ("EMAIL", "a@b.example", 0.8)]
    assert got[2].a == [] and [(s["text"], round(s["confidence"], 3)) for s in got[2].b] == [("Ona", 0.4)]
    assert got[3].a is None and got[4].a is None and got[5].a == []

    def load():
        import numpy as np

        def one(chunk):
            at = chunk.find("Zed")
            return (np.array([(at, at + 3)]), np.array([hot(1)])) if at >= 0 else (np.empty((0, 2), int), np.empty((0, 4)))

        return lambda chunks: [one(c) for c in chunks]

    df = spark.createDataFrame([(1, "a " * 1200 + "Zed " + "b " * 1200), (2, None), (3, "")], "id int, text string")
    out = {r.id: r.model_spans for r in scorer.detect_model(df, load, CLASSES).collect()}
    assert [(s["start"], s["text"]) for s in out[1]] == [(2400, "Zed")] and out[2] is None and out[3] == []


def test_predictors():
    import numpy as np

    sizes = []

    def words(chunks):
        sizes.append(len(chunks))
        found = [[m.span() for m in re.finditer(r"\S+", c)] for c in chunks]
        return [(np.array(f).reshape(-1, 2), np.ones((len(f), 1))) for f in found]

    dense = "ab " * 300
    (offsets, p), short = scorer.predict_dense([dense, "x y"], words, most_tokens=100)
    assert [dense[a:b] for a, b in offsets] == ["ab"] * 300 and len(p) == 300 and len(short[0]) == 2 and sizes[0] == 2 and sizes[1] == 2
    for k in range(6):
        scorer.loaded(f"m{k}", lambda: words)
    assert list(scorer._LOADED) == ["m2", "m3", "m4", "m5"]
    calls = []

    def broken():
        calls.append(1)
        raise OSError("no file")

    for _ in range(2):
        with pytest.raises(scorer.ModelUnavailable):
            scorer.loaded("none", broken)
    assert len(calls) == 1
    assert scorer.model_gate("rules", broken) == "rules" and scorer.model_gate(None, None) == "rules" and scorer.model_gate("m", lambda: words) == "model"
    with pytest.warns(RuntimeWarning):
        assert scorer.model_gate(None, broken) == "rules"
    with pytest.raises(scorer.ModelUnavailable):
        scorer.model_gate("m", broken)

    class Session:
        def get_inputs(self):
            return [type("X", (), {"name": n}) for n in ("input_ids", "attention_mask")]

        def run(self, _, inputs):
            ids = inputs["input_ids"]
            return [np.stack([ids * 1.0, ids * 0.0], axis=-1)]

    class Tokenizer:
        def encode_batch(self, chunks):
            return [type("E", (), {"ids": [1] * len(c), "attention_mask": [1] * len(c), "offsets": [(i, i + 1) for i in range(len(c))]}) for c in chunks]

    (o, p), (o2, _) = scorer.session_predictor(Session(), Tokenizer())(["abc", "d"])
    assert len(o) == 3 and len(o2) == 1 and np.allclose(p.sum(axis=1), 1) and p[0, 0] > 0.7


def test_files(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('# note\n\n{"name": "a", "hf_id": "x/a"}\n{"name": "b", "hf_id": "x/b", "local_path": "/nowhere"}\n')
    m = readers.manifest(spark, str(tmp_path / "m.jsonl"))
    assert readers.resolve_model(spark, m, "b", "a") == "x/b" and readers.resolve_model(spark, m, None, "a") == "x/a" and readers.resolve_model(spark, m, "other/c", "a") == "other/c"
    docs = generators.documents(spark, 12, "cued")
    writers.corpus(docs, str(tmp_path / "c"))
    assert readers.corpus(spark, str(tmp_path / "c"), limit=5, lines=True).count() == 5
    (tmp_path / "array.json").write_text('[{"document": 4, "tokens": ["a"], "labels": ["O"]}, {"document": 3, "tokens": []}]')
    assert [r.document for r in readers.corpus(spark, str(tmp_path / "array.json"), limit=2).collect()] == [3, 4]
    parts = corpus.split(docs)
    writers.prepared(parts, str(tmp_path / "p"))
    assert readers.prepared(spark, str(tmp_path / "p/documents")).count() == parts.count()
    asked = spark.createDataFrame([("t", None, None, None), ("t" * 200_001, None, None, None), ("t", "zzz", None, None), ("t", "a", ["EMAIL", "HAT"], None), ("t", "rules", None, "ferpa")], "text string, model_name string, labels array<string>, policy string")
    pol = spark.createDataFrame([("ferpa",)], "name string")
    assert [r.status for r in readers.check_requests(asked, m, pol).collect()] == [200, 422, 400, 400, 200]


def test_softmax_and_agreement(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0], [1.0, 3.0, 2.5])], "a array<double>, b array<double>")
    r = df.select(scorer.softmax(F.col("a")).alias("s"), scorer.argmax(F.col("a")).alias("k"), scorer.best_class(F.col("a"), 1, 5.0).alias("b")).collect()[0]
    assert abs(sum(r.s) - 1) < 1e-9 and r.k == 1 and r.b.cls == 2
    g = metrics.agreement(df, "a", "b").collect()[0]
    assert g.same_argmax == 1.0 and g.max_difference == 1.0
