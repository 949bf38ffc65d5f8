"""Queries over labelled_docs take the joined tokens where ``full_text`` is null."""

from spanveil.plans import catalog

SCHEMA = "document bigint, full_text string, tokens array<string>, trailing_whitespace array<boolean>, labels array<string>"
TOKENS = ["My", "name", "is", "Zed", ",", "mail", "zed@mail.example.com"]
SPACES = [True, True, True, False, True, True, False]


def folder(spark, path):
    rows = [
        (1, "My name is Ann, number 1234567", None, None, None),
        (2, None, TOKENS, SPACES, None),
        (3, None, ["Id", " ", "7654321"], None, None),
        (4, None, None, None, None),
        (2, None, TOKENS, SPACES, None),
    ]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/labelled_docs.parquet")
    return str(path)


def test_null_full_text_is_decoded_from_tokens(spark, tmp_path):
    got = {(r.document, r.label, r.start, r.end, r.text) for r in catalog.decode(spark, folder(spark, tmp_path)).collect()}
    assert got == {
        (1, "NAME_STUDENT", 11, 14, "Ann"), (1, "ID_NUM", 23, 30, "1234567"), (2, "NAME_STUDENT", 11, 14, "Zed"), (3, "ID_NUM", 3, 10, "7654321")
    }


def test_null_full_text_reaches_model_authority(spark, tmp_path):
    got = {(r.label, r.source): r.n for r in catalog.model_authority(spark, folder(spark, tmp_path)).collect()}
    assert got["NAME_STUDENT", "model"] == 2 and got["ID_NUM", "model"] == 2
    assert sum(n for (label, _), n in got.items() if label == "EMAIL") == 1


def test_null_full_text_is_streamed_and_masked(spark, tmp_path):
    r = catalog.stream_masked(spark, folder(spark, tmp_path)).first()
    assert r.texts == 4 and r.acted >= 2


def test_names_and_coppa_run_over_corpus_texts(spark, tmp_path):
    q = catalog.queries()
    text = "My name is Ona Smith. " + "We read a book. " * 200 + "We like Ona and Smith. My brother Bram laughed."
    spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, text, None, None, None)], SCHEMA).write.parquet(f"{tmp_path}/labelled_docs.parquet")
    assert {r.label: r.spans for r in q["names_corpus"](spark, tmp_path).collect()} == {"NAME_STUDENT": 1, "NAME_RELATED": 1}
    assert [(r.document, r.label, r.spans) for r in q["propagate_corpus"](spark, tmp_path).collect()] == [(1, "NAME_STUDENT", 2)]
    assert {r.label: (r.removed, r.in_leaking_texts) for r in q["coppa_corpus"](spark, tmp_path).collect()} == {"NAME_STUDENT": (3, 0), "NAME_RELATED": (1, 0)}
