import json

import pytest
from pyspark.sql import functions as F

from spanveil import __main__ as cli
from spanveil import api
from spanveil.operators import generators
from spanveil.plans.analyze import Model, deidentify
from spanveil.sources import readers

CLASSES = ["O", "B-NAME_STUDENT"]


def loaders():
    """Made here, so that workers get their code and needn't import this file."""

    def load():
        import numpy as np

        def one(chunk):
            at = chunk.find("Zed")
            return (np.array([(at, at + 3)]), np.array([[0.2, 0.8]])) if at >= 0 else (np.empty((0, 2), int), np.empty((0, 2)))

        return lambda chunks: [one(c) for c in chunks]

    def broken():
        raise OSError("no file")

    return load, broken


def test_single_text(spark):
    found = api.extract("My name is Ona Vale, a@b.example.com", spark=spark)
    assert [(s.label, s.text) for s in found.spans] == [("NAME_STUDENT", "Ona Vale"), ("EMAIL", "a@b.example.com")] and list(found.by_label()) == ["NAME_STUDENT", "EMAIL"]
    out = api.deidentify("Mail a@b.example.com now", spark=spark)
    assert out.text == "Mail [EMAIL] now" and out.replacements == {"a@b.example.com": "[EMAIL]"} and "a@b.example.com" not in json.dumps(out.record) and out.audit["verified"]
    with pytest.raises(api.LeakFound) as e:
        api.deidentify("Mail a@b.example.com now", method="keep", spark=spark)
    assert "a@b" not in str(e.value)


def test_model_and_audit(spark):
    load, broken = loaders()
    model = Model("zed", load, CLASSES)
    df = spark.createDataFrame([(1, "Zed met Ann. My name is Ann.")], "id int, text string")
    r = deidentify(df, model=model, model_name="zed", o_threshold=0.5).first()
    assert r.deidentified_text == "[STUDENT] met Ann. My name is Ann." and r.audit.detector == "zed" and r.audit.o_threshold == 0.5
    assert r.audit.model_authority == ["ID_NUM", "NAME_STUDENT", "STREET_ADDRESS"]
    low = deidentify(df, model=model, o_threshold=0.1).first()
    assert low.audit.entities_acted_on == 0
    with pytest.warns(RuntimeWarning):
        alone = deidentify(df, model=Model("gone", broken, CLASSES)).first()
    assert alone.audit.detector == "rules" and alone.audit.model_authority == []
    with pytest.raises(api.ModelUnavailable):
        deidentify(df, model=Model("gone", broken, CLASSES), model_name="gone")
    with pytest.raises(api.ModelUnavailable):
        deidentify(df, model=model, model_name="other")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "t.txt").write_text("Call 703-555-0134.", encoding="utf-8")
    assert cli.main(["policies"]) == 0 and capsys.readouterr().out.split() == ["coppa", "ferpa", "research"]
    assert cli.main(["extract", str(tmp_path / "t.txt")]) == 0 and json.loads(capsys.readouterr().out)["spans"][0]["text"] == "703-555-0134"
    assert cli.main(["redact", str(tmp_path / "t.txt")]) == 0 and capsys.readouterr().out == "Call [PHONE_NUM].\n"
    assert cli.main(["redact", "--json", str(tmp_path / "t.txt")]) == 0 and json.loads(capsys.readouterr().out)["n_entities"] == 1
    assert cli.main(["extract", "--model", "big", str(tmp_path / "t.txt")]) == 1 and cli.main(["redact", "nowhere"]) == 1
    with pytest.raises(SystemExit):
        cli.main(["redact", "--method", "keep", "x"])


def test_answers(spark):
    req = spark.createDataFrame([(1, "a", "rules", 200, None), (2, "b", "rules", 200, None), (3, "c", "big", 200, None), (4, None, None, 422, "no text")], "id int, text string, model_name string, status int, problem string")
    done = spark.createDataFrame([(1, "A", []), (2, "B", ["b"]), (3, "C", [])], "id int, deidentified_text string, leaks array<string>")
    got = {r.id: (r.status, r.problem, r.deidentified_text) for r in readers.answers(req, done, "id", model_ready=False).collect()}
    assert got == {1: (200, None, "A"), 2: (422, "leak", None), 3: (503, "model unavailable", None), 4: (422, "no text", None)}


def test_essays_carry_their_values(spark):
    rows = generators.essays(spark, 60).collect()
    assert len(rows) == 60 and len({l for r in rows for l in r.labels}) > 15
    for r in rows:
        assert "".join(t + (" " if w else "") for t, w in zip(r.tokens, r.trailing_whitespace)) == r.full_text
    assert rows == generators.essays(spark, 60).collect()


def test_surrogates_never_repeat_the_value(spark):
    from spanveil.operators import redact

    df = spark.createDataFrame([("NAME_STUDENT", n) for n in redact.FIRST] + [("NAME_STUDENT", "Ada Elm"), ("SSN", "900-12-3456"), ("SCHOOL", "[SCHOOL]")], "label string, v string")
    for seed in range(12):
        made = df.select("v", redact.surrogate(F.col("label"), F.col("v"), seed).alias("m")).collect()
        assert all(r.m and r.m != r.v for r in made)
    shown = df.limit(0).unionAll(spark.createDataFrame([("SSN", "x"), ("STREET_ADDRESS", "x"), ("NAME_STUDENT", "x")], "label string, v string")).select(redact._other(F.col("label"), F.lit("Ada Elm 7")).alias("m")).collect()
    assert [r.m for r in shown] == ["Ada Elm 8"] * 3
