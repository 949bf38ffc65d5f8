import random

import pytest

from spanveil.llm import truncation as tr

SCHEMA = "doc_id bigint, text string, source string, genre string, n_chars bigint, cut string, word int"


@pytest.mark.parametrize(
    "text,mark", [("abc [truncated]", "residue"), ("so we [...]", "residue"), ("caf�", "bytes"), ("salt &am", "escape"), ("a \\u00", "escape"), ("see <a hre", "markup"), ("Fine.", None), ("it cost 5%", None), ("x < y", None)]
)
def test_marks(text, mark):
    assert tr.ending(text)["mark"] == mark


def test_stack():
    assert tr.open_at_end('He said "yes" and (left') == [("(", 18)]
    assert tr.open_at_end('a "b (c" d') == [] and tr.open_at_end("(a\n\nb") == [] and tr.open_at_end(") ] ”") == []
    assert tr.open_at_end("<div><p>a {b} {c") == [("<div>", 0), ("{", 14)] and tr.open_at_end("<b>a\n\nb</b> <br> <i/>") == []
    assert tr.ending('One. We saw the "sphe')["open"] == "quote" and tr.ending('One "two. Three four')["open"] is None
    assert tr.ending("One <div>two.")["open"] == "element" and tr.ending("set {a, b")["open"] == "bracket" and tr.ending("if a < b and c > d.")["open"] is None
    assert tr.ending("Is it 5 o'clock")["open"] is None


def corpus():
    rng = random.Random(5)
    nouns, verbs = "robot kite lantern bridge garden quilt poster sundial".split(), "painted carried measured rescued".split()
    ends = ["carefully", "yesterday", "together", "outside"]

    def sentence():
        return f"The {rng.choice(nouns)} was {rng.choice(verbs)} near the {rng.choice(nouns)} {rng.choice(ends)}."

    rows, cut = [], set()
    for i in range(600):
        text = " ".join(sentence() for _ in range(rng.randrange(4, 12)))
        source, said = rng.choice(["Portal A", "portal-a ", "lms"]), None
        kind = rng.random()
        if source != "lms" and len(text) > 300:
            text = text[:300]
            if not text.rstrip().endswith("."):
                cut.add(i)
        elif source == "lms" and kind < 0.3:
            said = len(text)
            text = text[: rng.randrange(60, len(text) - 3)]
            if not text.rstrip().endswith("."):
                cut.add(i)
        elif kind < 0.4:
            text = text[:-1]
        elif kind < 0.5:
            text += " The end"
        elif kind < 0.6:
            text = text[:-1] + "..."
        elif kind < 0.65:
            text += " :)"
        rows.append((i, text, source, "essay", said or len(text), "clash", 1))
    rows += [rows[3], (900, None, "lms", None, 5, None, None), (901, " \n", None, "essay", None, None, None), (None, "The kite was pai", "lms", "essay", None, None, None), (902, "Ok", None, None, None, None, None)]
    return rows, cut


def test_corpus(spark):
    rows, cut = corpus()
    out = tr.judged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.doc_id for r in out) == sorted({r[0] for r in rows if r[0] is not None and r[1] and r[1].strip()})
    got = {r.doc_id for r in out if r.cut}
    assert {r.why for r in out if r.cut} <= {"sentence", "limit", "reported", "tail"} and {r.tie for r in out if r.why == "sentence"} <= {"fragment", "inside"}
    missed, wrong = cut - got, got - cut
    assert len(missed) <= 0.04 * len(cut) and len(wrong) <= 0.04 * len(cut), (missed, wrong)
    report = {r.source: r for r in tr.truncation_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(report) == {"portal_a", "lms", None} and sum(r.texts for r in report.values()) == len(out) and report[None].cut == 0


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert tr.truncated(none).collect() == [] and tr.truncation_report(none).collect() == []
