import random

from pyspark.sql import types as T

from spanveil.llm import chunking

SCHEMA = "document bigint, full_text string, tokens array<string>, trailing_whitespace array<boolean>, limit_id string"
LIMITS = "limit_id int, unit string, max_size int, overlap_size int"


def run(spark, rows, limits):
    got = chunking.split_records(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(limits, LIMITS)).collect()
    by = {}
    for r in got:
        by.setdefault((r.limit_id, r.document), []).append(r)
    return {k: sorted(v, key=lambda r: r.piece_no) for k, v in by.items()}


def check(pieces, size, most, overlap):
    assert pieces[0].piece_start == 0 and pieces[-1].piece_end == size
    for a, b in zip(pieces, pieces[1:]):
        assert b.piece_start == a.piece_end - overlap and b.piece_end > a.piece_end
    assert all(0 < p.piece_end - p.piece_start <= most for p in pieces)


def test_pieces_cover_and_overlap(spark):
    rng = random.Random(5)
    words = ["a", "kite", "über", "😀😀", "tall.", "so,", "end!\n\n", "x" * 70, "line\n"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", ""]) for _ in range(rng.randrange(1, 400))), None, None, "clash") for i in range(40)]
    rows += [(100, "y" * 5000, None, None, None), (101, "", None, None, None), (102, None, None, None, None)]
    rows += [(0, rows[0][1], None, None, "again"), (None, "z " * 400, None, None, None)]
    for most, overlap in ((120, 20), (100, 0), (37, 30), (9, 0)):
        got = run(spark, rows, [(7, "chars", most, overlap or None)])
        text = {r[0]: r[1] for r in rows}
        assert {k[1] for k in got} == {d for d, t in text.items() if t and len(t) > most}
        for (_, d), pieces in got.items():
            check(pieces, len(text[d]), most, overlap)
            assert all(p.piece == text[d][p.piece_start : p.piece_end] for p in pieces)


def test_natural_boundaries_win(spark):
    text = "One two three. " * 20 + "\n\n" + "Four five six. " * 20
    pieces = run(spark, [(1, text, None, None, None)], [(1, "chars", 320, 0)])[1, 1]
    assert [p.piece for p in pieces] == ["One two three. " * 20 + "\n\n", "Four five six. " * 20]
    pieces = run(spark, [(1, "Ab cd ef gh. " * 30, None, None, None)], [(1, "chars", 100, 10)])[1, 1]
    assert all(p.piece.endswith(". ") for p in pieces)


def test_tokens(spark):
    tokens = ["Ona", "went", "home", ".", "Then", "she", "slept", "."] * 30
    space = [True, True, False, True] * 60
    text = "".join(t + (" " if s else "") for t, s in zip(tokens, space))
    rows = [(1, None, tokens, space, None), (2, text, tokens, space, None), (3, "short", ["short"], [False], None)]
    rows += [(4, None, tokens, None, None), (5, None, tokens, space[:9], None), (6, None, [None] * 50, [None] * 50, None), (7, None, [], [], None)]
    got = run(spark, rows, [(2, "tokens", 20, 4), (3, "tokens", None, 4), (4, "pages", 3, 0)])
    assert {k for k in got} == {(2, d) for d in (1, 2, 4, 5, 6)}
    for (_, d), pieces in got.items():
        check(pieces, 50 if d == 6 else 240, 20, 4)
    for d in (1, 2):
        assert all(p.piece.rstrip().endswith(".") for p in got[2, d])


def test_empty(spark):
    assert run(spark, [], [(1, "chars", 10, 2)]) == {}
    assert run(spark, [(1, "text", None, None, None)], []) == {}
    bad = spark.createDataFrame([(1, "chars", 10, 10)], LIMITS)
    rows = spark.createDataFrame([(1, "text", None, None, None)], SCHEMA)
    try:
        chunking.split_records(rows, bad)
    except ValueError:
        return
    raise AssertionError("an overlap as large as the limit must be refused")
