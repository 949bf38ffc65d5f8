import random
from datetime import date, timedelta

import pytest

from spanveil.llm import pii

KEY = b"k"
FOUND = [
    ("My name is Ona Vale and I like maps.", [("NAME", "Ona Vale")]),
    ("Sincerely,\nOna K. Vale\nPeriod 3", [("NAME", "Ona K. Vale")]),
    ("By Vale, Ona\nThe lake froze. Ona's report on ice was long.", [("NAME", "Vale, Ona"), ("NAME", "Ona")]),
    ("I asked Mrs. Quarrel about it. We sat with Tam van Odel at the gym.", [("NAME", "Quarrel"), ("NAME", "Tam van Odel")]),
    ("im ona btw\nadd Tam to the group chat\nONA VALE period 4", [("NAME", "ona"), ("NAME", "Tam"), ("NAME", "ONA VALE")]),
    ("Tutor: Great job today, Zoë!\nZoë: ok, I think so too", [("NAME", "Zoë"), ("NAME", "Zoë")]),
    ("Write to ona.vale+hw@mail.example.org, or ona at mail dot example dot com.", [("EMAIL", "ona.vale+hw@mail.example.org"), ("EMAIL", "ona at mail dot example dot com")]),
    ("(contact: ona_v (at) mail.example.com) ok", [("EMAIL", "ona_v (at) mail.example.com")]),
    ("You can write me at ona dot vale at mail dot example dot com for it", [("EMAIL", "ona dot vale at mail dot example dot com")]),
    ("Call me at (703) 555-0134 ext. 9 after class", [("PHONE_NUM", "(703) 555-0134 ext. 9")]),
    ("My phone number is +44 7700 900123. text 5715550134 or 555-0177", [("PHONE_NUM", "+44 7700 900123"), ("PHONE_NUM", "5715550134"), ("PHONE_NUM", "555-0177")]),
    ("call five seven one five five five zero one three four now", [("PHONE_NUM", "five seven one five five five zero one three four")]),
    ("My student ID is 0040417. lunch number K-9578-82X is mine", [("ID_NUM", "0040417"), ("ID_NUM", "K-9578-82X")]),
    ("The form wanted my SSN, 913-10-1205, so. 40417 is what it says on my school card", [("ID_NUM", "913-10-1205"), ("ID_NUM", "40417")]),
    ("We live at 77-B East Cinder Drive, Apt 4, Saltmoor, MN 00918.", [("STREET_ADDRESS", "77-B East Cinder Drive, Apt 4, Saltmoor, MN 00918")]),
    ("Our house on 12th Blvd has it. pickup: P.O. Box 49, Quarry Falls, MN 00182", [("STREET_ADDRESS", "12th Blvd"), ("STREET_ADDRESS", "P.O. Box 49, Quarry Falls, MN 00182")]),
    ("We live at 862 thistle avenue unit b, hallowgate, me 00675", [("STREET_ADDRESS", "862 thistle avenue unit b, hallowgate, me 00675")]),
]
# Names beyond introductions, other languages, values longer than any fixed look-back, numbers taken whole or not at all.
FOUND += [
    ("I met Ona Vale yesterday. Contact Kwame Asante for help.", [("NAME", "Ona Vale"), ("NAME", "Kwame Asante")]),
    ("Hola, mi nombre es Juan Perez y vivo lejos.", [("NAME", "Juan Perez")]),
    ("Bonjour, je m'appelle Luc Martin.", [("NAME", "Luc Martin")]),
    ("Nice try on that one, Zadie! Next page.", [("NAME", "Zadie")]),
    ("x" * 85 + "@mail.example.org is long", [("EMAIL", "x" * 85 + "@mail.example.org")]),
    ("call seven oh three five nine one two eight four nine now", [("PHONE_NUM", "seven oh three five nine one two eight four nine")]),
    ("Call 020 7946 0958 please", [("PHONE_NUM", "020 7946 0958")]),
]
NOTHING = [
    "The list ends in 020 7946 0958 as printed.", "We met Both Teams at noon?"[:10], "I met a Tall man.",
    "", "   ", "add me @ona_vale9 for maps. see https://blogs.example.com/@tam.vale12 now",
    "31 Oak trees drive the cost up. Chase the rusty ramp. Dawn came and it was gloomy. Mark the page.",
    "The kit has the model code LB-728139. Invoice 6199845 listed eleven. The barcode 405577 142901 was old.",
    "Between 1940 and 1957 the score was 191-359. Version 5.8.80 costs 12.50.", "I go to Fennbridge Middle School. We moved to Crestholm, MN in June.",
    "bring twelve chairs to the town square", "By Friday, the budget was gone.",
]


@pytest.mark.parametrize("text,want", FOUND)
def test_found(text, want):
    assert [(l, text[a:b]) for l, a, b in pii.find_spans(text)] == want


@pytest.mark.parametrize("text", NOTHING)
def test_nothing(text):
    assert pii.find_spans(text) == []


def test_any_text_is_survived():
    rng = random.Random(3)
    bits = ["İ", "ß", "\x00", "😀", "my name is ", "By ", "\n", "Sincerely,\n", "Ona", " at ", " dot ", "@", "(", "555-0134", "12 Oak St", "'s ", "period 4", ":", " " * 9, "12-", "+", "x" * 40, "�", " "]
    for _ in range(1500):
        t = "".join(rng.choices(bits, k=rng.randrange(0, 14)))
        spans = pii.find_spans(t)
        assert all(0 <= a < b <= len(t) for _, a, b in spans) and all(x[2] <= y[1] for x, y in zip(spans, spans[1:]))
        back, at = [], 0
        for _, a, b in spans:
            back += [t[at:a], t[a:b]]
            at = b
        assert "".join(back) + t[at:] == t
    assert pii.find_spans("x " * 400_000) == []


def test_feistel_is_a_permutation():
    for size in (2, 10, 97, 1000):
        f = pii.Feistel(KEY, size, "t")
        image = [f.forward(v) for v in range(size)]
        assert sorted(image) == list(range(size)) and [f.backward(v) for v in image] == list(range(size))


def test_numbers_keep_format_and_come_back():
    rng = random.Random(1)
    for shape in ("9999999", "999-99-9999", "A-9999-99A", "(999) 999-9999 ext 99", "A99999999", "9999 9999 9999 9999"):
        for _ in range(20):
            v = "".join(rng.choice("0123456789") if c == "9" else rng.choice("ABCXYZ") if c == "A" else c for c in shape)
            w = pii.permute_number(v, KEY)
            assert len(w) == len(v) and all(a.isdigit() == b.isdigit() and a.isalpha() == b.isalpha() for a, b in zip(v, w))
            assert pii.permute_number(w, KEY, back=True) == v and pii.permute_number(v, KEY) == w
    card = "4539578763621486"
    assert pii._luhn(card) == 0 and pii._luhn(pii.permute_number(card, KEY)) == 0 and pii.permute_number(pii.permute_number(card, KEY), KEY, True) == card


def test_dates():
    seen = set()
    for k in range(0, 70000, 997):
        v = (date(1900, 1, 1) + timedelta(days=k)).isoformat()
        w = pii.permute_date(v, KEY)
        seen.add(w)
        assert pii.permute_date(w, KEY, back=True) == v
        us = pii.permute_date(f"{v[5:7]}/{v[8:]}/{v[:4]}", KEY)
        assert us == f"{w[5:7]}/{w[8:]}/{w[:4]}"
    assert len(seen) == len(range(0, 70000, 997)) and pii.permute_date("2012-02-30", KEY) is None


def test_tables(spark):
    docs = [(1, "My name is Ona Vale, ID 3.", None, None, "x"), (1, "My name is Ona Vale, ID 3.", None, None, "x"), (2, None, ["Call", "703-555-0134"], [True, False], None), (3, None, None, None, None), (None, "My name is Ona", None, None, None)]
    runs = [(7, "my social is 929 30 5414", "x"), (8, None, None)]
    a = spark.createDataFrame(docs, "document bigint, full_text string, tokens array<string>, trailing_whitespace array<boolean>, label string")
    b = spark.createDataFrame(runs, "request_id bigint, original_text string, spans string")
    got = sorted(tuple(r) for r in pii.values(a, b, "k").select("src", "rec_id", "label", "span_start", "span_end").collect())
    assert got == [("deid_results", 7, "ID_NUM", 13, 24), ("labelled_docs", 1, "NAME", 11, 19), ("labelled_docs", 2, "PHONE_NUM", 5, 17)]
    out = {(r.src, r.rec_id): r.text for r in pii.redacted(a, b).collect()}
    assert out["labelled_docs", 1] == "My name is [NAME], ID 3." and out["deid_results", 8] is None and out["deid_results", 7] == "my social is [ID_NUM]"
    same = {(r.src, r.rec_id): r.text for r in pii.redacted(a, b, "k").collect()}
    twice = pii.linked(a.unionAll(spark.createDataFrame([(9, "my name is Ona Vale", None, None, "x")], a.schema)), b, "k").collect()
    assert [(r.label, r.records, r.uses) for r in twice] == [("NAME", 2, 2)]
    assert same["deid_results", 7] != "my social is 929 30 5414" and same["deid_results", 7][16] == " "
    none = pii.values(a.limit(0), b.limit(0), "k")
    assert none.collect() == []


def test_many_names_in_one_text():
    rng = random.Random(2)
    made = sorted({"".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(4)).capitalize() for _ in range(120)})
    text = "".join(f"My name is {w} Vale.\n" for w in made)
    tail = "".join(f"We met {w} and {w}'s dog, not x{w.lower()}.\n" for w in made)
    got = [text_ for l, a, b in pii.find_spans(text + tail) if a >= len(text) for text_ in [(text + tail)[a:b]]]
    assert got == [w for w in made for _ in range(2)]
