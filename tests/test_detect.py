import re

import pytest
from pyspark.sql import functions as F

from spanveil.functions.spans import hits
from spanveil.operators import detectors
from spanveil.plans.analyze import analyze, exploded

FOUND = [
    ("Write to ona.vale+7@mail.example.org today.", "EMAIL", "ona.vale+7@mail.example.org"),
    ("Call (703) 555-0134 ext 9 now", "PHONE_NUM", "(703) 555-0134 ext 9"),
    ("Ring +44 7700 900 123 please", "PHONE_NUM", "+44 7700 900 123"),
    ("SSN 123-45-6789.", "SSN", "123-45-6789"),
    ("see https://github.com/onavale.", "URL_PERSONAL", "https://github.com/onavale"),
    ("My store is onavale.com", "URL_PERSONAL", "onavale.com"),
    ("add @ona_vale9 soon", "USERNAME", "ona_vale9"),
    ("my username on it is onavale", "USERNAME", "onavale"),
    ("My student ID is 0040417.", "ID_NUM", "0040417"),
    ("We live at 12 Old Mill Lane, Apt 4.", "STREET_ADDRESS", "12 Old Mill Lane, Apt 4"),
    ("Due March 3rd, 2012!", "DATE", "March 3rd, 2012"),
    ("My name is Ona Vale and I run", "NAME_STUDENT", "Ona Vale"),
    ("Sincerely,\nOna", "NAME_STUDENT", "Ona"),
    ("My little brother Tam laughed", "NAME_RELATED", "Tam"),
    ("Ask Mrs. Quill about it", "NAME_RELATED", "Quill"),
    ("At Lindow Middle School we", "SCHOOL", "Lindow Middle School"),
    ("the University of North Vale", "SCHOOL", "University of North Vale"),
    ("We moved to Stonewick last year", "LOCATION", "Stonewick"),
    ("near Saltmoor, VT in May", "LOCATION", "Saltmoor, VT"),
    ("im 12 and tall", "AGE", "12"),
    ("my birthday is June 5", "DATE", "June 5"),
    ("seen at 10.1.2.3 ok", "IP_ADDRESS", "10.1.2.3"),
    ("mac 0a:1b:2c:3d:4e:5f up", "DEVICE_ID", "0a:1b:2c:3d:4e:5f"),
    ("at 40.7128, -74.0060 now", "GEO", "40.7128, -74.0060"),
]
NOTHING = [
    "The lake has 7 islands and 2 bridges.",
    "In High School you get more homework.",
    "Instagram: Familiarity and more",
    "We read pages 1200-1350 in 2019-2020.",
    "I handle the issue and twitter is great.",
    "see www.wikipedia.org for more",
    "version 10.1.2.3.4 came out",
    "I live at 12 Oak Tracks with them.",
]


def test_found_and_not_found(spark):
    rows = [(i, t) for i, t in enumerate([t for t, _, _ in FOUND] + NOTHING)]
    got = exploded(analyze(spark.createDataFrame(rows, "id int, text string")), ["id"]).collect()
    by = {}
    for r in got:
        assert rows[r.id][1][r.span_start : r.span_end] == r.span_text
        by.setdefault(r.id, set()).add((r.label, r.span_text))
    for i, (t, label, value) in enumerate(FOUND):
        assert (label, value) in by.get(i, set()), (t, by.get(i))
    for i in range(len(FOUND), len(rows)):
        assert i not in by, (rows[i], by[i])


def test_hits_agree_with_another_engine(spark):
    texts = ["a1 bé22  c", "", "😀x9 9", "l1\nl22\n", "99", "no"]
    pattern = r"(?m)(?<!\w)\w*\d+(?!\w)|\d$"
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: [(h["start"], h["end"]) for h in r.h] for r in df.select("id", hits(F.col("t"), "(?Ud)" + pattern).alias("h")).collect()}
    assert got == {i: [m.span() for m in re.finditer(pattern, t)] for i, t in enumerate(texts)}


def test_propagation_boundaries(spark):
    text = "My name is Priya Odell. Priya's dog met O'Priya and Priyanka. priya@x.example.com Odell"
    got = exploded(analyze(spark.createDataFrame([(1, text), (2, None)], "id int, text string")), ["id"]).collect()
    names = sorted((r.span_start, r.span_text, r.source) for r in got if r.label == "NAME_STUDENT")
    assert names == [(11, "Priya Odell", "rules"), (24, "Priya", "propagated"), (82, "Odell", "propagated")]
    assert all(r.id == 1 for r in got)


def test_model_authority_and_label_choice(spark):
    df = spark.createDataFrame([(1, "My name is Ona and a@b.example.com")], "id int, text string")
    none = df.withColumn("m", F.array().cast("array<struct<label:string,text:string,start:int,end:int,confidence:double,source:string,seq:int>>"))
    assert {r.label for r in exploded(analyze(none, model_spans="m"), ["id"]).collect()} == {"EMAIL"}
    assert {r.label for r in exploded(analyze(none, model_spans="m", authority=()), ["id"]).collect()} == {"EMAIL", "NAME_STUDENT"}
    assert {r.label for r in exploded(analyze(df, labels=["EMAIL"]), ["id"]).collect()} == {"EMAIL"}
    assert len(exploded(analyze(df, labels=[]), ["id"]).collect()) == 2
    with pytest.raises(ValueError):
        detectors.detect(F.col("text"), ["SHOE_SIZE"])
