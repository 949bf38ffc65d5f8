import hashlib

import pytest
from pyspark.sql import functions as F

from spanveil.operators import policy, redact
from spanveil.plans.analyze import deidentify


def run(spark, text, **kw):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return deidentify(df, **kw).collect()[0]


def test_mask_and_audit(spark):
    r = run(spark, "My name is Ona Vale. Write ona@x.example.com on 03/14/2012. Ona left.", date_shift_days=10)
    assert r.deidentified_text == "My name is [STUDENT]. Write [EMAIL] on 03/24/2012. [STUDENT] left."
    assert r.leaks == [] and r.audit.entities_acted_on == 4 and r.audit.by_label == {"DATE": 1, "EMAIL": 1, "NAME_STUDENT": 2}
    assert r.audit.output_sha256 == hashlib.sha256(r.deidentified_text.encode()).hexdigest()
    assert r.audit.policy_sha256 == policy.fingerprint("ferpa") and r.replacements["Ona"] == "[STUDENT]"


def test_methods(spark):
    text = "Mail a@b.example.com or 703-555-0134."
    assert run(spark, text, method="hash").deidentified_text.startswith("Mail " + hashlib.sha256(b"spanveila@b.example.com").hexdigest()[:10])
    a, b = run(spark, text, policy="research"), run(spark, text, policy="research")
    assert a.deidentified_text == b.deidentified_text and "a@b.example.com" not in a.deidentified_text
    with pytest.raises(Exception, match="leak"):
        run(spark, text, method="keep")
    kept = run(spark, text, method="keep", verify=False)
    assert kept.leaks == ["a@b.example.com", "703-555-0134"] and kept.deidentified_text == text
    with pytest.raises(Exception, match="unknown method"):
        run(spark, text, method="shred")
    with pytest.raises(ValueError):
        run(spark, text, date_shift_days=0)


def test_dates(spark):
    rows = ["03/14/2012", "3/4/2012", "2012-03-14", "March 3, 2012", "Mar 3, 2012", "March  3 2012", "02/30/2012", "September 5, 2012", "03.14.2012"]
    df = spark.createDataFrame([(v,) for v in rows], "v string").select(redact.shift_date(F.col("v"), 30).alias("o"))
    assert [r.o for r in df.collect()] == ["04/13/2012", "04/03/2012", "2012-04-13", "April 02, 2012", "Apr 02, 2012", "April 02 2012", "[DATE]", "[DATE]", "[DATE]"]
    n = spark.range(2000).select(redact.shift_days(F.col("id"), 3).alias("n"))
    low, high, zero = n.agg(F.min("n"), F.max("n"), F.sum((F.col("n") == 0).cast("int"))).collect()[0]
    assert zero == 0 and -365 <= low < 0 < high <= 365


def test_leaks_are_sought_in_what_was_left(spark):
    df = spark.createDataFrame([("Ann saw Annual Ann", ["Ann", "saw", "An", "Bob"])], "t string, v array<string>")
    assert df.select(redact.leaks_in(F.col("t"), F.col("v")).alias("x")).collect()[0].x == ["Ann", "saw"]


def test_nulls_and_policy_table(spark):
    df = spark.createDataFrame([(1, None, "ferpa"), (2, "", "ferpa"), (3, "a@b.example.com", "coppa"), (4, "a@b.example.com", None)], "id int, text string, p string")
    got = {r.id: r for r in deidentify(df, policy.table(spark), policy_name="p").collect()}
    assert got[1].deidentified_text is None and got[2].deidentified_text == ""
    assert got[3].deidentified_text == "[EMAIL]" and got[4].deidentified_text == "a@b.example.com"


def test_policies():
    assert policy.available() == ["coppa", "ferpa", "research"]
    with pytest.raises(FileNotFoundError):
        policy.load("nope")
    p = policy.parse('{"labels": {"EMAIL": true, "SSN": false, "DATE": null}}')
    assert p["labels"] == {"EMAIL": (True, None, None, None)} and p["default_method"] == "mask"
