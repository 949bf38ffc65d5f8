from pyspark.sql import types as T

from spanveil.streaming import stream


def test_same_results_on_a_stream(spark, tmp_path):
    rows = [(1, "2026-01-01 10:00:00", "My name is Ona Vale, a@b.example.com"), (2, "2026-01-01 10:20:00", "nothing"), (3, "2026-01-01 12:00:00", None)]
    df = spark.createDataFrame(rows, "id bigint, at string, text string").selectExpr("id", "CAST(at AS TIMESTAMP) AS at", "text")
    df.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream.deidentify_stream(live).select("id", "deidentified_text").writeStream.format("memory").queryName("deid_out").start()
    q.processAllAvailable()
    q.stop()
    assert {r.id: r.deidentified_text for r in spark.table("deid_out").collect()} == {1: "My name is [STUDENT], [EMAIL]", 2: "nothing", 3: None}
    q = stream.label_counts(live, "at").writeStream.outputMode("complete").format("memory").queryName("label_out").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.label, r.spans) for r in spark.table("label_out").collect()} == {("NAME_STUDENT", 1), ("EMAIL", 1)}
    assert isinstance(df.schema["at"].dataType, T.TimestampType)
