"""Files, manifests, the stage registry and the streaming forms."""

from pyspark.sql import functions as F

from duoscope.runtime import materialize, read
from duoscope.sources import files
from duoscope.streaming import sessions

SF = "/root/testdata/sf0.001"


def test_csv_keeps_text_as_it_is(spark):
    df = spark.createDataFrame([("007", "", None), ("1e-07", 'a "quoted", text', "NA")], "a string, b string, c string")
    assert sorted(map(tuple, files.csv_round_trip(df, typed=False).collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def test_manifest_finds_changes(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, text in (("a", "1"), ("b", "2")):
        (tmp_path / "d" / name).write_text(text)
    first = materialize(files.manifest(spark, f"file://{tmp_path}/d"), "manifest")
    (tmp_path / "d" / "b").write_text("3")
    (tmp_path / "d" / "c").write_text("4")
    problems = {r["path"][-1]: r["problem"] for r in files.compare_manifest(files.manifest(spark, f"file://{tmp_path}/d"), first).collect()}
    assert problems == {"b": "different", "c": "not listed"}


def test_registry_makes_a_stage_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3).toDF("x")

    r = files.Registry(spark, f"file://{tmp_path}/r")
    assert r.get("s", make, "v1").count() == r.get("s", make, "v1").count() == 3 and len(made) == 1
    r.get("s", make, "v2")
    assert len(made) == 2


def test_stream_equals_batch(spark, tmp_path):
    events = read(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = sessions.activity(sessions.read_stream(spark, f"file://{tmp_path}/in", events.schema), late="400 days")
    q = stream.writeStream.format("memory").queryName("activity").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.sql("select start, event_type, n from activity").collect()))
    assert got == sorted(map(tuple, sessions.activity(events).select("start", "event_type", "n").collect())) and got
