"""Streams over the events table: repeats go, late windows close, a second run adds nothing."""

from pyspark.sql import functions as F

from siltworks.sources import writers
from siltworks.streaming.ingest import distinct_events, ingest, windowed_counts

SF = "/root/testdata/sf0.001"


def stream(spark, tmp_path, rows):
    rows.write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))


def collected(spark, df, name, tmp_path, mode="append"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    return spark.table(name).collect()


def test_repeated_events_go(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    twice = events.unionByName(events.where("event_id % 2 = 0"))
    got = collected(spark, distinct_events(stream(spark, tmp_path, twice), "event_id", "ts", "400 days"), "distinct_rows", tmp_path)
    assert len(got) == events.count() == len({r.event_id for r in got})


def test_windows_count_by_kind(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    want = {(r.start, r.event_type): r.n for r in events.groupBy(F.window("ts", "1 hour").start.alias("start"), "event_type").agg(F.count("*").alias("n")).collect()}
    got = collected(spark, windowed_counts(stream(spark, tmp_path, events), "ts", "event_type", "1 hour", "10 minutes"), "window_rows", tmp_path, "complete")
    assert {(r.start, r.event_type): r.n for r in got} == want


def test_ingest_takes_new_files_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1"), ("", "x")], "title string, amount string")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest(spark, str(tmp_path / "in"), rows.schema, [("title", True, "string"), ("amount", False, "float")], str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination(120)
    assert {r.title: r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a": "valid", "": "error"}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_exports_choose_rows_and_columns(spark):
    flat = spark.createDataFrame([(1, "valid", "INCLUDE"), (2, "error", "INCLUDE"), (3, "human_reviewed", "REVIEW")], "id int, _prov_status string, _curation_decision string")
    assert [r.id for r in writers.chosen(flat, valid_only=True).collect()] == [1, 3]
    assert writers.chosen(flat, ["x"]).columns == ["_prov_status", "_curation_decision"]
    assert writers.file_name("a b/c") == "a_b_c" and writers.file_name("..") == "export"
