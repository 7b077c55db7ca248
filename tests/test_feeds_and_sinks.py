"""Bundles as a stream with restarts, days written in two phases, and sessions kept as state."""

import datetime as dt
import io
import os
import random
import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F

from stormlane.operators import intervals
from stormlane.plans.views import Views
from stormlane.sources import bundles
from stormlane.streaming import feeds

SF = "/root/testdata/sf0.001"


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def add(path, bundle, *members):
    with zipfile.ZipFile(f"{path}/{bundle}.zip", "a") as z:
        for name, content in members:
            z.writestr(name, content)


def run_once(stream, out, state):
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def test_stream_of_bundles_gives_each_member_once_over_restarts(spark):
    home = folder()
    os.mkdir(path := f"{home}/in")
    member = lambda day, hour, kind="x.xml": (f"speeds/202405{day:02d}-{hour:02d}00-{kind}", f"{day} {hour}")
    read = lambda: run_once(bundles.stream_bundles(spark, path, ".xml", slice_bytes=4).select("bundle", "position", "name", "day", "content"), f"{home}/out", f"{home}/state")
    add(path, "may", member(1, 0), member(1, 1), member(1, 1, "y.csv"))
    read()
    assert spark.read.parquet(f"{home}/out").count() == 2
    read()  # nothing new
    add(path, "may", member(2, 0), member(1, 1))  # more in a known bundle, one of them a repeat of a name
    add(path, "april", *[(f"speeds/20240430-0{h}00-x.xml", "late") for h in range(3)])  # a bundle of older times
    read()
    read()
    got = spark.read.parquet(f"{home}/out")
    want = bundles.read_bundles(spark, path, ".xml").select(*got.columns)
    assert got.count() == 7 and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_stream_of_readings_from_a_path(spark):
    home = folder()
    os.mkdir(path := f"{home}/in")
    lane = "<lane><lane_id>Fast</lane_id><speed>{}</speed><occupancy>3</occupancy><volume>2</volume><valid>Y</valid></lane>"
    document = "<raw_speed_volume_list><date>2024-05-01</date><periods><period><period_from>08:00:00</period_from><period_to>08:00:30</period_to><detectors><detector><detector_id>D1</detector_id><direction>N</direction><lanes>{}</lanes></detector></detectors></period></periods></raw_speed_volume_list>"
    add(path, "may", ("f/20240501-0801-rawSpeedVol.xml", document.format(lane.format(50))), ("f/20240501-0802-rawSpeedVol.xml", document.format(lane.format(60) + "<lane><lane_id>cut")[:-80]))
    for _ in range(2):
        run_once(feeds.stream_archive(spark, path), f"{home}/out", f"{home}/state")
    got = spark.read.parquet(f"{home}/out").orderBy("archived").collect()
    assert [(r.archived, r.detector_id, r.speed) for r in got] == [(dt.datetime(2024, 5, 1, 8, 1), "D1", 50.0), (dt.datetime(2024, 5, 1, 8, 2), "D1", 60.0)]


def days_of(spark, path):
    return sorted((r.day, r.name, bytes(r.content).decode()) for r in bundles.read_bundles(spark, path).selectExpr("regexp_extract(bundle, '(.*)-', 1) as day", "name", "content").collect())


def members(spark, *rows):
    return spark.createDataFrame([(d, n, None if c is None else c.encode()) for d, n, c in rows], "day string, name string, content binary")


def test_days_are_written_once(spark):
    path = f"{folder()}/out"
    first = [("2024-05-01", f"m{k}", f"one {k}") for k in range(50)] + [("2024-05-02", "a", "two")]
    bundles.write_days(members(spark, *first, (None, "x", "x"), ("2024-05-03", None, "x"), ("2024-05-03", "x", None)), path, parts=3)
    assert days_of(spark, path) == sorted(first)
    bundles.write_days(members(spark, ("2024-05-02", "b", "new"), ("2024-05-04", "c", "four")), path)
    assert days_of(spark, path) == sorted([*first, ("2024-05-04", "c", "four")])
    bundles.write_days(members(spark, ("2024-05-01", "b", "new")), path, overwrite=True)
    assert days_of(spark, path) == [("2024-05-01", "b", "new"), ("2024-05-02", "a", "two"), ("2024-05-04", "c", "four")]
    bundles.write_days(members(spark), path)
    assert not [f for f in os.listdir(path) if not f.endswith(".zip")]


def test_a_failed_task_leaves_nothing_visible(spark):
    path = f"{folder()}/out"
    bundles.write_days(members(spark, ("2024-05-01", "a", "old")), path)
    bad = members(spark, ("2024-05-01", "a", "newer"), *[(f"2024-05-{k:02d}", "m", "fine") for k in range(2, 20)])
    bad = bad.withColumn("content", F.when(F.col("day") == "2024-05-11", F.raise_error("broken").cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken"):
        bundles.write_days(bad, path, overwrite=True)
    assert days_of(spark, path) == [("2024-05-01", "a", "old")] and len(os.listdir(path)) == 1


def streamed(spark, rows, run, files):
    home = folder()
    for k in range(files):  # a file a step, in order of time
        rows.where(F.col("step") == k).drop("step").coalesce(1).write.mode("append").parquet(f"{home}/in")
    stream = spark.readStream.schema(rows.drop("step").schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/in")
    run_once(run(stream), f"{home}/out", f"{home}/state")
    return spark.read.parquet(f"{home}/out")


@pytest.mark.parametrize("gap", ["0 minutes", "45 minutes"])
def test_streamed_episodes_equal_merged_intervals(spark, gap):
    """All signals, those of no length too; the last step is one far later signal that closes everything before it."""
    signals = Views(spark, SF).signals.select(F.lit(1).alias("one"), "signal_id", (F.col("detector_id") % 5).alias("detector_id"), "start", F.when(F.col("signal_id") % 7 == 0, F.col("start")).otherwise(F.col("end")).alias("end"), "level", "provisional")
    last = signals.agg(F.max("end")).first()[0]
    first = signals.agg(F.min("start")).first()[0]
    width = (last - first) / 4
    step = F.floor(F.timestamp_diff("SECOND", F.lit(first).cast("timestamp_ntz"), F.col("start")) / width.total_seconds())
    rows = signals.withColumn("step", F.least(step, F.lit(3)))
    closing = rows.limit(1).withColumn("detector_id", F.lit(99).cast("long")).withColumn("start", F.lit(last + dt.timedelta(days=9)).cast("timestamp_ntz")).withColumn("end", F.col("start")).withColumn("step", F.lit(4).cast("long"))
    late = closing.withColumn("start", F.col("start") + F.expr("interval 1 day")).withColumn("end", F.col("start")).withColumn("step", F.lit(5).cast("long"))
    every = rows.unionByName(closing).unionByName(late).select("detector_id", F.col("start").cast("timestamp"), F.col("end").cast("timestamp"), "level", "step")
    got = streamed(spark, every, lambda s: feeds.stream_episodes(s, ["detector_id"], gap), 6)
    want = intervals.merge_intervals(signals, ["detector_id"], gap)
    key = lambda df: sorted((r.detector_id, r.start, r.end, r.max_level, r.n_signals) for r in df.collect())
    assert key(got.where("detector_id < 99")) == key(want) and want.where("start = end").count() > 0
