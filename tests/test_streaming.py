import tempfile

import pytest
from pyspark.sql import functions as F

from stormlane.operators import align, cleaning, intervals
from stormlane.plans.views import Views
from stormlane.streaming import feeds

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views(spark):
    return Views(spark, SF)


def zoned(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})


def streamed(spark, rows, run, at, files=4):
    """The rows of ``run`` over a file stream of ``rows``, in order of ``at``, and the last progress reports."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    one = rows.coalesce(1).sortWithinPartitions(at)  # files are written, and so read, in order of time
    one.write.option("maxRecordsPerFile", -(-rows.count() // files)).parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = run(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out"), query.recentProgress


def test_bins_equal_batch_for_closed_windows(spark, views):
    readings = zoned(views.readings, "time")
    got, _ = streamed(spark, readings, feeds.stream_bins, "time")
    want = zoned(align.bin_time(views.readings), "bin").select(*got.columns)
    last = got.agg(F.max("bin")).first()[0]
    key = lambda df: sorted((r.detector_id, r.bin, r.n, r.volume, round(r.speed, 6)) for r in df.where(F.col("bin") <= last).collect())
    assert got.count() > 500 and key(got) == key(want)


def test_sliding_windows_equal_batch_where_closed(spark, views):
    readings = zoned(views.readings, "time")
    got, _ = streamed(spark, readings, feeds.stream_sliding, "time")
    window = F.window("time", "60 minutes", "15 minutes")
    want = readings.groupBy("detector_id", window.alias("w")).agg(F.count("*").alias("n"), F.sum("volume").alias("volume"), F.avg("speed").alias("speed")).withColumn("bin", F.col("w.start"))
    last = got.agg(F.max("bin")).first()[0]
    key = lambda df: sorted((r.detector_id, r.bin, r.n, r.volume, round(r.speed, 6)) for r in df.where(F.col("bin") <= last).collect())
    assert got.count() > 2000 and key(got) == key(want)


def test_overlap_is_dropped_as_in_batch(spark, views):
    once = zoned(views.readings, "time").withColumn("archived", F.date_trunc("hour", "time"))
    twice = once.unionByName(once.withColumn("archived", F.col("archived") + F.expr("interval 5 minutes")))
    got, _ = streamed(spark, twice, lambda s: feeds.stream_readings(s, "2 hours"), "time")
    want = cleaning.dedup_overlap(twice)
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in want.collect())


def test_sessions_equal_merged_intervals(spark, views):
    signals = views.signals.where("end > start")
    got, _ = streamed(spark, zoned(signals, "start", "end"), lambda s: feeds.stream_sessions(s, ["detector_id"]), "start")
    want = {(r.detector_id, r.start, r.end, r.n_signals) for r in zoned(intervals.merge_intervals(signals, ["detector_id"]), "start", "end").collect()}
    found = {(r.detector_id, r.start, r.end, r.n_signals) for r in got.collect()}
    # Sessions are emitted once the watermark, six hours behind the last batch but one or later, has passed their end.
    closed = max(end for _, _, end, _ in found)
    assert len(found) == got.count() > 0 and found == {w for w in want if w[2] <= closed}


def test_late_bulletins_are_dropped_and_counted(spark, views):
    rows = views.rain.select(F.col("hour").cast("timestamp").alias("issued"), "district", "max_mm", F.col("hour").cast("timestamp").alias("arrival"))
    late = rows.orderBy("issued").limit(5).withColumn("arrival", F.expr("timestamp'2030-01-01'"))
    _, progress = streamed(spark, rows.unionByName(late), lambda s: feeds.stream_rain(s), "arrival")
    assert sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"]) > 0


def test_enrichment_equals_the_batch_join(spark, views):
    readings = zoned(views.readings, "time")
    got, _ = streamed(spark, readings, lambda s: feeds.stream_enrich(s, views.detectors), "time")
    assert got.count() == align.join_detector(views.readings, views.detectors).count()
    rain = zoned(views.rain, "hour").select(F.col("hour").alias("issued"), "district", "max_mm")
    located = zoned(align.join_detector(views.readings, views.detectors), "time").select("event_id", "time", "district")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rain.coalesce(1).write.parquet(f"{folder}/rain")
    bulletins = spark.readStream.schema(rain.schema).parquet(f"{folder}/rain")
    joined, _ = streamed(spark, located, lambda s: feeds.stream_rain_join(s, bulletins), "time", files=1)
    want = located.alias("a").join(rain.alias("b"), F.expr("a.district = b.district and issued >= time and issued <= time + interval 60 minutes"))
    assert joined.count() == want.count()
