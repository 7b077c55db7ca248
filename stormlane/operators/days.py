"""Selection of event and control days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormlane.functions.scalar import level_name


def touched_days(intervals: DataFrame, pad_hours: int = 0) -> DataFrame:
    """A row per calendar day that the padded interval touches, its last day included even if it ends at midnight."""
    pad = F.make_dt_interval(F.lit(0), F.lit(pad_hours))
    return intervals.withColumn("date", F.explode(F.sequence(F.to_date(F.col("start") - pad), F.to_date(F.col("end") + pad), F.expr("interval 1 day"))))


def event_days(episodes: DataFrame, pad_hours: int = 3) -> DataFrame:
    """(date, episode_ids ascending, max_level)."""
    return touched_days(episodes, pad_hours).groupBy("date").agg(F.array_sort(F.collect_set("episode_id")).alias("episode_ids"), F.max("max_level").alias("max_level"))


def excluded_days(episodes: DataFrame, cyclones: DataFrame) -> DataFrame:
    """Days of any warning, unpadded and of any level, or of any cyclone signal."""
    return touched_days(episodes).select("date").union(touched_days(cyclones).select("date")).distinct()


def select_days(episodes: DataFrame, cyclones: DataFrame, years: tuple, months: tuple = tuple(range(1, 13)), min_level: int = 1, pad_hours: int = 3, n_controls: int = 2, since: str = "2021-06-01") -> DataFrame:
    """(date, role, episode_ids, max_level, max_level_name): event days and, one to n weeks before, days without an event,
    warning or cyclone signal as controls."""
    chosen = episodes.where((F.col("max_level") >= min_level) & F.year("start").between(*years) & F.month("start").isin(*months))
    events = event_days(chosen, pad_hours).withColumn("role", F.lit("event"))
    earlier = events.select(F.explode(F.sequence(F.lit(1), F.lit(n_controls))).alias("k"), "date").select(F.date_sub("date", F.col("k") * 7).alias("date")).distinct()
    controls = earlier.join(events.select("date"), "date", "left_anti").join(excluded_days(episodes, cyclones), "date", "left_anti")
    controls = controls.select("date", F.array().cast("array<int>").alias("episode_ids"), F.lit(0).alias("max_level"), F.lit("control").alias("role"))
    both = events.withColumn("episode_ids", F.col("episode_ids").cast("array<int>")).unionByName(controls).where(F.col("date") >= F.lit(since).cast("date"))
    return both.withColumn("max_level_name", level_name(F.col("max_level"))).select("date", "role", "episode_ids", "max_level", "max_level_name")


def role_counts(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count_if(F.col("role") == "event").alias("n_event"), F.count_if(F.col("role") == "control").alias("n_control"))


def episodes_by_year(episodes: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("max_level") == k).alias(name) for k, name in ((1, "amber"), (2, "red"), (3, "black"))]
    return episodes.groupBy(F.year("start").alias("year")).agg(*counts)
