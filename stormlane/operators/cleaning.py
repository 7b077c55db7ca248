"""Cleaning of lane readings: validity, bounds, placeholders, stuck sensors, outliers, overlap, and a report of it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormlane.operators.quantiles import middle
from stormlane.operators.scans import PIECE, fresh, with_runs

SPEED, OCCUPANCY = (0, 130), (0, 100)


def filter_valid(df: DataFrame, mode: str = "drop_lane") -> DataFrame:
    """drop_lane: without invalid lanes, those of unknown (null) validity included; keep: all; drop_period: without detector-periods of
    which any lane is invalid, an unknown one being none."""
    if mode == "keep":
        return df
    if mode == "drop_lane":
        return df.where("valid = 'Y'")
    (bad,) = fresh(df, names=("_bad",))
    period = Window.partitionBy("time", "detector_id")
    return df.withColumn(bad, F.bool_or(F.col("valid") != "Y").over(period)).where(~F.col(bad)).drop(bad)


def in_bounds(speed: tuple = SPEED, occupancy: tuple = OCCUPANCY) -> Column:
    return F.col("speed").between(*speed) & F.col("occupancy").between(*occupancy)


def filter_bounds(df: DataFrame, mode: str = "null", speed: tuple = SPEED, occupancy: tuple = OCCUPANCY) -> DataFrame:
    """null: values out of bounds become null, null ones stay null; drop: their rows go, and those of null values."""
    if mode == "drop":
        return df.where(in_bounds(speed, occupancy))
    return df.withColumn("speed", F.when(F.col("speed").between(*speed), F.col("speed"))).withColumn("occupancy", F.when(F.col("occupancy").between(*occupancy), F.col("occupancy")))


def null_placeholder(df: DataFrame) -> DataFrame:
    """Without vehicles the speed is only the posted limit: null."""
    return df.withColumn("speed", F.when(F.col("volume") != 0, F.col("speed")))


def flag_contradictions(df: DataFrame) -> DataFrame:
    return df.withColumn("still_with_volume", (F.col("speed") == 0) & (F.col("volume") > 0)).withColumn("no_occupancy", F.col("occupancy") == -1)


def stuck_runs(df: DataFrame, keys: list[str], value: str = "speed", over: str = "30 minutes", piece: str = PIECE) -> DataFrame:
    """Adds run (number of the run of equal values within the key) and stuck (whether the run spans more than ``over``).

    Runs are found piece by piece (see ``scans``), with the times of their ends, so that rows don't meet their runs in a join, and a
    detector that is stuck for good is no single group. Columns of these names are replaced. Rows without a time are not stuck.
    """
    df = df.drop("run", "stuck")
    start, end = fresh(df, names=("_first_time", "_last_time"))
    rows = with_runs(df, keys, "time", ["time", "event_id"], value, "run", piece, (start, end))
    long = F.col("time").isNotNull() & (F.col(end) - F.col(start) > F.expr(f"interval {over}"))
    return rows.select(*df.columns, "run", F.coalesce(long, F.lit(False)).alias("stuck"))


def drop_stuck_days(df: DataFrame, keys: list[str], value: str = "speed", over: str = "30 minutes", piece: str = PIECE) -> DataFrame:
    """Without the detector-days that have a stuck run."""
    found = stuck_runs(df, keys, value, over, piece)
    day, bad = fresh(found, names=("_day", "_bad"))
    found = found.withColumn(day, F.to_date("time"))
    return found.withColumn(bad, F.bool_or("stuck").over(Window.partitionBy("detector_id", day))).where(~F.col(bad)).drop(bad, day, "run", "stuck")


def null_stuck(df: DataFrame, keys: list[str], value: str = "speed", over: str = "30 minutes") -> DataFrame:
    """The values of stuck runs become null."""
    return stuck_runs(df, keys, value, over).withColumn(value, F.when(~F.col("stuck"), F.col(value))).drop("run", "stuck")


def robust_z(df: DataFrame, key: str = "detector_id", value: str = "speed", z: float = 3.5, exact: bool = True) -> DataFrame:
    """Adds outlier: |0.6745 (x - median) / MAD| over ``z``; no value is one where the MAD is 0.

    Medians are grouped aggregates that are joined back, so a detector with very many rows is no single window. ``exact=False``
    takes both from sketches (see ``quantiles``), whose size does not grow with a detector's distinct values.
    """
    med, away, mad = fresh(df, names=("_med", "_off", "_mad"))
    medians = df.groupBy(key).agg(middle(value, exact).alias(med))
    off = df.join(medians, key).withColumn(away, F.abs(F.col(value) - F.col(med)))
    spread = off.groupBy(key).agg(middle(away, exact).alias(mad))
    score = F.lit(0.6745) * F.col(away) / F.nullif(F.col(mad), F.lit(0.0))
    return off.join(spread, key).withColumn("outlier", F.coalesce(score > z, F.lit(False))).drop(med, away, mad)


def iqr_filter(df: DataFrame, key: str = "detector_id", value: str = "speed", k: float = 1.5) -> DataFrame:
    """Rows within the quartiles of their key, widened by ``k`` times their distance."""
    low, high = fresh(df, names=("_a", "_b"))
    fences = df.groupBy(key).agg(F.percentile(value, F.lit(0.25)).alias(low), F.percentile(value, F.lit(0.75)).alias(high))
    step = k * (F.col(high) - F.col(low))
    return df.join(fences, key).where(F.col(value).between(F.col(low) - step, F.col(high) + step)).drop(low, high)


def dedup_overlap(df: DataFrame, keys: tuple = ("time", "detector_id", "lane_id"), archived: str = "archived") -> DataFrame:
    """One row per reading: that of the latest snapshot. The maximum is pre-aggregated before the shuffle."""
    rest, (best,) = [c for c in df.columns if c not in keys], fresh(df, names=("_best",))
    kept = df.groupBy(*keys).agg(F.max(F.struct(F.col(archived), *[c for c in rest if c != archived])).alias(best))
    return kept.select(*keys, *[F.col(best)[c].alias(c) for c in rest])


def latest_wins(df: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key: that of the latest version."""
    rest, (best,) = [c for c in df.columns if c not in (key, version)], fresh(df, names=("_best",))
    kept = df.groupBy(key).agg(F.max(F.struct(version, *rest)).alias(best))
    return kept.select(key, *[F.col(best)[c].alias(c) for c in (version, *rest)])


def version_suffix(members: DataFrame, name: str = "name", checksum: str = "checksum", position: str = "position") -> DataFrame:
    """Members without equal copies. The first content under a name keeps it; the k-th different one gets ``_k`` between the
    archive time and the resource's own name (20250805-0001-a.xml, 20250805-0001_2-a.xml), so that it still ends like the others;
    a name without an archive time gets it at the end. A null name is a name of its own and stays null."""
    distinct = members.groupBy(name, checksum).agg(F.min(position).alias(position))
    number = F.row_number().over(Window.partitionBy(name).orderBy(position))
    parts = "(?s)^([0-9]{8}-[0-9]{4}|.*)(.*)$"
    stem, rest = F.regexp_extract(name, parts, 1), F.regexp_extract(name, parts, 2)
    return distinct.withColumn("copy", number).withColumn("stored_as", F.when(F.col("copy") == 1, F.col(name)).otherwise(F.concat(stem, F.lit("_"), F.col("copy").cast("string"), rest)))


def quality_report(df: DataFrame) -> DataFrame:
    """Counts per rule in one pass."""
    flagged = flag_contradictions(df)
    rules = {
        "n_rows": F.lit(True),
        "n_invalid": F.col("valid") != "Y",
        "n_speed_out": ~F.col("speed").between(*SPEED),
        "n_occupancy_out": ~F.col("occupancy").between(*OCCUPANCY),
        "n_placeholder": F.col("volume") == 0,
        "n_still_with_volume": F.col("still_with_volume"),
        "n_no_occupancy": F.col("no_occupancy"),
    }
    return flagged.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])


def repeat_report(df: DataFrame, keys: tuple = ("time", "detector_id", "lane_id"), stated: str | None = None, dated: str | None = None) -> DataFrame:
    """(n_rows, n_duplicate, n_redated): rows beyond the first of their keys, nulls being equal, and rows whose ``stated`` date
    isn't the ``dated`` one (0 where these are not named; a null on one side alone counts as re-dated)."""
    moved = ~F.col(stated).eqNullSafe(F.col(dated)) if stated and dated else F.lit(False)
    held = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(moved).alias("m"))
    zero = F.lit(0).cast("long")
    return held.agg(F.coalesce(F.sum("n"), zero).alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), zero).alias("n_duplicate"), F.coalesce(F.sum("m"), zero).alias("n_redated"))
