"""Modelling tables built from a configuration, and ablations over many configurations that share their common steps.

A configuration names a way for each step of the plan: cleaning, lanes, bins, filling, confounders, warnings, rain, calendar and
normalisation. Steps run in one order, and a step whose way needs no table doesn't touch one, so what a configuration leaves out is
neither read nor joined. Several configurations form a tree: as far as they agree they are one plan, and where they part what they have
in common is written once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, fields
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormlane.operators import align, cleaning, study
from stormlane.operators.intervals import encode_warning
from stormlane.operators.scans import fresh
from stormlane.sources.tables import kept

#: The ways of each step, the plan's default first.
WAYS = {
    "validity": ("drop_lane", "keep", "drop_period"),
    "bounds": ("drop", "null", "none"),
    "placeholder": ("null", "keep"),
    "stuck": ("keep", "null", "drop_day"),
    "outliers": ("none", "robust", "iqr"),
    "lanes": ("weighted", "mean", "slowest"),
    "fill": ("none", "linear", "ffill", "seasonal"),
    "confounders": ("keep", "drop", "feature"),
    "warning": ("ordinal", "onehot", "binary", "ignore"),
    "rain": ("mid", "min", "max", "territory", "none"),
    "rain_align": ("hour", "slots", "ffill", "linear"),
    "calendar": ("day_type", "none"),
    "normalise": ("ratio", "raw", "zscore", "prev_week"),
}


@dataclass(frozen=True)
class Config:
    """One way per step; a value that isn't one of ``WAYS``, or that contradicts another, is refused."""

    validity: str = "drop_lane"
    bounds: str = "drop"
    placeholder: str = "null"
    stuck: str = "keep"
    outliers: str = "none"
    lanes: str = "weighted"
    minutes: int = 15
    fill: str = "none"
    confounders: str = "keep"
    warning: str = "ordinal"
    rain: str = "mid"
    rain_align: str = "hour"
    rain_lags: tuple[int, ...] = ()
    calendar: str = "day_type"
    normalise: str = "ratio"

    def __post_init__(self):
        for name, ways in WAYS.items():
            if getattr(self, name) not in ways:
                raise ValueError(f"{name} is {getattr(self, name)!r}, not one of {', '.join(ways)}")
        if not isinstance(self.minutes, int) or self.minutes < 1 or 1440 % self.minutes:
            raise ValueError(f"bins of {self.minutes} minutes don't divide a day")
        if any(not isinstance(k, int) or k < 1 for k in self.rain_lags):
            raise ValueError("rain_lags are whole hours from 1")
        if self.rain in ("none", "territory") and (self.rain_lags or self.rain_align != "hour"):
            raise ValueError(f"rain {self.rain} has neither lags nor another alignment")


class Inputs(Protocol):
    """The tables; only those that a configuration needs are asked for. signals may have a district, else they hold everywhere."""

    readings: DataFrame
    detectors: DataFrame
    signals: DataFrame
    rain: DataFrame
    holidays: DataFrame
    cyclones: DataFrame


class _Written:
    """Inputs of several tables: those beside the readings are written when first asked for, and read from there."""

    def __init__(self, inputs: Inputs):
        self.inputs = inputs
        self.readings = inputs.readings

    def __getattr__(self, name: str) -> DataFrame:
        found = kept(getattr(self.inputs, name))
        setattr(self, name, found)
        return found


def _bounds(df: DataFrame, c: Config, t: Inputs) -> DataFrame:
    df = df if c.bounds == "none" else cleaning.filter_bounds(df, c.bounds)
    return cleaning.null_placeholder(df) if c.placeholder == "null" else df


def _stuck(df: DataFrame, c: Config, t: Inputs) -> DataFrame:
    keys = ["detector_id", "lane_id"]
    return {"keep": lambda: df, "null": lambda: cleaning.null_stuck(df, keys), "drop_day": lambda: cleaning.drop_stuck_days(df, keys)}[c.stuck]()


def _outliers(df: DataFrame, c: Config, t: Inputs) -> DataFrame:
    return {"none": lambda: df, "robust": lambda: cleaning.robust_z(df).where("not outlier").drop("outlier"), "iqr": lambda: cleaning.iqr_filter(df)}[c.outliers]()


def _fill(df: DataFrame, c: Config, t: Inputs) -> DataFrame:
    key, step = ["detector_id"], f"{c.minutes} minutes"
    if c.fill == "linear":
        df = align.fill_linear(df, key, "bin", "speed", step)
    elif c.fill != "none":
        df = align.fill(df, key, "bin", "speed", step, c.fill, align.weekly_slot("bin", c.minutes))
    return (df if c.fill == "none" else df.withColumn("speed", F.col("filled")).drop("filled")).where("speed is not null")


def _needs_level(c: Config) -> bool:
    return c.warning != "ignore" or c.normalise == "ratio"


def _warning(df: DataFrame, c: Config, t: Inputs) -> DataFrame:
    """Adds the district where anything needs it, and the warning; the level is there wherever the baseline needs it."""
    if c.rain not in ("none", "territory") or _needs_level(c):
        df = df.join(align.sized(t.detectors.select("detector_id", "district")), "detector_id", "left")
    if not _needs_level(c):
        return df
    out = encode_warning(df, t.signals, {"district": "district"} if "district" in t.signals.columns else None, "bin")
    added = {"ordinal": ["minutes_since"], "onehot": ["is_amber", "is_red", "is_black"], "binary": ["warned"], "ignore": []}[c.warning]
    return out.select(*df.columns, "level", *added)


def _rain(df: DataFrame, c: Config, t: Inputs) -> DataFrame:
    if c.rain == "none":
        return df
    hour, at = fresh(df, names=("hour", "_rain_hour"))
    df = df.withColumn("hour", F.date_trunc("hour", "bin").cast("timestamp_ntz"))
    if c.rain == "territory":
        return align.territory_join(df, t.rain).withColumnRenamed("territory_rain", "rain").drop("hour")
    if c.rain_align == "hour":
        out = align.rain_join(df, t.rain, c.rain).withColumn("rain", F.col("rain").cast("double"))
    else:
        slot = F.expr("hour + make_dt_interval(0, 0, 15 * floor(minute(bin) / 15))")
        slots = align.align_rain(t.rain, c.rain_align, c.rain).select("district", F.col("slot").alias(at), F.col("rain").cast("double").alias("rain"))
        out = df.withColumn(at, slot).join(slots, ["district", at], "left").drop(at)
    for k in c.rain_lags:
        before = t.rain.select("district", (F.col("hour") + F.expr(f"interval {k} hours")).alias("hour"), align.rain_value(c.rain).cast("double").alias(f"rain_{k}"))
        out = out.join(before, ["district", "hour"], "left")
    return out.drop("hour")


def _normalise(df: DataFrame, c: Config, t: Inputs) -> DataFrame:
    """Adds y: the speed over its detector's dry median (rows without one are left out), the speed itself, its z-score, or its
    ratio to the week before."""
    if c.normalise == "ratio":
        out = df.join(study.dry_baseline(df.where("level = 0"), ["detector_id"]), "detector_id").withColumn("y", F.col("speed") / F.nullif(F.col("baseline"), F.lit(0.0))).drop("baseline")
        return out.drop("level") if c.warning in ("ignore", "onehot", "binary") else out
    if c.normalise == "raw":
        return df.withColumn("y", F.col("speed"))
    return study.normalise(df, how=c.normalise).withColumnRenamed("z" if c.normalise == "zscore" else "ratio", "y")


#: The steps in order: the fields each reads, and what it does to the rows.
STEPS: list[tuple[tuple[str, ...], Callable[[DataFrame, Config, Any], DataFrame]]] = [
    (("validity",), lambda df, c, t: cleaning.filter_valid(df, c.validity)),
    (("bounds", "placeholder"), _bounds),
    (("stuck",), _stuck),
    (("outliers",), _outliers),
    (("lanes",), lambda df, c, t: align.lanes_to_detector(df, c.lanes)),
    (("minutes",), lambda df, c, t: align.bin_time(df, c.minutes)),
    (("fill",), _fill),
    (("confounders",), lambda df, c, t: df if c.confounders == "keep" else align.exclude_days(df, t.holidays, t.cyclones, c.confounders, "bin")),
    (("warning", "rain", "normalise"), _warning),
    (("rain", "rain_align", "rain_lags"), _rain),
    (("calendar",), lambda df, c, t: df if c.calendar == "none" else align.calendar_join(df, t.holidays, "bin")),
    (("normalise",), _normalise),
]
assert {f for names, _ in STEPS for f in names} == {f.name for f in fields(Config)}


def model_table(config: Config, inputs: Inputs) -> DataFrame:
    """One row per detector and bin with a speed: detector_id, bin, n, volume, speed, occupancy, what the configuration adds, and y.

    Detectors without a district are under no warning and have no rain; an empty table of readings gives no rows.
    """
    df = inputs.readings
    for _, step in STEPS:
        df = step(df, config, inputs)
    return df


def model_tables(configs: dict[str, Config], inputs: Inputs) -> dict[str, DataFrame]:
    """The table of each configuration. Plans are shared up to where configurations part, and written there, once each; so are the
    tables beside the readings, which several of them join."""
    inputs = _Written(inputs) if len(configs) > 1 else inputs
    paths = {name: [tuple(getattr(c, f) for f in names) for names, _ in STEPS] for name, c in configs.items()}
    below = defaultdict(set)
    for path in paths.values():
        for k in range(len(path)):
            below[tuple(path[:k])].add(path[k])
    built: dict[tuple, DataFrame] = {(): inputs.readings}
    for name, path in paths.items():
        for k, (_, step) in enumerate(STEPS):
            here, there = tuple(path[:k]), tuple(path[: k + 1])
            if there not in built:
                df = step(built[here], configs[name], inputs)
                built[there] = kept(df) if len(below[there]) > 1 else df
    return {name: built[tuple(path)] for name, path in paths.items()}


def ablate(configs: dict[str, Config], inputs: Inputs, default: str, k: int = 20, limit: float = 0.7) -> DataFrame:
    """What each configuration does to the study: (variant, n, spearman, n_common, n_rows, mae, f1).

    Detectors are ranked by the mean over warning levels of their median y; n of them are ranked by this and by the ``default``, with
    Spearman's correlation, and n_common are in the first ``k`` of both. mae is that of guessing y by the mean of its level, hour of
    day and whether it rains; f1 is about y below ``limit``, null where y is no ratio. Configurations must have an ordinal warning.
    """
    if wrong := [name for name, c in configs.items() if c.warning != "ordinal"]:
        raise ValueError(f"an ablation needs levels: {', '.join(wrong)}")
    parts = []
    for name, df in model_tables(configs, inputs).items():
        wet = F.coalesce(F.col("rain") > 0, F.lit(False)) if configs[name].rain != "none" else F.lit(False)
        ratio = configs[name].normalise in ("ratio", "prev_week")
        parts.append(df.where("y is not null").select(F.lit(name).alias("variant"), F.lit(ratio).alias("ratio"), "detector_id", "level", F.hour("bin").alias("hour"), wet.alias("wet"), "y"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = kept(rows)
    scores = rows.where("level > 0").groupBy("variant", "detector_id", "level").agg(F.median("y").alias("m")).groupBy("variant", "detector_id").agg(F.avg("m").alias("x"))
    ranked = study.compared(kept(scores), list(configs), default, k)
    same = ["variant", "level", "hour", "wet"]
    guess = align.sized(rows.groupBy(*same).agg(F.avg("y").alias("guess")))
    hit, said = F.col("ratio") & (F.col("y") < limit), F.col("ratio") & (F.col("guess") < limit)
    tp, fp, fn = F.count_if(hit & said), F.count_if(~hit & said), F.count_if(hit & ~said)
    errors = rows.join(guess, same).groupBy("variant").agg(F.count("*").alias("n_rows"), F.avg(F.abs(F.col("y") - F.col("guess"))).alias("mae"), (2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0))).alias("f1"))
    return ranked.join(errors, "variant", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
