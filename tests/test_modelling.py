"""Configurations, the tree they share, lines over folds, and quantile sketches."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormlane.operators import cleaning, modelling, study
from stormlane.operators.modelling import Config
from stormlane.plans.queries import _Study, _district_folds
from stormlane.plans.views import Views

SF = "/root/testdata/sf0.001"


class Asked(_Study):
    """Notes which tables a table is built from."""

    def __init__(self, v):
        super().__init__(v)
        self.names = set()

    def __getattribute__(self, name):
        if name in ("readings", "detectors", "signals", "rain", "holidays", "cyclones"):
            self.names.add(name)
        return super().__getattribute__(name)


@pytest.mark.parametrize("bad", [{"fill": "other"}, {"minutes": 7}, {"minutes": 0}, {"rain": "none", "rain_lags": (1,)}, {"rain": "territory", "rain_align": "ffill"}, {"rain_lags": (0,)}, {"warning": None}])
def test_wrong_configurations_are_refused(bad):
    with pytest.raises(ValueError):
        Config(**bad)


@pytest.mark.parametrize(("changes", "tables"), [
    ({"rain": "none", "calendar": "none", "warning": "ignore", "normalise": "raw"}, {"readings"}),
    ({"rain": "none", "calendar": "none", "warning": "ignore"}, {"readings", "detectors", "signals"}),
    ({"rain": "territory", "calendar": "none", "warning": "ignore", "normalise": "zscore"}, {"readings", "rain"}),
    ({"rain": "none", "warning": "ignore", "normalise": "prev_week", "confounders": "drop"}, {"readings", "holidays", "cyclones"}),
    ({}, {"readings", "detectors", "signals", "rain", "holidays"}),
])
def test_tables_that_are_not_needed_are_not_in_the_plan(spark, changes, tables):
    inputs = Asked(Views(spark, SF))
    df = modelling.model_table(Config(minutes=360, **changes), inputs)
    assert inputs.names == tables
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # nation is only read for districts; readings alone come from one scan of events
    assert ("n_name" in plan) == bool(tables & {"detectors", "rain"})
    if tables == {"readings"}:
        assert "Join" not in plan


@pytest.mark.parametrize("changes", [{"validity": "drop_period"}, {"bounds": "null", "placeholder": "keep"}, {"bounds": "none"}, {"stuck": "null"}, {"stuck": "drop_day"}, {"outliers": "robust"}, {"outliers": "iqr"}, {"lanes": "mean"}, {"fill": "seasonal"}, {"confounders": "feature"}, {"warning": "binary"}, {"rain_align": "slots", "rain_lags": (1,)}, {"rain_align": "linear"}, {"rain": "min"}])
def test_every_way_gives_a_table(spark, changes):
    df = modelling.model_table(Config(minutes=360, **changes), _Study(Views(spark, SF)))
    assert {"detector_id", "bin", "speed", "y"} <= set(df.columns) and df.where("speed is null").count() == 0
    assert df.groupBy("detector_id", "bin").count().where("count > 1").count() == 0 and df.count() > 0


def test_common_steps_are_built_once(spark, monkeypatch):
    written, kept = [], modelling.kept
    monkeypatch.setattr(modelling, "kept", lambda df: written.append(df.columns) or kept(df))
    inputs = _Study(Views(spark, SF))
    base = {"minutes": 360, "calendar": "none", "rain": "none"}
    configs = {"a": Config(**base), "b": Config(**base | {"fill": "ffill"}), "c": Config(**base | {"fill": "linear"}), "d": Config(**base | {"normalise": "raw"}), "e": Config(**base)}
    tables = modelling.model_tables(configs, inputs)
    inputs_written = [c for c in written if "bin" not in c]
    assert len(inputs_written) == 2  # detectors and signals
    assert len(written) - len(inputs_written) == 2  # the bins, before filling; the filled bins of a, d and e, before what the baseline needs
    assert tables["a"] is tables["e"]
    for name, df in tables.items():
        alone = modelling.model_table(configs[name], inputs)
        assert df.exceptAll(alone).count() == alone.exceptAll(df).count() == 0


def test_ablation_needs_levels(spark):
    with pytest.raises(ValueError):
        modelling.ablate({"a": Config(warning="binary")}, _Study(Views(spark, SF)), "a")


def test_lines_over_folds_equal_least_squares(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3)) * [1, 100, 0.01] + [5, 0, 1]
    y, fold = x @ [2.0, -0.3, 40.0] + 7 + rng.normal(size=200), rng.integers(0, 4, 200)
    rows = [(int(f), *map(float, r), float(v)) for f, r, v in zip(fold, x, y)] + [(1, None, 1.0, 1.0, 2.0), (2, 1.0, 1.0, 1.0, None), (None, 1.0, 2.0, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "fold int, a double, b double, c double, y double")
    found, lines = study.linear_cv(df, "y", ["a", "b", "c"])
    for f in range(4):
        design = np.column_stack([np.ones(200), x])[fold != f]
        assert np.allclose(lines[f], np.linalg.lstsq(design, y[fold != f], rcond=None)[0], rtol=1e-6)
    for r in found.collect():
        known = None not in (r.fold, r.a, r.b, r.c)
        assert (r.prediction is not None) == known and (not known or abs(r.prediction - np.dot(lines[r.fold], [1, r.a, r.b, r.c])) < 1e-9)


def test_lines_that_rows_do_not_determine(spark):
    df = spark.createDataFrame([(k % 3, float(k), 2.0 * k, 1.0, float(k)) for k in range(30)], "fold int, a double, b double, c double, y double")
    for features in (["a", "b"], ["a", "c"], ["c"]):
        found, lines = study.linear_cv(df, "y", features)
        assert lines == {0: None, 1: None, 2: None} and found.where("prediction is not null").count() == 0
    assert study.linear_cv(df.where("fold = 0"), "y", ["a"])[1] == {0: None}
    empty, lines = study.linear_cv(df.limit(0), "y", ["a"])
    assert lines == {} and empty.collect() == []


def test_episodes_of_a_district_are_in_one_fold(spark):
    v = Views(spark, SF)
    rows = _district_folds(v, v.readings.join(v.detectors.select("detector_id", "district"), "detector_id"))
    spread = rows.where("episode_id is not null").groupBy("district", "episode_id").agg(F.count_distinct("fold").alias("n"))
    assert spread.count() > 5 and spread.where("n > 1").count() == 0 and rows.count() == v.readings.count()


def test_sketches_of_days_merge_within_their_error(spark):
    """A third of a million rows of one detector over forty days: quantiles of any period within 2 % of their rank, sketches small."""
    n = 300_000
    rows = spark.range(n).select(F.lit(1).alias("detector_id"), F.timestamp_add("MINUTE", (F.col("id") % 57_600).cast("int"), F.lit(dt.datetime(2024, 1, 1))).alias("time"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("speed"))
    kept = study.kept(study.daily_sketches(rows, ["detector_id"], k=400))
    assert kept.count() == 40 and kept.agg(F.max(F.length("sketch"))).first()[0] < 20_000
    for where in (None, F.col("date") < F.lit("2024-01-08").cast("date")):
        got = study.sketched_quantiles(kept, ["detector_id"], {"low": 0.1, "mid": 0.5, "high": 0.95}, where).first()
        some = rows if where is None else rows.withColumn("date", F.to_date("time")).where(where)
        assert got.n == some.count()
        for name, share in (("low", 0.1), ("mid", 0.5), ("high", 0.95)):
            assert abs(some.where(F.col("speed") <= got[name]).count() / got.n - share) < 0.02


def test_sketches_of_few_rows_are_exact(spark):
    rng = random.Random(2)
    rows = [(k % 5, dt.datetime(2024, 1, 1 + k % 9), rng.choice([None, float("nan"), rng.random()])) for k in range(300)]
    sketches = study.daily_sketches(spark.createDataFrame(rows, "detector_id int, time timestamp_ntz, speed double"), ["detector_id"])
    for r in study.sketched_quantiles(sketches, ["detector_id"], {"mid": 0.5}).collect():
        own = sorted(s for d, _, s in rows if d == r.detector_id and s is not None and s == s)
        assert r.n == len(own) and r.mid == own[-(-len(own) // 2) - 1]


def test_outliers_and_sensitivity_by_sketches_are_near_the_exact_ones(spark):
    value = F.pmod(F.xxhash64("id"), F.lit(1001)).cast("double")
    rows = spark.range(60_000).select((F.col("id") % 2).alias("detector_id"), (F.col("id") % 3 % 2).cast("int").alias("level"), F.when(F.col("id") % 500 == 0, 1e5).when(F.col("id") % 501 == 0, None).otherwise(value + F.col("id") % 3 * 50).alias("speed"))
    exact, near = (cleaning.robust_z(rows, exact=e).groupBy("outlier").count().collect() for e in (True, False))
    assert sorted(map(tuple, exact)) == sorted(map(tuple, near))
    found = []
    for e in (True, False):
        base = study.dry_baseline(rows.where("level = 0"), ["detector_id"], exact=e)
        found.append({(r.detector_id, r.level): (r.n, r.sensitivity) for r in study.sensitivity(rows, base, ["detector_id"], exact=e).collect()})
    for key, (n, sensitivity) in found[0].items():
        assert found[1][key][0] == n and abs(found[1][key][1] - sensitivity) < 0.05
    nothing = rows.withColumn("speed", F.lit(None).cast("double"))
    assert {r.outlier for r in cleaning.robust_z(nothing.limit(5), exact=False).collect()} == {False}


def test_congestion_is_tried_on_held_out_episodes(spark):
    from stormlane.plans.queries import QUERIES

    got = {r.model: r for r in QUERIES["congestion_eval"](spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == {"all", "time only"} and got["all"].n == got["time only"].n > 500
    assert got["all"].n_true > 0 and got["all"].accuracy >= 0.5
