"""Splits by episode, the congestion model and importances, reject tables, repeats and the bundle sink on small rows."""

import tempfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormlane.operators import cleaning, intervals, study
from stormlane.plans.queries import _FEATURES, _learnable
from stormlane.plans.views import Views
from stormlane.sources import bundles, parse

SF = "/root/testdata/sf0.001"


def test_an_episode_is_in_one_fold(spark):
    v = Views(spark, SF)
    episodes = intervals.merge_intervals(v.signals)
    rows = study.split_by_episode(v.readings, episodes).select("event_id", "time", "episode_id", "fold").collect()
    assert len(rows) == v.readings.count() and {r.fold for r in rows} == {0, 1, 2}
    held = [(e.start, e.end, e.episode_id) for e in episodes.collect()]
    for r in rows:
        own = [i for a, b, i in held if a <= r.time < b]
        assert [r.episode_id] == (own or [None])
        assert r.fold == (own[0] if own else (r.time.date() - datetime(1970, 1, 1).date()).days) % 3


def test_split_of_nulls_and_of_no_rows(spark):
    times = spark.createDataFrame([(1, None), (2, datetime(2024, 1, 1))], "id int, time timestamp_ntz")
    none = spark.createDataFrame([], "start timestamp_ntz, end timestamp_ntz, episode_id int")
    got = {r.id: (r.episode_id, r.fold) for r in study.split_by_episode(times, none).collect()}
    assert got == {1: (None, None), 2: (None, 19723 % 3)}
    assert study.split_by_episode(times.limit(0), none).count() == 0


def test_congestion_model_is_the_maximum_of_the_likelihood(spark):
    rows = _learnable(Views(spark, SF)).withColumn("fold", F.col("event_id") % 3).cache()
    scored = study.congestion(rows.where("fold > 0"), rows.where("fold = 0"), _FEATURES).select("event_id", "p_congested", "congested").collect()
    data = {f: np.array([[r[c] for c in _FEATURES] + [1.0] for r in rows.where(f).orderBy("event_id").collect()]) for f in ("fold > 0", "fold = 0")}
    y = np.array([float(r.ratio < 0.7) for r in rows.where("fold > 0").orderBy("event_id").collect()])
    x, w = data["fold > 0"], np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    want = 1 / (1 + np.exp(-data["fold = 0"] @ w))
    got = sorted(scored)
    assert len(got) == len(want) and np.allclose([r.p_congested for r in got], want, atol=1e-4)
    assert all(r.congested == (r.p_congested > 0.5) for r in got)


def test_class_scores_against_plain_counts(spark):
    pairs = [(True, True)] * 3 + [(True, False)] * 2 + [(False, True)] + [(False, False)] * 4
    df = spark.createDataFrame(pairs, "a boolean, b boolean")
    got = study.class_scores(df, F.col("a"), F.col("b")).first()
    assert (got.n, got.n_true, got.accuracy, round(got.f1, 6)) == (10, 5, 0.7, round(6 / 9, 6))
    empty = study.class_scores(df.limit(0), F.col("a"), F.col("b")).first()
    assert (empty.n, empty.n_true, empty.accuracy, empty.f1) == (0, 0, None, None)


def test_importance_lies_on_what_decides(spark):
    df = spark.range(400).select((F.col("id") % 2).cast("double").alias("a"), F.lit(1.0).alias("b"), (F.col("id") % 2 * 3).cast("double").alias("y"))
    got = {r.feature: r.importance for r in study.importances(df, ["a", "b"], "y").collect()}
    assert got["a"] == pytest.approx(1.0) and got["b"] == 0.0


def test_sensitivity_by_place_takes_each_rows_own_baseline(spark):
    rows = spark.createDataFrame([(1, "x", 0, 10.0), (1, "x", 1, 5.0), (2, "x", 0, 100.0), (2, "x", 1, 90.0), (3, "y", 0, 0.0), (3, "y", 2, 4.0)], "detector_id int, road string, level int, speed double")
    base = study.dry_baseline(rows.where("level = 0"), ["detector_id"])
    got = {(r.road, r.level): (r.n, r.sensitivity) for r in study.sensitivity(rows, base, ["detector_id"], by=["road"]).collect()}
    assert got[("x", 1)] == (2, pytest.approx(-0.3)) and got[("y", 2)] == (1, None)


def test_sensitivity_in_one_pass_equals_that_of_ratios(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 97 == 0, None).otherwise(F.col("id") % 11).alias("detector_id"),
        F.when(F.col("id") % 89 == 0, None).otherwise((F.col("id") % 13 % 4).cast("int")).alias("level"),
        F.when(F.col("id") % 7 == 0, None).otherwise(F.pmod(F.xxhash64("id"), F.lit(997)) / 10.0 - 20).alias("speed"),
        F.lit("other").alias("_dry"),
    )
    rows = rows.where("detector_id is null or detector_id <> 4 or level > 0")  # 4 has no dry rows
    rows = rows.withColumn("speed", F.expr("case when detector_id = 5 and level = 0 then 0.0 when detector_id = 6 and level = 0 then null else speed end"))
    base = study.dry_baseline(rows.where("level = 0"), ["detector_id"])
    want = {(r.detector_id, r.level): (r.n, r.sensitivity) for r in study.sensitivity(rows, base, ["detector_id"]).collect()}
    got = {(r.detector_id, r.level): (r.n, r.sensitivity) for r in study.sensitivity_by_level(rows, ["detector_id"]).collect()}
    assert got.keys() == want.keys() and not any(d == 4 for d, _ in got)
    for key, (n, figure) in want.items():
        assert got[key] == (n, None if figure is None else pytest.approx(figure, rel=1e-9))
    assert got[(5, 1)][1] is None and got[(6, 1)][1] is None
    assert study.sensitivity_by_level(rows.limit(0), ["detector_id"]).collect() == []


def test_rejected_cyclone_lines_and_counts(spark):
    good = "\t".join(["1", "T", "A", "8", "NE", "0100", "2", "1", "2024", "x", "0200", "2", "1", "2024", "1"])
    files = spark.createDataFrame([("a", f"{good}\n{good.replace('	T	', '	MSN	')}\nshort\t1\n\n"), ("b", ""), ("c", None)], "file string, content string")
    assert sorted((r.file, r.reason) for r in parse.tc_rejects(files).collect()) == [("a", "fields"), ("a", "intensity")]
    assert sorted(tuple(r) for r in parse.tc_counters(files, "file").collect()) == [("a", 1, 2), ("b", 0, 0), ("c", 0, 0)]
    assert parse.read_tc(files).count() == 1


def test_repeats_and_redated_rows(spark):
    rows = spark.createDataFrame([(1, "a", "x", "d", "d"), (1, "a", "x", "d", "e"), (1, None, "x", "d", None), (1, None, "x", None, None)], "time int, detector_id string, lane_id string, s string, t string")
    assert tuple(cleaning.repeat_report(rows, stated="s", dated="t").first()) == (4, 2, 2)
    assert tuple(cleaning.repeat_report(rows.limit(0)).first()) == (0, 0, 0)


def test_bundles_written_are_read_back(spark):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("f/20240501-0000-x.xml", "one")
    files = spark.createDataFrame([("a", out.getvalue()), (None, b"x"), ("b", None)], "bundle string, content binary")
    folder = bundles.write_bundles(files, "file:" + tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/z")
    assert [(r.bundle, bytes(r.content)) for r in bundles.read_bundles(spark, folder, ".xml").collect()] == [("a.zip", b"one")]
    with pytest.raises(ValueError):
        bundles.write_bundles(files, "s3://somewhere/z")


def test_ranks_are_those_of_a_sorted_list(spark):
    import random

    random.seed(3)
    data = [(k, random.choice("ab"), random.choice([float(random.randint(-9, 9)), random.random()])) for k in range(700)] + [(700, "a", None), (701, "c", 1.0)]
    df = spark.createDataFrame(data, "id int, g string, v double")
    for buckets in (2, 7, 200):
        mean = {r.id: r.place for r in study.ranks(df, "v", "place", ("g",), buckets=buckets).collect()}
        least = {r.id: r.place for r in study.ranks(df, "v", "place", ties="min", buckets=buckets).collect()}
        some = [r for r in data if r[2] is not None]
        assert set(mean) == set(least) == {r[0] for r in some}
        for k, g, x in some:
            own = [r[2] for r in some if r[1] == g]
            assert mean[k] == sum(y < x for y in own) + (sum(y == x for y in own) + 1) / 2
            assert least[k] == sum(r[2] < x for r in some) + 1
    assert study.ranks(df.limit(0), "v", "place").count() == 0


def test_models_without_rows_or_with_one_class(spark):
    df = spark.createDataFrame([(1.0, 0.9), (2.0, 0.8), (None, 0.1), (3.0, None)], "a double, ratio double")
    none = df.limit(0)
    assert {(r.p_congested, r.congested) for r in study.congestion(none, df, ["a"]).collect()} == {(None, None)}
    assert [r.prediction for r in study.fit_and_score(none, df, ["a"], "ratio").collect()] == [None] * 3
    assert [tuple(r) for r in study.importances(none, ["a"], "ratio").collect()] == [("a", None)]
    assert [r.congested for r in study.congestion(df, df, ["a"]).collect()] == [0, 0, 0]
    assert [r.congested for r in study.congestion(df.where("ratio < 0.5").fillna(0.0), df, ["a"]).collect()] == [1, 1, 1]


def test_rows_to_learn_from_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(200).selectExpr("cast(id % 5 as double) as a", "cast(id % 3 as double) as b", "cast(id % 5 as double) * 2 as y").mapInArrow(seen, "a double, b double, y double")
    found = {r.feature: r.importance for r in study.importances(rows, ["a", "b"], "y").collect()}
    assert made.value == 200 and found["a"] > 0.9
