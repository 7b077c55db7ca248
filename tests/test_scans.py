"""Scans over split histories against plain loops; one key holds nearly all rows, and pieces of several sizes give the same."""

import datetime as dt
import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from stormlane.operators import align, cleaning, intervals, scans

T0 = dt.datetime(2024, 5, 1)
PIECES = ("hour", "day", "month")


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def history(n=900, seed=1):
    """(event_id, detector_id, time, speed): detector 1 has nearly all; ties in time, nulls, a gap of days and a null detector."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        detector = rng.choice([1] * 40 + [2, 3, None])
        rows.append((i, detector, at(rng.choice([0, 7000]) + 5 * rng.randrange(500)), rng.choice([None, 50.0, 50.0, 50.0, 61.5])))
    rows += [(n + k, 4, at(20 * k), 33.0) for k in range(400)]  # stuck for days on end
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "event_id int, detector_id int, time timestamp_ntz, speed double, _piece string, _known int")


@pytest.mark.parametrize("piece", PIECES)
def test_stuck_runs_equal_a_loop(spark, piece):
    rows, want = history(), {}
    order = lambda r: (-1 if r[1] is None else r[1], r[2], r[0])
    for _, own in groupby(sorted(rows, key=order), key=lambda r: r[1]):
        for run, (_, same) in enumerate(groupby(own, key=lambda r: r[3]), 1):
            same = list(same)
            for r in same:
                want[r[0]] = (run, same[-1][2] - same[0][2] > dt.timedelta(minutes=30))
    found = cleaning.stuck_runs(frame(spark, rows), ["detector_id"], piece=piece)
    assert found.columns == ["event_id", "detector_id", "time", "speed", "_piece", "_known", "run", "stuck"]
    assert {r.event_id: (r.run, r.stuck) for r in found.collect()} == want and found.count() == len(rows)
    assert cleaning.stuck_runs(frame(spark, rows).limit(0), ["detector_id"]).collect() == []


def test_stuck_values_become_null_or_their_days_go(spark):
    rows = [(k, 1, at(10 * k), 50.0 if k < 5 else float(k)) for k in range(8)] + [(9, 1, at(3000), 50.0)]
    assert {r.event_id: r.speed for r in cleaning.null_stuck(frame(spark, rows), ["detector_id"]).collect()} == {k: None if k < 5 else float(k) for k in range(8)} | {9: 50.0}
    assert [r.event_id for r in cleaning.drop_stuck_days(frame(spark, rows), ["detector_id"]).collect()] == [9]


@pytest.mark.parametrize("piece", PIECES)
def test_fills_equal_a_loop(spark, piece):
    rng, bins = random.Random(3), {}
    for key in (1, 2):
        for k in sorted(rng.sample(range(1200), 250 if key == 1 else 6)):
            bins[key, k] = rng.choice([None, round(rng.uniform(10, 90), 1)])
    df = spark.createDataFrame([(d, at(15 * k), v) for (d, k), v in bins.items()], "detector_id int, bin timestamp_ntz, speed double")
    linear = {(r.detector_id, r.bin): r.filled for r in align.fill_linear(df, ["detector_id"], "bin", "speed", "15 minutes", 2, piece).collect()}
    forward = {(r.detector_id, r.bin): r.filled for r in align.fill(df, ["detector_id"], "bin", "speed", "15 minutes", piece=piece).collect()}
    n = 0
    for key in (1, 2):
        own = [k for d, k in bins if d == key]
        known = sorted(k for k in own if bins[key, k] is not None)
        for k in range(min(own), max(own) + 1):
            back, ahead = [j for j in known if j <= k], [j for j in known if j >= k]
            assert forward[key, at(15 * k)] == (bins[key, back[-1]] if back else None)
            want = bins.get((key, k))
            if want is None and back and ahead and ahead[0] - back[-1] - 1 <= 2:
                a, b = bins[key, back[-1]], bins[key, ahead[0]]
                want = a + (b - a) * (k - back[-1]) / (ahead[0] - back[-1])
            assert linear[key, at(15 * k)] == pytest.approx(want) if want is not None else linear[key, at(15 * k)] is None
            n += 1
    assert len(linear) == len(forward) == n


def test_seasonal_fill_by_weekday_type_and_bin(spark):
    saturday = dt.datetime(2024, 5, 4)
    rows = [(1, saturday + dt.timedelta(days=d, hours=9), v) for d, v in ((0, 10.0), (1, 20.0), (2, 70.0), (3, None), (4, 90.0), (7, None), (8, None), (9, None))]
    df = spark.createDataFrame(rows, "detector_id int, bin timestamp_ntz, speed double")
    got = {r.bin: r.filled for r in align.fill(df, ["detector_id"], "bin", "speed", "15 minutes", "seasonal", align.weekly_slot("bin")).collect()}
    day = lambda d: got[saturday + dt.timedelta(days=d, hours=9)]
    assert (day(3), day(7), day(8), day(9)) == (80.0, 15.0, 15.0, 80.0) and got[saturday + dt.timedelta(hours=10)] is None
    with pytest.raises(ValueError):
        align.fill(df, ["detector_id"], "bin", "speed", "15 minutes", "other")


@pytest.mark.parametrize("piece", PIECES)
def test_versions_in_force_equal_a_loop(spark, piece):
    rng = random.Random(5)
    versions = [(rng.choice([1, 1, 1, 2]), at(60 * k), f"v{k}") for k in rng.sample(range(300), 40)]
    rows = [(i, rng.choice([1] * 9 + [2, 3, None]), at(60 * rng.randrange(-20, 320))) for i in range(400)]
    a = spark.createDataFrame([(*r, "x") for r in rows], "id int, k int, t timestamp_ntz, _version string")
    b = spark.createDataFrame(versions, "k int, since timestamp_ntz, v string")
    got = {r.id: (r.since, r.v) for r in align.asof_version(a, b, "k", "t", "since", "v", piece).collect()}
    for i, k, t in rows:
        assert got[i] == max(((s, v) for key, s, v in versions if key == k and s <= t), default=(None, None))
    assert len(got) == len(rows)


def plain_merge(rows, gap):
    out = []
    for a, b, level, provisional in sorted(rows, key=lambda r: (r[0], r[1])):
        if out and a <= out[-1][1] + gap:
            out[-1][1:] = [max(out[-1][1], b), max(out[-1][2], level), out[-1][3] + 1, out[-1][4] or provisional]
        else:
            out.append([a, b, level, 1, provisional])
    return [tuple(r) for r in out]


@pytest.mark.parametrize(("ranges", "piece", "gap"), [(1, "month", 0), (2, "day", 0), (7, "hour", 3), (200, "day", 40)])
def test_merging_equals_a_loop_for_any_ranges(spark, ranges, piece, gap):
    """Some intervals last for days, over many ranges; many start at one time; some have no length."""
    rng = random.Random(ranges)
    rows = [(a := rng.choice([0, 9000]) + rng.randrange(4000), a + rng.choice([0, 1, 5, 20, 900 if rng.random() < 0.02 else 3]), rng.randrange(1, 4), rng.random() < 0.2) for _ in range(500)] + [(77, 80, 1, False)] * 60
    rows = [(at(a), at(b), *rest) for a, b, *rest in rows]
    df = spark.createDataFrame([(*r, k % 9 // 8, "x") for k, r in enumerate(rows)] + [(None, at(5), 3, True, 0, "x")], "start timestamp_ntz, end timestamp_ntz, level int, provisional boolean, district int, _part string")
    width, text = dt.timedelta(minutes=gap), f"{gap} minutes"
    tuples = lambda found: [(r.start, r.end, r.max_level, r.n_signals, r.provisional) for r in found]
    whole = intervals.merge_intervals(df, max_gap=text, ranges=ranges).orderBy("episode_id").collect()
    assert tuples(whole) == plain_merge(rows, width) and [r.episode_id for r in whole] == list(range(1, len(whole) + 1))
    for key in (0, 1):
        own = intervals.merge_intervals(df, ["district"], text, piece=piece).where(F.col("district") == key).orderBy("episode_id").collect()
        assert tuples(own) == plain_merge([r for k, r in enumerate(rows) if k % 9 // 8 == key], width) and [r.episode_id for r in own] == list(range(1, len(own) + 1))


def test_no_window_is_without_keys(spark):
    import inspect

    for module in (intervals, scans, cleaning, align):
        assert "Window.partitionBy()" not in inspect.getsource(module) and "Window.orderBy" not in inspect.getsource(module)


def test_warnings_hold_in_their_own_district(spark):
    rng = random.Random(8)
    signals = [(at(a), at(a + rng.randrange(0, 200)), rng.randrange(1, 4), rng.choice(["n", "s", None])) for a in (rng.randrange(0, 900) for _ in range(60))]
    points = [(i, at(rng.randrange(-60, 1200)), rng.choice(["n", "s", "w", None]), "kept") for i in range(200)] + [(900, None, "n", "no time")]
    got = intervals.encode_warning(spark.createDataFrame(points, "id int, time timestamp_ntz, place string, _key_0 string"), spark.createDataFrame(signals, "start timestamp_ntz, end timestamp_ntz, level int, district string"), {"place": "district"})
    assert got.columns[:4] == ["id", "time", "place", "_key_0"]
    for r in got.collect():
        best = max(((level, a) for a, b, level, d in signals if r.time is not None and d == r.place and d is not None and a <= r.time < b), default=(0, None))
        assert (r.level, r.minutes_since) == (best[0], None if best[1] is None else (r.time - best[1]) // dt.timedelta(minutes=1))
        assert (r.is_amber, r.is_red, r.is_black, r.warned) == (int(r.level == 1), int(r.level == 2), int(r.level == 3), int(r.level > 0))


def most_shuffled(df):
    """The rows of all shuffles of the plan, and its result."""
    rows = df.collect()

    def walk(node):
        kind, sent = node.getClass().getSimpleName(), node.metrics().get("shuffleRecordsWritten")
        kids = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(k) for k in range(node.children().size())]
        return (sent.get().value() if sent.isDefined() else 0) + sum(map(walk, kids))

    return walk(df._jdf.queryExecution().executedPlan()), rows


@pytest.mark.parametrize("piece", PIECES)
def test_seasonal_fill_moves_rows_and_not_the_bins_between_them(spark, piece):
    rng = random.Random(4)
    places = [(key, k) for key in (1, None) for k in [0, *sorted(rng.sample(range(1, 20_000), 60)), 20_000]] + [(2, 7)]
    rows = [(key, at(15 * k), rng.choice([None, 10.0, 30.0, 50.0]), f"{key} {k}") for key, k in places]
    rows += [(1, at(1), 1e6, "off the grid"), (1, at(0), 70.0, "again"), (1, None, 5.0, "no time")]
    df = spark.createDataFrame(rows, "detector_id int, bin timestamp_ntz, speed double, note string")
    moved, got = most_shuffled(align.fill(df, ["detector_id"], "bin", "speed", "15 minutes", "seasonal", align.weekly_slot("bin"), piece))
    want, slot = [], lambda t: (t.weekday() >= 5, t.hour * 4 + t.minute // 15)
    for key in (1, 2, None):
        own = [r for r in rows if r[0] == key and r[1] is not None and r[3] != "off the grid"]
        means = {s: sum(v) / len(v) for s in {slot(r[1]) for r in own} if (v := [r[2] for r in own if slot(r[1]) == s and r[2] is not None])}
        end, t, there = max(r[1] for r in own), min(r[1] for r in own), {r[1] for r in own}
        want += [(key, b, v, note, means.get(slot(b)) if v is None else v) for key, b, v, note in own]
        while t <= end:
            want += [] if t in there else [(key, t, None, None, means.get(slot(t)))]
            t += dt.timedelta(minutes=15)
    assert sorted(map(str, want)) == sorted(str((r.detector_id, r.bin, r.speed, r.note, r.filled)) for r in got)
    assert len(got) > 40_000 and moved < 5_000
