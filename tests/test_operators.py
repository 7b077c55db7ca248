"""Small literal cases for the rules that the tables' own rows may miss."""

import datetime as dt
import random
import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F

from stormlane.functions import scalar
from stormlane.operators import align, catalog, cleaning, days, intervals, study
from stormlane.sources import bundles, parse, tables

T = dt.datetime


def files(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "content string")


def spans(spark, *rows):
    return spark.createDataFrame([(T(2024, 5, *a), T(2024, 5, *b), level, provisional) for a, b, level, provisional in rows], "start timestamp_ntz, end timestamp_ntz, level int, provisional boolean")


def test_signal_log(spark):
    log = "﻿B\t2024\t5\t4\t23\t10\t2024\t5\t4\t24\t0\t0\t50\n\n  \nQ\t1\nA\t2024\t5\t4\t22\t0\t2024\t5\t4\t23\t10\t1\t10\r\nA\tshort\nUUUU\tprovisional\nR\t2024\t5\t9\t1\t5\t2024\t5\t9\t2\t0\t0\t55"
    got = parse.read_signals(files(spark, log, "")).orderBy("start").collect()
    assert [(r.level, r.level_name, r.end, r.duration_min, r.provisional) for r in got] == [(1, "Amber", T(2024, 5, 4, 23, 10), 70, False), (3, "Black", T(2024, 5, 5), 50, False), (2, "Red", T(2024, 5, 9, 2), 55, True)]


def test_cyclone_log(spark):
    line = "{}\t{}\t{}\t8\tNE\t{}\t1\t9\t2023\tx\t{}\t1\t9\t2023\tx\t5"
    log = "\n".join([line.format("1", "T", "NIL", "10", "2400"), line.format("2", "MSN", "Name", "0", "1"), line.format("3", "ST", "Name", "5", "0130"), "4\tT\tshort"])
    got = parse.read_tc(files(spark, log)).orderBy("tc_code").collect()
    assert [(r.tc_code, r.name, r.start, r.end) for r in got] == [("1", "", T(2023, 9, 1, 0, 10), T(2023, 9, 2)), ("3", "Name", T(2023, 9, 1, 0, 5), T(2023, 9, 1, 1, 30))]


def test_calendar_has_a_mark_and_mixed_arrays(spark):
    got = parse.read_calendar(files(spark, '﻿{"vcalendar":[{"vevent":[{"dtstart":["20240101",{"value":"DATE"}],"summary":" First day "}]}]}')).collect()
    assert [tuple(r) for r in got] == [(dt.date(2024, 1, 1), "First day")]


def test_merge_keeps_touching_and_contained_signals_together(spark):
    rows = spans(spark, ((1, 8), (1, 10), 1, False), ((1, 10), (1, 11), 3, False), ((1, 10), (1, 10, 30), 2, True), ((1, 12), (1, 12), 1, False), ((1, 23), (2, 3), 1, False), ((2, 3), (2, 4), 2, False))
    got = intervals.merge_intervals(rows).orderBy("episode_id").collect()
    assert [(r.episode_id, r.max_level, r.n_signals, r.provisional) for r in got] == [(1, 3, 3, True), (2, 1, 1, False), (3, 2, 2, False)]
    assert intervals.merge_intervals(rows, max_gap="1 hour").count() == 2
    assert intervals.merge_intervals(rows.limit(0)).count() == 0


def test_intervals_hold_their_start_but_not_their_end(spark):
    points = spark.createDataFrame([(i, T(2024, 5, 1, 8 + i)) for i in range(4)], "id int, time timestamp_ntz")
    held = spans(spark, ((1, 9), (1, 10), 2, False), ((1, 10), (1, 10), 3, False))
    assert [r.id for r in intervals.interval_join(points, held).collect()] == [1]
    assert sorted(r.id for r in intervals.interval_join(points, held, how="left_anti").collect()) == [0, 2, 3]


def test_runs_collapse(spark):
    rows = spark.createDataFrame([("a", dt.date(2024, m, d)) for m, d in ((1, 31), (2, 1), (2, 1), (2, 29), (3, 1), (5, 5))], "k string, d date")
    assert intervals.collapse_runs(rows, ["k"], "d", "day").first().ranges == "2024-01-31..2024-02-01, 2024-02-29..2024-03-01, 2024-05-05"
    assert intervals.collapse_runs(rows, ["k"], "d", "month").first().ranges == "2024-01..2024-03, 2024-05"


def test_day_selection(spark):
    episodes = intervals.merge_intervals(spans(spark, ((15, 21), (16, 0), 2, False), ((9, 12), (9, 13), 1, False)))
    none = spans(spark).select("start", "end")
    got = {str(r.date): (r.role, list(r.episode_ids), r.max_level_name) for r in days.select_days(episodes, none, (2024, 2024), min_level=2, pad_hours=0).collect()}
    assert got == {"2024-05-15": ("event", [2], "Red"), "2024-05-16": ("event", [2], "Red"), "2024-05-08": ("control", [], ""), "2024-05-01": ("control", [], ""), "2024-05-02": ("control", [], "")}
    assert days.select_days(episodes, none, (2020, 2021)).count() == 0


def test_cut_document_is_salvaged(spark):
    lane = "<lane><lane_id>{}</lane_id><speed>50</speed><occupancy>3</occupancy><volume>2</volume><valid>Y</valid></lane>"
    whole = "<raw_speed_volume_list><date>2024-05-01</date><periods><period><period_from>08:00:00</period_from><period_to>08:00:30</period_to><detectors><detector><detector_id>D1</detector_id><direction>N</direction><lanes>" + lane.format("Fast") + lane.format("Slow")
    cut, closed = whole + "<lane><lane_id>Mid", whole + "</lanes></detector></detectors></period></periods></raw_speed_volume_list>"
    both = files(spark, cut, closed)
    assert parse.read_readings(both.where(~parse.is_cut(F.col("content")))).count() == 2
    assert sorted((r.detector_id, r.lane_id, r.speed, r.sd) for r in parse.salvage_readings(both).collect()) == [("D1", "Fast", 50.0, None), ("D1", "Slow", 50.0, None)]


def test_bulletin_across_midnight_and_one_amount(spark):
    text = "Between 11:45 p.m. and 12:45 a.m., the rainfall was:\n  Sham &amp; Po District   5 to 12 mm\n  Kwun and Tong  3 mm"
    rows = spark.createDataFrame([(text, T(2024, 5, 2, 1, 2)), ("No rain.", T(2024, 5, 2, 3, 2))], "text string, issued timestamp_ntz")
    got = sorted((r.district, r.min_mm, r.max_mm, r.period_end) for r in parse.read_bulletins(rows).collect())
    assert got == [("Kwun & Tong", 3, 3, T(2024, 5, 2, 0, 45)), ("Sham & Po", 5, 12, T(2024, 5, 2, 0, 45))]


def test_daily_rain_marks(spark):
    lines = spark.createDataFrame([("Title",), ("2024,5,1,Trace,C",), ("2024,5,2,***,",), ("2024,5,3,12.5,C",)], "value string")
    assert sorted((r.mm if r.mm is not None else -1, r.trace) for r in parse.read_daily_rain(lines).collect()) == [(-1, False), (0.0, True), (12.5, False)]


def test_bundle_source_reads_the_days_asked_for(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    with zipfile.ZipFile(f"{folder}/a.zip", "w") as z:
        for day in (1, 2):
            for hour in range(3):
                z.writestr(f"speeds/2024050{day}-0{hour}00-x.xml", f"{day} {hour}")
        z.writestr("speeds/20240501-0300-y.csv", "other")
    spark.dataSource.register(bundles.BundleSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    load = lambda: spark.read.format("bundles").option("suffix", ".xml").option("sliceBytes", "4").load(folder)
    read = load()
    assert read.rdd.getNumPartitions() > 1 and read.count() == 6
    assert sorted(bytes(r.content).decode() for r in load().where("day = '20240502'").collect()) == ["2 0", "2 1", "2 2"]
    held = spark.read.format("binaryFile").load(f"{folder}/a.zip")
    assert bundles.members_of(held, bundle="path").where("name like '%xml'").select("name", "checksum").exceptAll(read.select("name", "checksum")).count() == 0


def test_csv_round_trip_and_empty_table(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    episodes = intervals.merge_intervals(spans(spark, ((1, 8), (1, 10), 1, True))).select("episode_id", "start", "end", "max_level", "n_signals", "provisional")
    tables.write_csv(episodes, f"{folder}/a")
    assert tables.read_csv(spark, f"{folder}/a", tables.EPISODES).collect() == episodes.collect()
    tables.write_csv(episodes.limit(0), f"{folder}/b")
    assert tables.read_csv(spark, f"{folder}/b", tables.EPISODES).count() == 0


def test_only_pending_partitions_are_replaced(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    make = lambda *rows: spark.createDataFrame(rows, "date string, x int")
    tables.write_pending(make(("d1", 1), ("d2", 2)), folder)
    done = spark.read.parquet(folder)
    assert [r.date for r in tables.pending_partitions(make(("d2", 9), ("d3", 3)), done).collect()] == ["d3"]
    tables.write_pending(make(("d2", 5)), folder)
    assert sorted((r.date, r.x) for r in spark.read.parquet(folder).collect()) == [("d1", 1), ("d2", 5)]


def test_plan_rejects_and_order(spark):
    text = '[{"url":"u1","range":["2024-01","2024-03"],"exclude":["2024-02"],"schema":["2024-01-01"]},{"url":"u2","dates":["2024-01"],"range":["2024-01","2024-02"]},{"url":"u3"},{"url":"u4","dates":["2024-13","20240105"]}]'
    got = sorted((r.url, r.kind, r["item"] or "") for r in catalog.expand_plan(catalog.read_plan(files(spark, text))).collect())
    assert got == [("u1", "month", "2024-01"), ("u1", "month", "2024-03"), ("u1", "schema", "2024-01-01"), ("u2", "rejected", ""), ("u3", "rejected", ""), ("u4", "bad", "2024-13"), ("u4", "stamp", "20240105")]


@pytest.mark.parametrize(("mode", "n"), [("keep", 3), ("drop_lane", 2), ("drop_period", 1)])
def test_validity_modes(spark, mode, n):
    rows = spark.createDataFrame([(1, 1, "Y"), (1, 1, "N"), (2, 1, "Y")], "time int, detector_id int, valid string")
    assert cleaning.filter_valid(rows, mode).count() == n


def test_weighted_speed_without_vehicles_is_null(spark):
    rows = spark.createDataFrame([(1, 1, 60.0, 0, 1), (2, 1, 60.0, 3, 1), (2, 1, 30.0, 1, 1)], "detector_id int, time int, speed double, volume int, occupancy int")
    assert {r.detector_id: r.speed for r in align.lanes_to_detector(rows).collect()} == {1: None, 2: 52.5}


def test_rain_is_zero_only_where_a_bulletin_tells(spark):
    rain = spark.createDataFrame([("h1", "a", 1, 3)], "hour string, district string, min_mm int, max_mm int")
    rows = spark.createDataFrame([("h1", "a"), ("h1", "b"), ("h2", "a")], "hour string, district string")
    assert {(r.hour, r.district): r.rain for r in align.rain_join(rows, rain).collect()} == {("h1", "a"): 2.0, ("h1", "b"): 0.0, ("h2", "a"): None}


def test_asof_before_the_first_version_is_null(spark):
    versions = spark.createDataFrame([(1, 10, "a"), (1, 20, "b")], "k int, since int, v string")
    rows = spark.createDataFrame([(1, 9), (1, 10), (1, 25), (2, 30)], "k int, t int")
    assert {(r.k, r.t): r.v for r in align.asof_version(rows, versions, "k", "t", "since", "v").collect()} == {(1, 9): None, (1, 10): "a", (1, 25): "b", (2, 30): None}


def test_confounders_as_features(spark):
    rows = spark.createDataFrame([(1, T(2024, 5, 1, 9)), (2, T(2024, 5, 2, 9))], "id int, time timestamp_ntz")
    holidays = spark.createDataFrame([(dt.date(2024, 5, 1), "h")], "date date, name string")
    under = spans(spark, ((2, 8), (2, 10), 8, False))
    got = {r.id: (r.on_holiday, r.under_cyclone) for r in align.exclude_days(rows, holidays, under, "feature").collect()}
    assert got == {1: (True, False), 2: (False, True)} and align.exclude_days(rows, holidays, under).count() == 0 and align.exclude_days(rows, holidays, under, "keep").count() == 2


def test_spearman_takes_mean_ranks_of_ties(spark):
    make = lambda *xs: spark.createDataFrame(list(enumerate(xs)), "detector_id int, sensitivity double")
    assert study.spearman(make(1.0, 2.0, 2.0, 3.0), make(1.0, 2.0, 2.0, 5.0)).first().spearman == pytest.approx(1.0)
    assert study.spearman(make(1.0, 2.0, 3.0), make(3.0, 2.0, 1.0)).first().spearman == pytest.approx(-1.0)


def test_names_and_codes(spark):
    row = spark.range(1).select(scalar.norm_district(F.lit(" Kwai and Tsing District ")).alias("a"), scalar.url_path(F.lit("https://x.org/a/b.csv?v=1#z")).alias("b"), scalar.hhmm(F.lit("5")).alias("c"), scalar.level_name(F.lit(9)).alias("d"), scalar.member_file(F.lit("f/20240501-0800-a-b.xml")).alias("e"), scalar.wall_time(*map(F.lit, (2023, 2, 30, 1, 1))).alias("f")).first()
    assert tuple(row) == ("Kwai & Tsing", "x.org/a/b.csv", "0005", "", "a-b.xml", None)


def test_kth_content_is_numbered_before_the_resource_part(spark):
    rows = [("20250805-0001-rawSpeedVol.xml", "a", 1), ("20250805-0001-rawSpeedVol.xml", "a", 2), ("20250805-0001-rawSpeedVol.xml", "b", 3), ("20250805-0001-rawSpeedVol.xml", "c", 4), ("20250805-0002-rawSpeedVol.xml", "b", 5), ("notes.txt", "a", 6), ("notes.txt", "b", 7)]
    got = cleaning.version_suffix(spark.createDataFrame(rows, "name string, checksum string, position int")).orderBy("position").collect()
    assert [r.stored_as for r in got] == ["20250805-0001-rawSpeedVol.xml", "20250805-0001_2-rawSpeedVol.xml", "20250805-0001_3-rawSpeedVol.xml", "20250805-0002-rawSpeedVol.xml", "notes.txt", "notes.txt_2"]


def test_nearest_cell_equals_brute_force_off_the_grid(spark):
    rng = random.Random(2)
    points = [(i, rng.uniform(-900, 900), rng.uniform(-900, 900)) for i in range(60)] + [(90, None, 1.0), (91, 0.49, 0.0)]
    cells = [(i, rng.uniform(-300, 1500), rng.uniform(-300, 300)) for i in range(25)] + [(40, 1.51, 0.0), (41, 0.49, -1.4), (42, None, 0.0)]
    frames = spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(cells, "cell_id int, cx double, cy double")
    want = {i: min(((x - a) ** 2 + (y - b) ** 2, c) for c, a, b in cells if a is not None)[1] for i, x, y in points if x is not None}
    assert {r.id: r.cell_id for r in align.nearest_cell(*frames, 1.0).collect()} == want
    assert align.nearest_cell(frames[0], frames[1].limit(0), 1.0).collect() == [] == align.nearest_cell(frames[0].limit(0), frames[1], 1.0).collect()


def test_interval_join_by_key_and_clashing_names(spark):
    points = spark.createDataFrame([(i, i % 2, T(2024, 5, 1, 9, i), "x", 1) for i in range(4)] + [(9, None, T(2024, 5, 1, 9), "x", 1), (10, 1, None, "x", 1)], "id int, own int, time timestamp_ntz, _at string, _hour int")
    held = spark.createDataFrame([(1, T(2024, 5, 1, 8), T(2024, 5, 1, 9, 2)), (0, T(2024, 5, 1, 9, 2), T(2024, 5, 1, 12))], "theirs int, start timestamp_ntz, end timestamp_ntz")
    join = lambda how: intervals.interval_join(points, held, how=how, keys={"own": "theirs"})
    assert sorted(r.id for r in join("inner").collect()) == [1, 2]
    assert sorted(r.id for r in join("left_anti").collect()) == [0, 3, 9, 10] and join("left_anti").columns == points.columns


def test_warning_levels_equal_brute_force(spark):
    rng = random.Random(8)
    at = lambda minutes: T(2024, 5, 1) + dt.timedelta(minutes=minutes)
    signals = [(at(a), at(a + rng.randrange(0, 200)), rng.randrange(1, 4)) for a in (rng.randrange(0, 900) for _ in range(40))]
    points = [(i, at(rng.randrange(-60, 1200)), "kept") for i in range(150)] + [(7, at(300), "repeated"), (200, None, "no time")]
    got = intervals.encode_warning(spark.createDataFrame(points, "id int, time timestamp_ntz, _at string"), spark.createDataFrame(signals, "start timestamp_ntz, end timestamp_ntz, level int"))
    want = []
    for i, t, _ in points:
        best = max(((level, a) for a, b, level in signals if t is not None and a <= t < b), default=(0, None))
        want.append((i, best[0], None if best[1] is None else (t - best[1]) // dt.timedelta(minutes=1)))
    assert sorted(map(str, (tuple(r) for r in got.select("id", "level", "minutes_since").collect()))) == sorted(map(str, want))


def test_normalisations_and_regression_on_two(spark):
    rows = [(d, T(2024, 5, 1) + dt.timedelta(days=k), float(10 * d + k * k)) for d in (1, 2) for k in range(10)]
    bins = spark.createDataFrame(rows, "detector_id int, bin timestamp_ntz, speed double")
    week = {(r.detector_id, r.bin): r.ratio for r in study.normalise(bins, how="prev_week").collect()}
    assert week[1, T(2024, 5, 8)] == 59 / 10 and week[1, T(2024, 5, 7)] is None
    assert study.normalise(bins, how="raw") is bins
    with pytest.raises(ValueError):
        study.normalise(bins, how="other")
    rng = random.Random(1)
    data = [(g, a := rng.random(), b := rng.random(), 5 * g + 2 * a - 3 * b) for g in range(4) for _ in range(9)] + [(1, None, 1.0, 2.0)]
    found = study.within_regression_two(spark.createDataFrame(data, "g int, a double, b double, y double"), "y", "a", "b", "g").first()
    assert found.n == 36 and abs(found.slope_1 - 2) < 1e-9 and abs(found.slope_2 + 3) < 1e-9


def test_ablation_of_a_table_without_rows(spark):
    rows = spark.createDataFrame([], "detector_id int, level int, speed double")
    assert sorted(map(tuple, study.ablate(rows, {"default": F.lit(True), "none": F.col("speed") < 0}, "default").collect())) == [("default", 0, None, 0), ("none", 0, None, 0)]


def test_sessions_keep_fractions_of_seconds(spark):
    at = lambda second, micro=0: T(2024, 5, 1, 9, 0, second, micro)
    rows = spark.createDataFrame([(1, at(0), at(10, 600_000), 1), (1, at(10, 600_000), at(20), 2), (1, at(30), at(30), 3), (2, None, at(1), 1)], "detector_id int, start timestamp_ntz, end timestamp_ntz, level int")
    assert [tuple(r) for r in intervals.merge_sessions(rows, ["detector_id"]).collect()] == [(1, at(0), at(20), 2, 2)]


@pytest.mark.parametrize("sizes", [range(1, 31), range(30, 0, -1)])
def test_estimates_do_not_depend_on_the_order_of_equal_tasks(spark, sizes):
    tasks = spark.createDataFrame([("u", 1, n) for n in sizes], "url string, place_in_list int, size bigint").coalesce(1)
    assert [tuple(r) for r in catalog.estimated_sizes(tasks, order=["place_in_list"]).collect()] == [("u", 30, 3.0 * 30)]


def most_rows(df):
    """The largest number of rows that any step of the plan makes."""
    df.collect()

    def walk(node):
        kind, made = node.getClass().getSimpleName(), node.metrics().get("numOutputRows")
        kids = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(k) for k in range(node.children().size())]
        return max([made.get().value() if made.isDefined() else 0, *map(walk, kids)])

    return walk(df._jdf.queryExecution().executedPlan())


def test_points_in_a_crowded_square_meet_few_of_its_cells(spark):
    rng = random.Random(5)
    place = lambda n: [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(n)]
    points, cells = place(1000), [(i, x, y) for i, x, y in place(1000)] + [(5000 + i, 50.0, 50.0) for i in range(500)]
    near = align.nearest_cell(spark.createDataFrame([*points, (-1, float("nan"), 1.0)], "id int, x double, y double"), spark.createDataFrame(cells, "cell_id int, cx double, cy double"), 500.0)
    assert most_rows(near) < 100_000
    assert {r.id: r.cell_id for r in near.collect()} == {i: min(((x - a) ** 2 + (y - b) ** 2, c) for c, a, b in cells)[1] for i, x, y in points}


def test_districts_take_cells_of_a_crowded_square(spark):
    rng = random.Random(6)
    cells = [(i, rng.uniform(0, 40), rng.uniform(0, 40), 1, float(i % 7)) for i in range(800)]
    dim = [(i, f"d{i % 3}", rng.uniform(0, 40), rng.uniform(0, 40)) for i in range(800)]
    found = align.grid_to_district(spark.createDataFrame(cells, "cell_id int, cx double, cy double, ending int, rain double"), spark.createDataFrame(dim, "detector_id int, district string, x double, y double"), 50.0)
    assert most_rows(found) < 100_000
    own = {}
    for _, district, x, y in dim:
        own.setdefault(district, set()).add(min(((x - a) ** 2 + (y - b) ** 2, c) for c, a, b, _, _ in cells)[1])
    assert {r.district: (round(r.mean_rain, 9), r.max_rain) for r in found.collect()} == {k: (round(sum(c % 7 for c in v) / len(v), 9), max(c % 7 for c in v)) for k, v in own.items()}


def test_salvage_seeks_the_fields_of_a_document_and_a_period_once(spark):
    """In the plan they stay in the step that cuts the text, instead of being sought in the whole text for each part."""
    lane = lambda k: f"<lane><lane_id>L{k}</lane_id><speed>{k}.5</speed><occupancy>1</occupancy><volume>2</volume><valid>Y</valid></lane>"
    detector = lambda d: f"<detector><detector_id>D{d}</detector_id><direction>North</direction><lanes>{lane(1)}{lane(2)}</lanes></detector>"
    period = lambda p: f"<period><period_from>08:0{p}:00</period_from><period_to>08:0{p}:30</period_to><detectors>{detector(1)}{detector(2)}</detectors></period>"
    text = f"<raw_speed_volume_list><date>2024-05-01</date><periods>{period(1)}{period(2)}<period><period_from>08:03:00</period_from><detectors><detector><detector_id>D9</detector_id><lanes>{lane(3)}<lane><lane_id>Fa"
    found = parse.salvage_readings(spark.createDataFrame([("f", text), ("whole", "<raw_speed_volume_list></raw_speed_volume_list>")], "file string, content string"))
    got = sorted((r.file, r.date, r.period_from, r.period_to, r.detector_id, r.direction, r.lane_id, r.speed, r.sd) for r in found.collect())
    want = [("f", "2024-05-01", f"08:0{p}:00", f"08:0{p}:30", f"D{d}", "North", f"L{k}", k + 0.5, None) for p in (1, 2) for d in (1, 2) for k in (1, 2)]
    assert got == [*want, ("f", "2024-05-01", "08:03:00", "", "D9", "", "L3", 3.5, None)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Project [" in line and ("regexp_extract(content#" in line or "regexp_extract(p#" in line)]


def test_members_come_one_to_a_batch(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    with zipfile.ZipFile(f"{folder}/a.zip", "w") as z:
        for hour in range(4):
            z.writestr(f"speeds/20240501-0{hour}00-x.xml", f"{hour}" * 1000)
    reader = bundles.BundleSource({"path": folder}).reader(None)
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert [(b.num_rows, b.schema.names[-1], b.column("content")[0].as_py()[:1]) for b in batches] == [(1, "content", str(h).encode()) for h in range(4)]
    assert bundles.read_bundles(spark, folder).orderBy("position").select("day", "position").collect() == [("20240501", h) for h in range(4)]


def test_bundles_are_packed_from_bounded_batches(spark):
    day = spark.range(3).selectExpr("concat('b', id) as bundle", "cast('x' as binary) as content")
    folder = bundles.write_bundles(day, f"{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/out")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != "67108864b"
    assert len(spark.read.format("binaryFile").load(folder).collect()) == 3
