"""Rejects of each reader on literal files: which line or event, and why; good rows are still read."""

import datetime as dt

from stormlane.operators import catalog, intervals
from stormlane.sources import parse, rejects, tables

T = dt.datetime


def files(spark, *texts):
    return spark.createDataFrame([(f"f{k}", t) for k, t in enumerate(texts)], "file string, content string")


def found(df):
    return sorted((r.file, r["item"] or 0, r.reason) for r in df.collect())


def test_calendar_and_coverage(spark):
    good = '﻿{"vcalendar":[{"vevent":[{"dtstart":["20240101"],"summary":"a"},{"dtstart":["2024"],"summary":"b"},{"summary":"c"},{"dtstart":["20240102"],"summary":" "}]}]}'
    some = files(spark, good, "{broken", None, "")
    assert found(rejects.calendar_rejects(some, "file")) == [("f0", 2, "date"), ("f0", 3, "date"), ("f0", 4, "name"), ("f1", 0, "json"), ("f2", 0, "json"), ("f3", 0, "json")]
    assert [r.date for r in parse.read_calendar(some).collect()] == [dt.date(2024, 1, 1), None, None, dt.date(2024, 1, 2)]
    assert found(rejects.coverage_rejects(files(spark, '{"timestamps":[]}', "{", None), "file")) == [("f1", 0, "json"), ("f2", 0, "json")]


def test_documents(spark):
    lane = "<raw_speed_volume_list><date>2024-05-01</date><periods><period><period_from>08:00:00</period_from><detectors><detector><detector_id>D</detector_id><lanes><lane><lane_id>F</lane_id><speed>{}</speed></lane></lanes></detector></detectors></period></periods></raw_speed_volume_list>"
    some = files(spark, lane.format(50), lane.format("fast"), lane.format(50)[:-30], None, "<other></other></raw_speed_volume_list>")
    assert found(rejects.reading_rejects(some, "file")) == [("f1", 0, "value"), ("f2", 0, "cut"), ("f3", 0, "cut"), ("f4", 0, "xml")]
    segments = files(spark, "<l><date>2024-05-01</date><time>10:00:00</time><segments><segment><segment_id>1</segment_id></segment><segment><speed>4</speed></segment></segments></l>", "<l><date>x</date><time>y</time><segments><segment><segment_id>1</segment_id></segment></segments></l>", "no xml")
    assert found(rejects.segment_rejects(segments, "file")) == [("f0", 2, "segment_id"), ("f1", 0, "time"), ("f2", 0, "xml")]
    assert [r.time for r in parse.read_segments(segments).where("segment_id = '1'").collect()] == [T(2024, 5, 1, 10), None]
    news = files(spark, "<l><message><id>1</id><time>2024-05-01T10:00:00</time></message><message><time>2024-05-01T10:00:00</time></message><message><id>2</id><time>soon</time></message></l>", "<l>")
    assert found(rejects.news_rejects(news, "file")) == [("f0", 2, "id"), ("f0", 3, "time"), ("f1", 0, "xml")]


def test_lines(spark):
    text = "﻿id,d,r,lat,lon\r\n1,N,R,22.5,114\r\n\r\n2,N,R,north,114\r\n3,N\r\n"
    wide = "id\td\tr\tlat\tlon\n1\tN\tR\t22.5\tx"
    some = spark.createDataFrame([("plain", text.encode()), ("wide", wide.encode("utf-16")), ("none", None)], "file string, content binary")
    assert found(rejects.dimension_rejects(some, "file")) == [("plain", 4, "columns"), ("plain", 5, "columns"), ("wide", 2, "columns")]
    routes = spark.createDataFrame([("v", b"SEGMENT,ROUTE\n7, R1 \n8,R2\n")], "version string, content binary")
    assert sorted(map(tuple, parse.read_dimension(routes, columns=parse.ROUTES).collect())) == [("v", "7", "R1"), ("v", "8", "R2")]
    number = lambda *lines: spark.createDataFrame([("f", k, t) for k, t in enumerate(lines, 1)], "file string, n int, value string")
    rain = number("Title", "Year,Month,Day", "2024,2,30,1,C", "2024,2,3,much,C", "2024,2,4,***,", "2024,2,5,Trace,C", "2024,2,6,,C", "* note")
    assert found(rejects.daily_rain_rejects(rain, "file", "n")) == [("f", 3, "date"), ("f", 4, "value"), ("f", 7, "value")]
    grid = number("Updated,Ending", "202401010000,202401010030,22,114,1.5", "202413010000,202401010030,22,114,1.5", "202401010000,202401010030,22,x,1.5", "5,6", "")
    assert found(rejects.grid_rejects(grid, "file", "n")) == [("f", 3, "time"), ("f", 4, "number"), ("f", 5, "shape")]
    assert found(rejects.bulletin_rejects(spark.createDataFrame([("a", "No."), ("b", None), ("c", "Between 9 and 10 a.m. it was\n N 5 mm")], "file string, text string"), "file")) == [("a", 0, "sentence"), ("b", 0, "sentence")]
    logs = files(spark, "Q\t1\nA\t2\n")
    assert sorted(r.reason for r in rejects.log_rejects(logs, "file", "signals").collect()) == ["code", "fields"]
    both = rejects.counted(rejects.log_rejects(logs, "file", "signals"), rejects.log_rejects(logs, "file", "tc"))
    assert sorted(map(tuple, both.collect())) == [("signals", "code", 1), ("signals", "fields", 1), ("tc", "fields", 2)]


def test_idle_excludes_have_rows_of_their_own(spark):
    text = '[{"url":"u","range":["2024-01","2024-02"],"exclude":["2023-12","2024-02","2024-02","2025-01"]},{"url":"v","dates":["2024-01"]}]'
    got = sorted((r.url, r.kind, r["item"]) for r in catalog.expand_plan(catalog.read_plan(files(spark, text))).collect())
    assert got == [("u", "idle exclude", "2023-12"), ("u", "idle exclude", "2025-01"), ("u", "month", "2024-01"), ("v", "month", "2024-01")]


def test_manifest_is_in_order_of_date_and_read_back(spark):
    import tempfile

    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/m"
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=k * 37 % 100), "event" if k % 2 else "control", [k, k + 1] if k % 2 else [], 2 if k % 2 else 0, "Red" if k % 2 else "") for k in range(100)]
    frame = spark.createDataFrame(rows, "date date, role string, episode_ids array<int>, max_level int, max_level_name string").repartition(5)
    tables.write_manifest(frame, path)
    want = sorted((d, role, " ".join(map(str, ids)), level, name) for d, role, ids, level, name in rows)
    assert sorted(map(tuple, tables.read_manifest(spark, path).collect())) == want
    lines = [line.split(",")[0] for part in sorted(__import__("glob").glob(f"{path}/part-*.csv")) for line in open(part) if not line.startswith("date")]
    assert lines == [str(r[0]) for r in want]
    tables.write_manifest(frame.limit(0), path)
    assert tables.read_manifest(spark, path).collect() == []


def test_incidents_without_an_end_hold_for_a_day(spark):
    rows = spark.createDataFrame([(k, k % 2, T(2024, 5, 1) + dt.timedelta(hours=6 * k)) for k in range(10)] + [(99, None, T(2024, 5, 1))], "id int, road int, time timestamp_ntz")
    news = spark.createDataFrame([(0, T(2024, 5, 1), None), (1, T(2024, 5, 1), T(2024, 5, 1, 12))], "at int, start timestamp_ntz, end timestamp_ntz")
    assert sorted(r.id for r in intervals.exclude_incidents(rows, news, {"road": "at"}).collect()) == [3, 4, 5, 6, 7, 8, 9, 99]


def test_documents_are_parsed_once_for_their_rejects_and_those_of_their_items(spark):
    some = files(spark, "<list><message></message></list>", "", None)
    for df, parser in ((rejects.news_rejects(some, "file"), "from_xml("), (rejects.segment_rejects(some, "file"), "from_xml("), (rejects.calendar_rejects(some, "file"), "from_json(")):
        assert df._jdf.queryExecution().optimizedPlan().toString().count(parser) == 1
    assert found(rejects.news_rejects(some, "file")) == [("f0", 1, "id"), ("f1", 0, "xml"), ("f2", 0, "xml")]
