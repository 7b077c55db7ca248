"""Queries of the readers: rows of the views are rendered as the archive has them, parsed again, and compared with the rows."""

from __future__ import annotations

import io
import uuid
import warnings
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormlane.functions import scalar
from stormlane.operators import align, catalog, cleaning, days, intervals
from stormlane.plans.queries import _EPISODE_COLUMNS, _EVENTS, _MANIFEST, query
from stormlane.plans.views import Views
from stormlane.sources import bundles, parse, rejects, tables

_MINUTE = "date_trunc('minute', {})"


def _minute(column: str):
    return F.date_trunc("minute", column).cast("timestamp_ntz")


def _document(rows: DataFrame, keys: list[str], line, order: list, separator: str = "\n", head: str = "", tail: str = "") -> DataFrame:
    """One text per key: the lines in order, between head and tail."""
    lines = rows.select(*keys, *order, line.alias("line")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") if hasattr(o, "alias") else F.col(o).alias(f"o{i}") for i, o in enumerate(order)], "line"))).alias("x"))
    return lines.select(*keys, F.concat(F.lit(head), F.array_join(F.col("x.line"), separator), F.lit(tail)).alias("content"))


def _clock_fields(column: str, end: bool = False):
    """Year, month, day, hour, minute; an end at midnight is hour 24 of the day before."""
    midnight = (F.hour(column) == 0) & (F.minute(column) == 0) if end else F.lit(False)
    day = F.when(midnight, F.date_sub(F.to_date(column), 1)).otherwise(F.to_date(column))
    hour = F.when(midnight, 24).otherwise(F.hour(column))
    return [f.cast("string") for f in (F.year(day), F.month(day), F.day(day), hour, F.minute(column))]


def _signal_minutes(v: Views) -> DataFrame:
    rows = v.signals.withColumn("start", _minute("start")).withColumn("end", _minute("end"))
    return rows.withColumn("month", F.date_format("start", "yyyy-MM")).withColumn("late", F.dayofmonth("start") > 25)


def _signal_logs(v: Views) -> DataFrame:
    """A log a month, its last days behind a marker line; with a byte order mark, blank lines and lines of other codes."""
    rows = _signal_minutes(v)
    code = F.element_at(F.array(*map(F.lit, "ARB")), F.col("level"))
    line = F.concat_ws("\t", code, *_clock_fields("start"), *_clock_fields("end", True), F.lit(" 1"), F.lit("0 "))
    marks = rows.select("month").distinct().select("month", F.lit(True).alias("late"), F.lit(-1).cast("long").alias("signal_id"), F.lit("UUUU\trecords below are provisional").alias("line"))
    both = rows.select("month", "late", "signal_id", line.alias("line")).unionByName(marks)
    return _document(both, ["month"], F.col("line"), ["late", "signal_id"], "\r\n", "﻿X\tno signal\n\n", "\n")


_LOGGED = """SELECT level, CASE level WHEN 1 THEN 'Amber' WHEN 2 THEN 'Red' ELSE 'Black' END AS level_name, date_trunc('minute', "start") AS "start", date_trunc('minute', "end") AS "end", CAST(date_diff('minute', date_trunc('minute', "start"), date_trunc('minute', "end")) AS BIGINT) AS duration_min, day("start") > 25 AS provisional FROM signals"""


@query("parse_signals_counters", "signals", """SELECT strftime("start", '%Y-%m') AS month, count(*) AS n_rows, CAST(1 AS BIGINT) AS n_rejected FROM signals GROUP BY ALL""")
def parse_signals_counters(v: Views) -> DataFrame:
    return parse.signal_counters(_signal_logs(v), "month")


@query("parse_signals", "signals", _LOGGED)
def parse_signals(v: Views) -> DataFrame:
    return parse.read_signals(_signal_logs(v)).select("level", "level_name", "start", "end", "duration_min", "provisional")


def _tc_logs(v: Views) -> DataFrame:
    """A cyclone log a month; every fifth signal has the intensity that is rejected."""
    rows = v.cyclones.withColumn("start", _minute("start")).withColumn("end", _minute("end"))
    name = F.when(F.col("signal_id") % 4 == 0, "NIL").otherwise(F.concat(F.lit("TC"), F.col("signal_id").cast("string")))
    intensity = F.when(F.col("signal_id") % 5 == 0, "MSN").otherwise("T")

    def at(column: str, end: bool):
        year, month, day, hour, minute = _clock_fields(column, end)
        return [(hour.cast("int") * 100 + minute.cast("int")).cast("string"), day, month, year, F.lit("x")]

    line = F.concat_ws("\t", F.col("signal_id").cast("string"), intensity, name, F.lit("8"), F.lit("NE"), *at("start", False), *at("end", True), F.lit("1"))
    return _document(rows.withColumn("month", F.date_format("start", "yyyy-MM")), ["month"], line, ["signal_id"])


@query("parse_tc", "cyclones", """SELECT CAST(signal_id AS VARCHAR) AS tc_code, CASE WHEN signal_id % 4 = 0 THEN '' ELSE 'TC' || signal_id END AS name, 'T' AS intensity, '8' AS signal, 'NE' AS direction, date_trunc('minute', "start") AS "start", date_trunc('minute', "end") AS "end", false AS provisional FROM cyclones WHERE signal_id % 5 <> 0""")
def parse_tc(v: Views) -> DataFrame:
    return parse.read_tc(_tc_logs(v))


@query("parse_tc_counters", "cyclones", """SELECT strftime("start", '%Y-%m') AS month, count(*) FILTER (signal_id % 5 <> 0) AS n_rows, count(*) FILTER (signal_id % 5 = 0) AS n_rejected FROM cyclones GROUP BY ALL""")
def parse_tc_counters(v: Views) -> DataFrame:
    return parse.tc_counters(_tc_logs(v), "month")


@query("parse_calendar", "holidays", "SELECT date, name FROM holidays")
def parse_calendar(v: Views) -> DataFrame:
    event = F.concat(F.lit('{"dtstart":["'), F.date_format("date", "yyyyMMdd"), F.lit('",{"value":"DATE"}],"summary":" '), F.col("name"), F.lit(' "}'))
    files = _document(v.days.withColumn("year", F.year("date")), ["year"], event, ["date"], ",", '﻿{"vcalendar":[{"vevent":[', "]}]}")
    return parse.read_calendar(files).select("date", "name")


def _reading_files(v: Views) -> DataFrame:
    """An XML document an hour with a period per reading; s.d. is absent from every third lane."""
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value.cast("string"), F.lit(f"</{name}>"))
    sd = F.when(F.col("event_id") % 3 != 0, tag("s.d.", F.col("event_id") % 10)).otherwise(F.lit(""))
    lane = F.concat(F.lit("<lane>"), tag("lane_id", F.col("lane_id")), tag("speed", F.col("speed")), tag("occupancy", F.col("occupancy")), tag("volume", F.col("volume")), sd, tag("valid", F.col("valid")), F.lit("</lane>"))
    detector = F.concat(F.lit("<detectors><detector>"), tag("detector_id", F.col("detector_id")), F.lit("<direction>North</direction><lanes>"), lane, F.lit("</lanes></detector></detectors>"))
    period = F.concat(F.lit("<period>"), tag("period_from", F.date_format("time", "HH:mm:ss")), tag("period_to", F.date_format("time", "HH:mm:ss")), detector, F.lit("</period>"))
    rows = v.readings.withColumn("hour", F.date_format("time", "yyyyMMdd-HH")).withColumn("day", F.date_format("time", "yyyy-MM-dd"))
    files = _document(rows, ["hour", "day"], period, ["event_id"], "")
    return files.select("hour", F.concat(F.lit("<raw_speed_volume_list><date>"), "day", F.lit("</date><periods>"), "content", F.lit("</periods></raw_speed_volume_list>")).alias("content"))


_PARSED = "detector_id, date, period_from, lane_id, speed, occupancy, volume, sd, valid"
_RENDERED = "SELECT CAST(detector_id AS VARCHAR) AS detector_id, strftime(time, '%Y-%m-%d') AS date, strftime(time, '%H:%M:%S') AS period_from, lane_id, speed, occupancy, volume, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 10 AS DOUBLE) END AS sd, valid FROM readings"


def _parsed(rows: DataFrame) -> DataFrame:
    return rows.select(*_PARSED.split(", "))


@query("parse_readings_xml", "readings", _RENDERED)
def parse_readings_xml(v: Views) -> DataFrame:
    return _parsed(parse.read_readings(_reading_files(v)))


@query("salvage_xml", "readings", _RENDERED)
def salvage_xml(v: Views) -> DataFrame:
    """All documents are cut inside an unfinished last lane, so all their own lanes must be found."""
    cut = _reading_files(v).withColumn("content", F.concat(F.regexp_replace("content", "</periods></raw_speed_volume_list>$", ""), F.lit("<period><period_from>00:00</period_from><detectors><detector><detector_id>x</detector_id><lanes><lane><lane_id>Fa")))
    return _parsed(parse.salvage_readings(cut))


def _some_cut(v: Views) -> DataFrame:
    """The documents of even hours end within a lane of a further period."""
    cut = F.concat(F.regexp_replace("content", "</periods></raw_speed_volume_list>$", ""), F.lit("<period><period_from>00:00</period_from><detectors><detector><detector_id>x</detector_id><lanes><lane><lane_id>Fa"))
    return _reading_files(v).withColumn("content", F.when(F.substring("hour", -1, 1).cast("int") % 2 == 0, cut).otherwise(F.col("content")))


@query("read_archive_xml", "readings", _RENDERED)
def read_archive_xml(v: Views) -> DataFrame:
    """Whole and cut documents in one job."""
    return _parsed(parse.read_archive(_some_cut(v)))


@query("salvage_middle", "readings", _RENDERED.replace("FROM readings", "FROM (SELECT *, max(event_id) OVER (PARTITION BY strftime(time, '%Y%m%d-%H')) AS last FROM readings) WHERE event_id < last"))
def salvage_middle(v: Views) -> DataFrame:
    """Every document is cut within the last lane of its own last detector, which is lost; all before it is found."""
    kept = F.expr("substring(content, 1, length(content) - length(substring_index(content, '<speed>', -1)))")
    return _parsed(parse.salvage_readings(_reading_files(v).withColumn("content", kept)))


@query("cut_counters", "readings", "SELECT count(*) AS n_files, count(*) FILTER (CAST(right(hour, 1) AS INTEGER) % 2 = 0) AS n_truncated FROM (SELECT DISTINCT strftime(time, '%Y%m%d-%H') AS hour FROM readings)")
def cut_counters(v: Views) -> DataFrame:
    return parse.cut_counters(_some_cut(v))


@query("read_dimension", "detectors", "SELECT CASE WHEN detector_id % 2 = 0 THEN 'wide' ELSE 'plain' END AS version, CAST(detector_id AS VARCHAR) AS detector_id, district, road, x AS latitude, y AS longitude FROM detectors")
def read_dimension(v: Views) -> DataFrame:
    rows = v.detectors.withColumn("version", F.when(F.col("detector_id") % 2 == 0, "wide").otherwise("plain")).withColumn("part", F.col("detector_id") % 50)
    sep = F.when(F.col("version") == "wide", "\t").otherwise(",")
    fields = [F.col("detector_id").cast("string"), F.col("district"), F.col("road"), F.col("x").cast("string"), F.col("y").cast("string")]
    line = F.concat(*[x for f in fields for x in (f, F.lit(" "), sep)][:-1])
    files = _document(rows, ["version", "part"], line, ["detector_id"], "\r\n", "id,District,Road,Latitude,Longitude\r\n", "\r\n\r\n")
    wide = F.concat(F.lit(bytearray(b"\xff\xfe")), F.encode("content", "UTF-16LE"))
    plain = F.concat(F.lit(bytearray(b"\xef\xbb\xbf")), F.encode("content", "UTF-8"))
    return parse.read_dimension(files.select("version", F.when(F.col("version") == "wide", wide).otherwise(plain).alias("content")))


@query("parse_bulletins", "rain", "SELECT hour + INTERVAL 50 minutes AS issued, hour + INTERVAL 45 minutes AS period_end, district, min_mm, max_mm FROM rain")
def parse_bulletins(v: Views) -> DataFrame:
    amount = F.when(F.col("min_mm") == F.col("max_mm"), F.concat_ws(" ", F.col("min_mm").cast("string"), F.lit("mm"))).otherwise(F.concat_ws(" ", F.col("min_mm").cast("string"), F.lit("to"), F.col("max_mm").cast("string"), F.lit("mm")))
    line = F.concat(F.lit("  "), F.regexp_replace("district", "_", "x"), F.lit(" District  "), amount)
    named = v.rain.withColumn("district", F.translate("district", "0123456789", "abcdefghij"))
    half = lambda c: F.when(F.hour(c) < 12, "a.m.").otherwise("p.m.")
    clock = lambda c: F.concat(((F.hour(c) + 11) % 12 + 1).cast("string"), F.lit(":"), F.lpad(F.minute(c).cast("string"), 2, "0"), F.lit(" "), half(c))
    texts = _document(named, ["hour"], line, ["district"]).withColumn("end", F.col("hour") + F.expr("interval 45 minutes"))
    body = F.concat(F.lit("Between "), clock(F.col("end") - F.expr("interval 1 hour")), F.lit(" and "), clock("end"), F.lit(", the rainfall recorded in various regions were:\n"), "content")
    found = parse.read_bulletins(texts.select((F.col("hour") + F.expr("interval 50 minutes")).alias("issued"), body.alias("text")))
    return found.withColumn("district", F.translate(F.regexp_replace("district", "^NATIONx", "NATION_"), "abcdefghij", "0123456789"))


@query("bulletin_period", "rain", "SELECT DISTINCT hour + INTERVAL 50 minutes AS issued, hour + INTERVAL 45 minutes AS period_end FROM rain")
def bulletin_period(v: Views) -> DataFrame:
    return parse_bulletins(v).select("issued", "period_end").distinct()


@query("read_daily_rain", "readings", "SELECT date, CASE WHEN n % 5 = 1 THEN 0.0 WHEN n % 5 <> 0 THEN mm END AS mm, n % 5 = 1 AS trace, 'C' AS completeness FROM (SELECT CAST(time AS DATE) AS date, max(speed) AS mm, max(event_id) AS n FROM readings GROUP BY ALL)")
def read_daily_rain(v: Views) -> DataFrame:
    daily = v.readings.groupBy(F.to_date("time").alias("date")).agg(F.max("speed").alias("mm"), F.max("event_id").alias("n"))
    value = F.when(F.col("n") % 5 == 0, "***").when(F.col("n") % 5 == 1, "Trace").otherwise(F.col("mm").cast("string"))
    line = F.concat_ws(",", F.date_format("date", "yyyy,M,d"), value, F.lit("C"))
    notes = v.spark.createDataFrame([("Daily total rainfall (mm)",), ("Year,Month,Day,Value,Completeness",), ("*** unavailable",)], "value string")
    return parse.read_daily_rain(daily.select(line.alias("value")).unionAll(notes))


@query("parse_segments", "readings", "SELECT date_trunc('minute', time) AS time, CAST(detector_id AS VARCHAR) AS segment_id, speed, valid FROM readings")
def parse_segments(v: Views) -> DataFrame:
    rows = v.readings.withColumn("time", _minute("time"))
    item = F.concat(F.lit("<segment><segment_id>"), F.col("detector_id").cast("string"), F.lit("</segment_id><speed>"), F.col("speed").cast("string"), F.lit("</speed><valid>"), "valid", F.lit("</valid></segment>"))
    files = _document(rows, ["time"], item, ["event_id"], "")
    whole = F.concat(F.lit("<segment_speed_list><date>"), F.date_format("time", "yyyy-MM-dd"), F.lit("</date><time>"), F.date_format("time", "HH:mm:ss"), F.lit("</time><segments>"), "content", F.lit("</segments></segment_speed_list>"))
    return parse.read_segments(files.select(whole.alias("content")))


@query("parse_news", "readings", "SELECT CAST(event_id AS VARCHAR) AS id, upper(lane_id) AS status, date_trunc('second', time) AS time, 'Notice ' || event_id AS heading, CASE WHEN event_id % 2 = 0 THEN 'D' || detector_id END AS district FROM readings")
def parse_news(v: Views) -> DataFrame:
    place = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("<district>D"), F.col("detector_id").cast("string"), F.lit("</district>"))).otherwise("")
    item = F.concat(F.lit("<message><id>"), F.col("event_id").cast("string"), F.lit("</id><status>"), F.upper("lane_id"), F.lit("</status><time>"), F.date_format("time", "yyyy-MM-dd HH:mm:ss"), F.lit("</time><heading>Notice "), F.col("event_id").cast("string"), F.lit("</heading>"), place, F.lit("</message>"))
    return parse.read_news(_document(v.readings.withColumn("hour", F.date_trunc("hour", "time")), ["hour"], item, ["event_id"], "", "<list>", "</list>").select("content"))


@query("read_grid", "readings", "SELECT date_trunc('minute', time) AS updated, date_trunc('minute', time) + to_minutes(CAST(30 * (event_id % 4 + 1) AS BIGINT)) AS ending, CAST(detector_id AS DOUBLE) AS lat, CAST(occupancy AS DOUBLE) AS lon, speed AS rain, CAST(30 * (event_id % 4 + 1) AS BIGINT) AS lead_min FROM readings")
def read_grid(v: Views) -> DataFrame:
    ending = F.col("time") + F.make_dt_interval(F.lit(0), F.lit(0), (30 * (F.col("event_id") % 4 + 1)).cast("int"))
    stamp = lambda c: F.date_format(c, "yyyyMMddHHmm")
    lines = v.readings.select(F.concat_ws(",", stamp("time"), stamp(ending), F.col("detector_id").cast("string"), F.col("occupancy").cast("string"), F.col("speed").cast("string")).alias("value"))
    return parse.read_grid(lines)


# Bundles


def _bundle_files(v: Views) -> DataFrame:
    """A ZIP a day, as bytes, with a member per hourly document; every third is stored twice."""
    rows = _reading_files(v).select(F.substring("hour", 1, 8).alias("bundle"), "hour", "content")
    schema = pa.schema([("bundle", pa.string()), ("content", pa.binary())])

    def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by bundle and hour; of a bundle one document at a time is held beside what is packed."""
        name, out, bundle = None, None, None

        def packed() -> pa.RecordBatch:
            bundle.close()
            return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([out.getvalue()], pa.binary())], schema=schema)

        with warnings.catch_warnings():
            warnings.simplefilter("ignore")  # names that occur twice are meant
            for batch in batches:
                for own, hour, content in zip(*batch.columns):
                    if own.as_py() != name:
                        if bundle:
                            yield packed()
                        name, out = own.as_py(), io.BytesIO()
                        bundle = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                    for _ in range(2 if int(hour.as_py()[-2:]) % 3 == 0 else 1):
                        with bundle.open(zipfile.ZipInfo(f"speeds/{hour.as_py()}00-rawSpeedVol.xml"), "w") as member:
                            member.write(content.as_buffer())
            if bundle:
                yield packed()

    return bundles.map_arrow(rows.repartition("bundle").sortWithinPartitions("bundle", "hour"), zipped, "bundle string, content binary")


_HOURS = "SELECT DISTINCT strftime(time, '%Y%m%d') AS day, strftime(time, '%H') AS hour FROM readings"


@query("bundle_members", "readings", f"SELECT day AS bundle, 'speeds/' || day || '-' || hour || '00-rawSpeedVol.xml' AS name, day, CASE WHEN CAST(hour AS INTEGER) % 3 = 0 THEN 2 ELSE 1 END AS copies FROM ({_HOURS})")
def bundle_members(v: Views) -> DataFrame:
    found = bundles.members_of(_bundle_files(v), suffix="rawSpeedVol.xml")
    return found.groupBy("bundle", "name", "day", "checksum").agg(F.count("*").cast("int").alias("copies")).drop("checksum")


@query("bundle_source", "readings", f"SELECT day AS bundle, 'speeds/' || day || '-' || hour || '00-rawSpeedVol.xml' AS name, day, CASE WHEN CAST(hour AS INTEGER) % 3 = 0 THEN 2 ELSE 1 END AS copies FROM ({_HOURS})")
def bundle_source(v: Views) -> DataFrame:
    """The bundles as files, read by slices of members."""
    folder = bundles.write_bundles(_bundle_files(v), f"{_scratch(v)}-bundles")
    found = bundles.read_bundles(v.spark, folder, "rawSpeedVol.xml").withColumn("bundle", F.regexp_replace("bundle", "[.]zip$", ""))
    return found.groupBy("bundle", "name", "day", "checksum").agg(F.count("*").cast("int").alias("copies")).drop("checksum")


@query("member_name", "readings", f"SELECT strptime(day || hour, '%Y%m%d%H') AS archived, 'rawSpeedVol.xml' AS file, count(*) AS n FROM ({_HOURS}) GROUP BY ALL")
def member_name(v: Views) -> DataFrame:
    names = bundles.members_of(_bundle_files(v)).select("name").distinct()
    return names.groupBy(scalar.member_stamp(F.col("name")).alias("archived"), scalar.member_file(F.col("name")).alias("file")).agg(F.count("*").alias("n"))


# Typed tables


def _scratch(v: Views) -> str:
    """A new folder in the checkpoint folder that the session names."""
    return f"{tables.shared_folder(v.spark)}/{uuid.uuid4().hex}"


@query("roundtrip_episodes", "episodes", """SELECT episode_id, date_trunc('minute', "start") AS "start", date_trunc('minute', "end") AS "end", max_level, n_signals, provisional FROM episodes""")
def roundtrip_episodes(v: Views) -> DataFrame:
    tables.write_csv(intervals.merge_intervals(v.signals).select(*_EPISODE_COLUMNS), path := _scratch(v))
    return tables.read_csv(v.spark, path, tables.EPISODES)


@query("roundtrip_manifest", "episodes cyclones", f", ev AS ({_EVENTS}) SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM ({_MANIFEST})")
def roundtrip_manifest(v: Views) -> DataFrame:
    """The selected days written in order of date and read back."""
    tables.write_manifest(days.select_days(intervals.merge_intervals(v.signals), v.cyclones, (1, 9999), min_level=1, since="0001-01-01"), path := _scratch(v))
    return tables.read_manifest(v.spark, path)


@query("pending_partitions", "readings", "SELECT event_id, CAST(time AS DATE) AS date FROM readings WHERE CAST(time AS DATE) NOT IN (SELECT CAST(time AS DATE) FROM readings WHERE lane_id = 'error' AND speed > 200)")
def pending_partitions(v: Views) -> DataFrame:
    rows = v.readings.withColumn("date", F.to_date("time"))
    return tables.pending_partitions(rows, rows.where("lane_id = 'error' and speed > 200")).select("event_id", "date")


@query("latest_snapshot", "", "SELECT o_custkey AS k, arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (o_orderdate >= TIMESTAMP '1998-10-01' - INTERVAL 400 days) AS content, max(o_orderdate) FILTER (o_orderdate >= TIMESTAMP '1998-10-01' - INTERVAL 400 days) AS at, count(*) FILTER (o_orderdate >= TIMESTAMP '1998-10-01' - INTERVAL 400 days) = 0 AS missing FROM orders WHERE o_orderdate <= TIMESTAMP '1998-10-01' GROUP BY o_custkey")
def latest_snapshot(v: Views) -> DataFrame:
    import datetime

    orders = v.table("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"), F.col("o_orderkey").alias("content"))
    return tables.latest_snapshot(orders, "k", "at", "content", F.lit(datetime.datetime(1998, 10, 1)).cast("timestamp_ntz"), 400)


# Plans and coverage: entries and responses are rendered from orders


def _plan_files(v: Views) -> DataFrame:
    """A plan per customer with one entry per order status: dates, a range with exclusions, or both, which is rejected."""
    orders = v.table("orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    days = F.concat(F.lit('["'), F.array_join(F.array_sort(F.collect_set("day")), '","'), F.lit('"]'))
    months = F.concat(F.lit('"range":["'), F.date_format(F.min("o_orderdate"), "yyyy-MM"), F.lit('","'), F.date_format(F.max("o_orderdate"), "yyyy-MM"), F.lit('"],"exclude":["'), F.date_format(F.min("o_orderdate"), "yyyy-MM"), F.lit('"]'))
    asked = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit('"dates":'), days)).when(F.col("o_orderstatus") == "F", months).otherwise(F.concat(F.lit('"dates":'), days, F.lit(","), months))
    entry = orders.groupBy("o_custkey", "o_orderstatus").agg(F.concat(F.lit('{"url":"http://example.org/'), F.first("o_orderstatus"), F.lit("/"), F.first("o_custkey").cast("string"), F.lit('?x=1","dictionary":["2024-01-01"],'), asked, F.lit("}")).alias("entry"))
    return _document(entry, ["o_custkey"], F.col("entry"), ["o_orderstatus"], ",", "[", "]").select("content")


_ENTRIES = "e AS (SELECT 'http://example.org/' || o_orderstatus || '/' || o_custkey || '?x=1' AS url, o_orderstatus AS s, list(DISTINCT strftime(o_orderdate, '%Y-%m-%d')) AS days, min(date_trunc('month', o_orderdate)) AS a, max(date_trunc('month', o_orderdate)) AS b FROM orders GROUP BY o_custkey, o_orderstatus)"
_PLANNED = "SELECT url, 'day' AS kind, unnest(days) AS item FROM e WHERE s = 'O' UNION ALL SELECT url, 'month', strftime(unnest(generate_series(a + INTERVAL 1 month, b, INTERVAL 1 month)), '%Y-%m') FROM e WHERE s = 'F' UNION ALL SELECT url, 'dictionary', '2024-01-01' FROM e WHERE s IN ('O', 'F') UNION ALL SELECT url, 'rejected', NULL FROM e WHERE s NOT IN ('O', 'F')"


def _tasks(v: Views) -> DataFrame:
    return catalog.expand_plan(catalog.read_plan(_plan_files(v)))


@query("plan_expand", "", f"WITH {_ENTRIES} {_PLANNED}")
def plan_expand(v: Views) -> DataFrame:
    return _tasks(v)


@query("plan_idle_excludes", "", f"WITH {_ENTRIES} SELECT url, strftime(a - INTERVAL 1 month, '%Y-%m') AS item FROM e WHERE s = 'F' UNION ALL SELECT url, strftime(b + INTERVAL 1 month, '%Y-%m') FROM e WHERE s = 'F'")
def plan_idle_excludes(v: Views) -> DataFrame:
    """Each range also excludes the month before its first and the one after its last, which change nothing."""
    month = lambda c, n: F.date_format(F.add_months(F.to_date(F.concat(c, F.lit("-01"))), n), "yyyy-MM")
    entries = catalog.read_plan(_plan_files(v)).withColumn("exclude", F.when(F.col("exclude").isNotNull(), F.concat("exclude", F.array(month(F.get("range", F.lit(0)), -1), month(F.get("range", F.lit(1)), 1)))))
    return catalog.expand_plan(entries).where("kind = 'idle exclude'").select("url", "item")


_SIZED = f"t AS ({_PLANNED}), z AS (SELECT url, kind, item, CASE WHEN kind = 'month' THEN NULL ELSE 100 * length(url) END AS size FROM t WHERE kind <> 'rejected')"


def _sized_tasks(v: Views) -> DataFrame:
    return _tasks(v).where("kind <> 'rejected'").withColumn("size", F.when(F.col("kind") != "month", (100 * F.length("url")).cast("long")))


@query("plan_totals", "", f"WITH {_ENTRIES}, {_SIZED} SELECT url, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (size IS NULL) AS n_unknown FROM z GROUP BY ROLLUP (url)")
def plan_totals(v: Views) -> DataFrame:
    return catalog.plan_totals(_sized_tasks(v))


@query("plan_pending", "", f"WITH {_ENTRIES}, {_SIZED} SELECT url, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (size IS NULL) AS n_unknown FROM z WHERE NOT (kind = 'day' AND right(item, 1) IN ('0', '2', '4', '6', '8')) GROUP BY ROLLUP (url)")
def plan_pending(v: Views) -> DataFrame:
    """Totals of what is still to do where the outputs of even days are present."""
    tasks = _sized_tasks(v)
    done = tasks.where("kind = 'day' and right(item, 1) in ('0', '2', '4', '6', '8')")
    return catalog.plan_totals(catalog.pending(tasks, done, ["url", "kind", "item"]))


@query("sampled_estimate", "", "SELECT url, n, round(CASE WHEN n > 20 THEN m * n ELSE s END, 4) AS bytes FROM (SELECT url, count(*) AS n, sum(size) AS s, avg(size) FILTER (place <= 5) AS m FROM (SELECT l_suppkey AS url, l_partkey AS size, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey % 97, l_orderkey, l_linenumber) AS place FROM lineitem) GROUP BY url)")
def sampled_estimate(v: Views) -> DataFrame:
    tasks = v.table("lineitem").select(F.col("l_suppkey").alias("url"), F.col("l_partkey").alias("size"), "l_orderkey", "l_linenumber")
    return catalog.estimated_sizes(tasks, order=[F.col("l_orderkey") % 97, "l_orderkey", "l_linenumber"]).withColumn("bytes", F.round("bytes", 4))


@query("plan_items", "", "SELECT o_orderkey AS k, item, kind, strftime(a, '%Y-%m-%d') AS first_day, strftime(CASE WHEN kind = 'month' THEN last_day(a) ELSE a END, '%Y-%m-%d') AS last_day FROM (SELECT *, CASE WHEN m = 0 THEN 'month' WHEN m = 1 THEN 'day' WHEN m = 2 THEN 'stamp' ELSE 'bad' END AS kind, CASE WHEN m = 0 THEN date_trunc('month', d) WHEN m IN (1, 2) THEN d END AS a, CASE WHEN m = 0 THEN strftime(d, '%Y-%m') WHEN m = 1 THEN strftime(d, '%Y-%m-%d') WHEN m = 2 THEN strftime(d, '%Y%m%d') ELSE strftime(d, '%d/%m/%Y') END AS item FROM (SELECT o_orderkey, o_orderkey % 4 AS m, CAST(o_orderdate AS DATE) AS d FROM orders))")
def plan_items(v: Views) -> DataFrame:
    item = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy-MM")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    rows = v.table("orders").select(F.col("o_orderkey").alias("k"), item.alias("item"))
    return rows.select("k", "item", scalar.item_kind(F.col("item")).alias("kind"), scalar.item_first_day(F.col("item")).cast("string").alias("first_day"), scalar.item_last_day(F.col("item")).cast("string").alias("last_day"))


def _coverage_files(v: Views) -> DataFrame:
    """A response per customer: bundles by order, timestamps by order date, a version count that is one too large for some."""
    orders = v.table("orders").withColumn("stamp", F.date_format("o_orderdate", "yyyyMMdd-HHmm")).withColumn("period", F.element_at(F.array(*map(F.lit, "DMX")), (F.col("o_orderkey") % 3 + 1).cast("int")))
    file = F.concat(F.lit('{"timestamp":"'), "stamp", F.lit('","period":"'), "period", F.lit('","size":'), F.col("o_orderkey").cast("string"), F.lit("}"))
    found = orders.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list(file)), ",").alias("files"), F.array_join(F.sort_array(F.collect_list("stamp")), '","').alias("stamps"), F.count("*").alias("n"), F.sum("o_orderkey").alias("size"))
    versions = (F.col("n") + (F.col("o_custkey") % 2)).cast("string")
    return found.select(F.col("o_custkey").cast("string").alias("url"), F.concat(F.lit('{"data-files":['), "files", F.lit('],"timestamps":["'), "stamps", F.lit('"],"version-count":'), versions, F.lit(',"total-size":'), F.col("size").cast("string"), F.lit("}")).alias("content"))


@query("coverage_tables", "", "SELECT CAST(o_custkey AS VARCHAR) AS url, count(*) + o_custkey % 2 AS version_count, CAST(sum(o_orderkey) AS BIGINT) AS total_size, count(*) AS listed, count(*) AS n_bundles, CAST(sum(o_orderkey) AS BIGINT) AS bytes, min(strftime(o_orderdate, '%Y%m%d-%H%M')) AS first FROM orders GROUP BY o_custkey")
def coverage_tables(v: Views) -> DataFrame:
    resources, bundled, snapshots = catalog.read_coverage(_coverage_files(v))
    sums = bundled.groupBy("url").agg(F.count("*").alias("n_bundles"), F.sum("size").alias("bytes"))
    return resources.join(sums, "url").join(snapshots.groupBy("url").agg(F.min("timestamp").alias("first")), "url")


@query("listing_truncated", "", "SELECT CAST(o_custkey AS VARCHAR) AS url, o_custkey % 2 = 1 AS truncated FROM orders GROUP BY o_custkey")
def listing_truncated(v: Views) -> DataFrame:
    return catalog.listing_truncated(catalog.read_coverage(_coverage_files(v))[0]).select("url", "truncated")


_ITEMS = "SELECT CAST(o_custkey AS VARCHAR) AS k, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderkey % 3 = {}"


def _coverage_sql() -> str:
    from stormlane.plans.queries import _collapse_sql

    months, days = (_collapse_sql(u, _ITEMS.format(m).removeprefix("SELECT ")) for u, m in (("month", 1), ("day", 0)))
    return f"SELECT CAST(o.k AS VARCHAR) AS url, concat_ws('; ', 'versions: ' || (n + o.k % 2), 'months: ' || m.ranges, 'days: ' || d.ranges, 'other: ' || x) AS line FROM (SELECT o_custkey AS k, count(*) AS n, nullif(count(*) FILTER (o_orderkey % 3 = 2), 0) AS x FROM orders GROUP BY o_custkey) o LEFT JOIN ({months}) m ON m.k = CAST(o.k AS VARCHAR) LEFT JOIN ({days}) d ON d.k = CAST(o.k AS VARCHAR)"


@query("coverage_brief", "", _coverage_sql())
def coverage_brief(v: Views) -> DataFrame:
    resources, bundled, _ = catalog.read_coverage(_coverage_files(v))
    return catalog.coverage_brief(resources, bundled)


@query("doc_dates", "", f"WITH {_ENTRIES} SELECT url, array_to_string(list_sort(days), ' ') AS dates FROM e WHERE s = 'O'")
def doc_dates(v: Views) -> DataFrame:
    return catalog.doc_dates(_tasks(v).where("kind = 'day'"))


# Column expressions


@query("hour24", "readings", "SELECT event_id, CAST(CAST(time AS DATE) + INTERVAL 1 day AS TIMESTAMP) AS midnight FROM readings")
def hour24(v: Views) -> DataFrame:
    return v.readings.select("event_id", scalar.wall_time(F.year("time"), F.month("time"), F.day("time"), F.lit(24), F.lit(0)).alias("midnight"))


@query("hhmm", "readings", "SELECT event_id, strftime(time, '%H%M') AS clock FROM readings")
def hhmm(v: Views) -> DataFrame:
    return v.readings.select("event_id", scalar.hhmm((F.hour("time") * 100 + F.minute("time")).cast("string")).alias("clock"))


@query("code_map", "", "SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'A' THEN 1 WHEN 'R' THEN 2 WHEN 'B' THEN 3 END AS level, CASE l % 5 WHEN 1 THEN 'Amber' WHEN 2 THEN 'Red' WHEN 3 THEN 'Black' ELSE '' END AS level_name FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE o_orderstatus END AS o_orderstatus, o_orderkey AS l FROM orders)")
def code_map(v: Views) -> DataFrame:
    code = F.when(F.col("o_orderkey") % 3 == 0, "A").when(F.col("o_orderkey") % 3 == 1, "B").otherwise(F.col("o_orderstatus"))
    return v.table("orders").select(F.col("o_orderkey").alias("k"), scalar.level_of(code).alias("level"), scalar.level_name((F.col("o_orderkey") % 5).cast("int")).alias("level_name"))


@query("district_norm", "", "SELECT c_custkey AS k, replace(c_name, '#', ' & ') AS district FROM customer")
def district_norm(v: Views) -> DataFrame:
    raw = F.concat(F.lit(" "), F.regexp_replace("c_name", "#", " and "), F.when(F.col("c_custkey") % 2 == 0, " District ").otherwise(""))
    return v.table("customer").select(F.col("c_custkey").alias("k"), scalar.norm_district(raw).alias("district"))


def _redated(v: Views) -> DataFrame:
    """Every fifth reading is said to start at midnight and carries the day before."""
    late = F.col("event_id") % 5 == 0
    rows = v.readings.withColumn("stated", F.when(late, F.date_sub(F.to_date("time"), 1)).otherwise(F.to_date("time")))
    return rows.withColumn("date", scalar.redate(F.col("stated"), F.when(late, "00:00:00").otherwise("12:00:00"), F.col("time")))


@query("redate_midnight", "readings", "SELECT event_id, CAST(time AS DATE) AS date FROM readings")
def redate_midnight(v: Views) -> DataFrame:
    return _redated(v).select("event_id", "date")


@query("repeat_report", "readings", "SELECT count(*) AS n_rows, count(*) - count(DISTINCT (date_trunc('hour', time), detector_id, lane_id)) AS n_duplicate, count(*) FILTER (event_id % 5 = 0) AS n_redated FROM readings")
def repeat_report(v: Views) -> DataFrame:
    """Readings of one detector and lane within an hour count as repeats of each other."""
    hourly = _redated(v).withColumn("time", F.date_trunc("hour", "time"))
    return cleaning.repeat_report(hourly, stated="stated", dated="date")


@query("hkt_convert", "readings", "SELECT event_id, time + INTERVAL 8 hours AS local FROM readings")
def hkt_convert(v: Views) -> DataFrame:
    return v.readings.select("event_id", scalar.to_local(F.col("time")).alias("local"))


@query("url_path", "", "SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages")
def url_path(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", scalar.url_path(F.col("url")).alias("path"))


@query("slot_key", "readings holidays", "SELECT event_id, CAST(hour(time) * 4 + minute(time) // 15 AS INTEGER) AS slot, CASE WHEN h.date IS NOT NULL THEN 'holiday' WHEN isodow(time) >= 6 THEN 'weekend' ELSE 'working' END AS day_type FROM readings LEFT JOIN holidays h ON h.date = CAST(time AS DATE)")
def slot_key(v: Views) -> DataFrame:
    from stormlane.operators.align import calendar_join

    return calendar_join(v.readings, v.days).select("event_id", scalar.slot(F.col("time")).alias("slot"), "day_type")


# What the readers leave out


def _route_file(v: Views) -> DataFrame:
    """Segment and route of the parts above size 10 as CSV bytes, a file per size."""
    line = F.concat_ws(",", F.col("p_partkey").cast("string"), F.col("p_brand"))
    lines = _document(v.table("part").where("p_size > 10"), ["p_size"], line, ["p_partkey"], "\r\n", "\ufeffSEGMENT,ROUTE\r\n", "\r\n\r\n")
    return lines.select(F.encode("content", "UTF-8").alias("content"))


@query("route_file_match_rate", "", "SELECT p_brand AS route, count(*) AS n, count(s_suppkey) AS n_matched, round(count(s_suppkey) / count(*), 6) AS match_rate FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10 LEFT JOIN supplier ON l_partkey = s_suppkey AND s_acctbal > 0 GROUP BY p_brand")
def route_file_match_rate(v: Views) -> DataFrame:
    """Segments joined with the routes of a file that is read."""
    segments = v.table("lineitem").select(F.col("l_partkey").cast("string").alias("segment_id"))
    centre = v.table("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("segment_id"))
    return align.segment_route(segments, parse.read_dimension(_route_file(v), columns=parse.ROUTES), centre).withColumn("match_rate", F.round("match_rate", 6))


def _damaged(v: Views) -> list[DataFrame]:
    """The rejects of archives with known damage: which orders, order lines, customers or suppliers are damaged goes by their numbers."""
    o, lines, text = v.table("orders"), v.table("lineitem"), lambda c: F.col(c).cast("string")
    order, customer = F.col("o_orderkey") % 10, F.col("o_custkey") % 7
    event = F.concat(F.lit('{"dtstart":["'), F.when(order == 0, "20241399").otherwise("20240105"), F.lit('"],"summary":"'), F.when(order == 1, " ").otherwise("x"), F.lit('"}'))
    calendars = _document(o.select("o_custkey", "o_orderkey", event.alias("e")), ["o_custkey"], F.col("e"), ["o_orderkey"], ",", '{"vcalendar":[{"vevent":[', "]}]}").withColumn("content", F.when(customer == 0, F.substring("content", 1, 20)).otherwise(F.col("content")))
    message = F.concat(F.lit("<message>"), F.when(order == 2, "").otherwise("<id>1</id>"), F.lit("<status>NEW</status><time>"), F.when(order == 3, "soon").otherwise("2024-01-05T10:00:00"), F.lit("</time></message>"))
    news = _document(o.select("o_custkey", "o_orderkey", message.alias("m")), ["o_custkey"], F.col("m"), ["o_orderkey"], "", "<list>", "</list>")
    segment = F.concat(F.lit("<segment>"), F.when(F.col("l_linenumber") == 3, "").otherwise("<segment_id>5</segment_id>"), F.lit("<speed>40.5</speed><valid>Y</valid></segment>"))
    snapshots = _document(lines.select("l_orderkey", "l_linenumber", segment.alias("s")), ["l_orderkey"], F.col("s"), ["l_linenumber"], "", "", "").withColumn("content", F.concat(F.lit("<list><date>2024-01-05</date><time>"), F.when(F.col("l_orderkey") % 10 == 4, "later").otherwise("10:00:00"), F.lit("</time><segments>"), "content", F.lit("</segments></list>")))
    place = F.concat_ws(",", text("s_suppkey"), F.lit("North"), F.lit("Road"), F.when(F.col("s_suppkey") % 9 == 0, "north").otherwise("22.3"), F.lit("114.1"))
    suppliers = v.table("supplier").withColumn("of", F.col("s_suppkey") % 4)
    dimension = _document(suppliers, ["of"], place, ["s_suppkey"], "\n", "id,district,road,lat,lon\n", "\n").select("of", F.encode("content", "UTF-8").alias("content"))
    cell = F.when(F.col("l_linenumber") == 5, "20240101,1.5").otherwise(F.concat(F.when(F.col("l_orderkey") % 10 == 5, "202413010000").otherwise("202401010000"), F.lit(",202401010030,22.3,114.1,"), F.when(F.col("l_linenumber") == 4, "much").otherwise("1.5")))
    day = F.concat(F.when(order == 6, "2024,2,30").otherwise("2024,2,3"), F.lit(","), F.when(order == 7, "much").when(order == 8, "Trace").when(order == 9, "***").otherwise("2.5"), F.lit(",C"))
    lane = F.concat(F.lit("<lane><lane_id>Fast</lane_id><speed>"), F.when(customer == 3, "fast").otherwise("50"), F.lit("</speed><valid>Y</valid></lane>"))
    document = F.concat(F.lit("<raw_speed_volume_list><date>2024-05-01</date><periods><period><period_from>08:00:00</period_from><detectors><detector><detector_id>D</detector_id><lanes>"), lane, F.lit("</lanes></detector></detectors></period></periods>"), F.when(customer == 2, "").otherwise("</raw_speed_volume_list>"))
    persons = o.select("o_custkey").distinct()
    sentence = F.when(F.col("o_custkey") % 5 == 0, "Fine.").otherwise("Between 9:45 a.m. and 10:45 a.m. the rainfall was:\n North District 5 mm")
    response = F.when(customer == 1, '{"data-files":').otherwise('{"data-files":[],"timestamps":[]}')
    return [
        rejects.calendar_rejects(calendars, "o_custkey"),
        rejects.news_rejects(news, "o_custkey"),
        rejects.segment_rejects(snapshots, "l_orderkey"),
        rejects.dimension_rejects(dimension, "of"),
        rejects.grid_rejects(lines.select("l_orderkey", "l_linenumber", cell.alias("value")), "l_orderkey", "l_linenumber"),
        rejects.daily_rain_rejects(o.select("o_custkey", (F.col("o_orderkey") % 1000).alias("n"), day.alias("value")), "o_custkey", "n"),
        rejects.reading_rejects(persons.select("o_custkey", document.alias("content")), "o_custkey"),
        rejects.bulletin_rejects(persons.select("o_custkey", sentence.alias("text")), "o_custkey"),
        rejects.coverage_rejects(persons.select("o_custkey", response.alias("content")), "o_custkey"),
        rejects.log_rejects(_signal_logs(v), "month", "signals"),
        rejects.log_rejects(_tc_logs(v), "month", "tc"),
    ]


_PERSONS = "(SELECT DISTINCT o_custkey FROM orders)"


@query("reject_counters", "signals cyclones", f"""SELECT source, reason, n FROM (SELECT 'calendar' AS source, 'json' AS reason, count(*) AS n FROM {_PERSONS} WHERE o_custkey % 7 = 0
UNION ALL SELECT 'calendar', CASE o_orderkey % 10 WHEN 0 THEN 'date' ELSE 'name' END, count(*) FROM orders WHERE o_custkey % 7 <> 0 AND o_orderkey % 10 IN (0, 1) GROUP BY ALL
UNION ALL SELECT 'news', CASE o_orderkey % 10 WHEN 2 THEN 'id' ELSE 'time' END, count(*) FROM orders WHERE o_orderkey % 10 IN (2, 3) GROUP BY ALL
UNION ALL SELECT 'segments', 'time', count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey % 10 = 4
UNION ALL SELECT 'segments', 'segment_id', count(*) FROM lineitem WHERE l_linenumber = 3
UNION ALL SELECT 'dimension', 'columns', count(*) FROM supplier WHERE s_suppkey % 9 = 0
UNION ALL SELECT 'grid', CASE WHEN l_linenumber = 5 THEN 'shape' WHEN l_orderkey % 10 = 5 THEN 'time' ELSE 'number' END, count(*) FROM lineitem WHERE l_linenumber IN (4, 5) OR l_orderkey % 10 = 5 GROUP BY ALL
UNION ALL SELECT 'daily_rain', CASE o_orderkey % 10 WHEN 6 THEN 'date' ELSE 'value' END, count(*) FROM orders WHERE o_orderkey % 10 IN (6, 7) GROUP BY ALL
UNION ALL SELECT 'readings', CASE o_custkey % 7 WHEN 2 THEN 'cut' ELSE 'value' END, count(*) FROM {_PERSONS} WHERE o_custkey % 7 IN (2, 3) GROUP BY ALL
UNION ALL SELECT 'bulletins', 'sentence', count(*) FROM {_PERSONS} WHERE o_custkey % 5 = 0
UNION ALL SELECT 'coverage', 'json', count(*) FROM {_PERSONS} WHERE o_custkey % 7 = 1
UNION ALL SELECT 'signals', 'code', count(DISTINCT strftime("start", '%Y-%m')) FROM signals
UNION ALL SELECT 'tc', 'intensity', count(*) FROM cyclones WHERE signal_id % 5 = 0) WHERE n > 0""")
def reject_counters(v: Views) -> DataFrame:
    return rejects.counted(*_damaged(v))
