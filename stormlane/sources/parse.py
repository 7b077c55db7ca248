"""Readers of archived text: each takes a DataFrame with a text column, one row per file, and returns rows.

No reader infers a schema, collects, or relies on the order of lines beyond their number within a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormlane.functions.scalar import clean_text, clock, hhmm, latest_clock, level_name, level_of, norm_district, wall_time


def _log_lines(files: DataFrame, content: str) -> DataFrame:
    """Trimmed tab-separated fields of each line with a first field, and whether a UUUU line stands before it in its file."""
    lines = F.transform(F.split(clean_text(F.col(content)), "\r\n|\n|\r"), lambda line: F.transform(F.split(line, "\t"), lambda f: F.trim(f)))
    numbered = F.transform(lines, lambda fields, i: F.struct(i.alias("at"), fields.alias("fields"), fields[0].startswith("UUUU").alias("mark")))
    rest = [c for c in files.columns if c != content]
    marked = files.select(*rest, numbered.alias("l")).withColumn("first", F.array_min(F.transform(F.filter("l", lambda x: x["mark"]), lambda x: x["at"])))
    rows = marked.select(*rest, "first", F.explode("l").alias("x"))
    provisional = F.coalesce(F.col("x.at") > F.col("first"), F.lit(False))
    return rows.where("not x.mark and x.fields[0] <> ''").select(*rest, "x.fields", provisional.alias("provisional"))


def _number(fields: Column, k: int) -> Column:
    return F.get(fields, F.lit(k)).try_cast("int")


def read_signals(files: DataFrame, content: str = "content") -> DataFrame:
    """Rainstorm signals: level, level_name, start, end, duration_min (floored), provisional. Lines with another code or fewer
    than eleven fields are left out; dates that don't exist give null times."""
    f = F.col("fields")
    rows = _log_lines(files, content).where(F.get(f, F.lit(0)).isin("A", "R", "B") & (F.size(f) >= 11))
    rows = rows.select(level_of(f[0]).alias("level"), wall_time(*[_number(f, k) for k in range(1, 6)]).alias("start"), wall_time(*[_number(f, k) for k in range(6, 11)]).alias("end"), "provisional")
    return rows.withColumn("level_name", level_name(F.col("level"))).withColumn("duration_min", F.expr("timestampdiff(MINUTE, start, end)"))


def signal_rejects(files: DataFrame, content: str = "content") -> DataFrame:
    """The lines of rainstorm logs that ``read_signals`` leaves out, marker and blank lines apart: the other columns of the file,
    the fields, and why: code (not one of the three) or fields (fewer than eleven)."""
    f = F.col("fields")
    code = F.get(f, F.lit(0)).isin("A", "R", "B")
    reason = F.when(~code, "code").when(F.size(f) < 11, "fields")
    return _log_lines(files, content).drop("provisional").withColumn("reason", reason).where("reason is not null")


def signal_counters(files: DataFrame, file_col: str, content: str = "content") -> DataFrame:
    """Per file (named by ``file_col``) the lines that became rows and those that were rejected; a file without either has zeros."""
    f = F.col("fields")
    good = F.get(f, F.lit(0)).isin("A", "R", "B") & (F.size(f) >= 11)
    lines = _log_lines(files.select(file_col, content), content).groupBy(file_col).agg(F.count_if(good).alias("n_rows"), F.count_if(~good).alias("n_rejected"))
    return files.select(file_col).distinct().join(lines, file_col, "left").fillna(0, ["n_rows", "n_rejected"])


def _tc_reason() -> Column:
    f = F.col("fields")
    return F.when(F.size(f) < 15, "fields").when(F.coalesce(f[1], F.lit("")) == "MSN", "intensity")


def tc_rejects(files: DataFrame, content: str = "content") -> DataFrame:
    """The lines of cyclone logs that ``read_tc`` leaves out, marker and blank lines apart: the other columns of the file, the
    fields, and why: fields (fewer than fifteen) or intensity (MSN)."""
    return _log_lines(files, content).drop("provisional").withColumn("reason", _tc_reason()).where("reason is not null")


def tc_counters(files: DataFrame, file_col: str, content: str = "content") -> DataFrame:
    """As ``signal_counters``, of cyclone logs."""
    lines = _log_lines(files.select(file_col, content), content).withColumn("reason", _tc_reason())
    counts = lines.groupBy(file_col).agg(F.count_if(F.col("reason").isNull()).alias("n_rows"), F.count("reason").alias("n_rejected"))
    return files.select(file_col).distinct().join(counts, file_col, "left").fillna(0, ["n_rows", "n_rejected"])


def read_tc(files: DataFrame, content: str = "content") -> DataFrame:
    """Cyclone signals: tc_code, name, intensity, signal, direction, start, end, provisional. Lines of fewer than fifteen fields
    or of intensity MSN are left out; a name of NIL is empty."""
    f = F.col("fields")
    rows = _log_lines(files, content).where((F.size(f) >= 15) & (f[1] != "MSN"))

    def at(k: int) -> Column:
        time = hhmm(f[k])
        return wall_time(_number(f, k + 3), _number(f, k + 2), _number(f, k + 1), F.substring(time, 1, 2).try_cast("int"), F.substring(time, 3, 2).try_cast("int"))

    name = F.when(f[2].isin("", "NIL"), "").otherwise(f[2])
    return rows.select(f[0].alias("tc_code"), name.alias("name"), f[1].alias("intensity"), f[3].alias("signal"), f[4].alias("direction"), at(5).alias("start"), at(10).alias("end"), "provisional")


def read_calendar(files: DataFrame, content: str = "content") -> DataFrame:
    """Holidays of calendar JSON: date (null if it isn't one) and trimmed name, with the other columns of the file."""
    rest = [c for c in files.columns if c != content]
    events = files.select(*rest, F.explode(F.from_json(clean_text(F.col(content)), CALENDAR)["vcalendar"][0]["vevent"]).alias("e"))
    return events.select(*rest, calendar_date(F.col("e")).alias("date"), F.trim("e.summary").alias("name"))


CALENDAR = "vcalendar array<struct<vevent:array<struct<dtstart:array<string>,summary:string>>>>"


def calendar_date(event: Column) -> Column:
    """The date an event starts on, or null."""
    return F.try_to_date(F.get(event["dtstart"], F.lit(0)), "yyyyMMdd")


LANE = "lane_id string, speed double, occupancy int, volume int, `s.d.` double, valid string"
_LANE = "struct<lane_id:string,speed:double,occupancy:int,volume:int,`s.d.`:double,valid:string>"
_DETECTOR = f"struct<detector_id:string,direction:string,lanes:struct<lane:array<{_LANE}>>>"
READINGS = f"date string, periods struct<period:array<struct<period_from:string,period_to:string,detectors:struct<detector:array<{_DETECTOR}>>>>>"


def read_readings(files: DataFrame, content: str = "content") -> DataFrame:
    """Lane readings of detector XML: date, period_from, period_to, detector_id, direction and the lane's fields; s.d. may be
    absent. Documents that are cut have no rows here, see ``salvage_readings``."""
    rest = [c for c in files.columns if c != content]
    doc = files.select(*rest, F.from_xml(content, READINGS).alias("d")).select(*rest, "d.date", F.explode("d.periods.period").alias("p"))
    detectors = doc.select(*rest, "date", "p.period_from", "p.period_to", F.explode("p.detectors.detector").alias("t"))
    lanes = detectors.select(*rest, "date", "period_from", "period_to", "t.detector_id", "t.direction", F.explode("t.lanes.lane").alias("l"))
    return _lane_columns(lanes, [*rest, "date", "period_from", "period_to", "detector_id", "direction"])


def _lane_columns(rows: DataFrame, keep: list[str]) -> DataFrame:
    return rows.select(*keep, F.col("l.lane_id").alias("lane_id"), F.col("l.speed").alias("speed"), F.col("l.occupancy").alias("occupancy"), F.col("l.volume").alias("volume"), F.col("l.`s.d.`").alias("sd"), F.col("l.valid").alias("valid"))


def is_cut(content: Column) -> Column:
    """Whether a detector document ends before its root element does."""
    return ~F.rtrim(content).rlike(r"</raw_speed_volume_list>\s*$")


def cut_counters(files: DataFrame, content: str = "content") -> DataFrame:
    """(n_files, n_truncated) of detector documents; a null text counts as truncated."""
    return files.agg(F.count("*").alias("n_files"), F.count_if(F.coalesce(is_cut(F.col(content)), F.lit(True))).alias("n_truncated"))


def salvage_readings(files: DataFrame, content: str = "content") -> DataFrame:
    """Every complete lane of cut documents: split at periods, then at detectors, then complete lanes are taken one by one."""
    rest = [c for c in files.columns if c != content]
    one = lambda column, tag: F.regexp_extract(column, f"<{tag}>([^<]*)</{tag}>", 1)
    # a document's and a period's own fields are held in a row of their own, else they would be sought in its text for each of its parts
    held = lambda **fields: F.explode(F.array(F.struct(*[c.alias(name) for name, c in fields.items()])))
    parts = lambda column, tag: F.slice(F.split(column, f"<{tag}>"), 2, 1_000_000_000)
    cut = files.where(is_cut(F.col(content))).select(*rest, held(date=one(F.col(content), "date"), parts=parts(content, "period")).alias("h"))
    periods = cut.select(*rest, "h.date", F.explode("h.parts").alias("p"))
    periods = periods.select(*rest, "date", held(period_from=one(F.col("p"), "period_from"), period_to=one(F.col("p"), "period_to"), parts=parts("p", "detector")).alias("h"))
    detectors = periods.select(*rest, "date", "h.period_from", "h.period_to", F.explode("h.parts").alias("t"))
    lanes = detectors.select(*rest, "date", "period_from", "period_to", one(F.col("t"), "detector_id").alias("detector_id"), one(F.col("t"), "direction").alias("direction"), F.explode(F.regexp_extract_all("t", F.lit("(?s)<lane>.*?</lane>"), F.lit(0))).alias("x"))
    return _lane_columns(lanes.withColumn("l", F.from_xml("x", LANE)), [*rest, "date", "period_from", "period_to", "detector_id", "direction"])


def read_archive(files: DataFrame, content: str = "content") -> DataFrame:
    """Lane readings of whole documents and what is whole within cut ones, in one job; the columns of ``read_readings``."""
    whole = files.where(~is_cut(F.col(content)))
    return read_readings(whole, content).unionByName(salvage_readings(files, content))


DIMENSION = "detector_id string, district string, road string, latitude double, longitude double"


def dimension_lines(files: DataFrame, content: str) -> DataFrame:
    """The lines behind the header that aren't blank, with their number from 0, and whether their file is wide (UTF-16)."""
    rest = [c for c in files.columns if c != content]
    wide = F.substring(content, 1, 2).isin(bytearray(b"\xff\xfe"), bytearray(b"\xfe\xff"))
    text = F.when(wide, F.decode(content, "UTF-16")).otherwise(F.decode(content, "UTF-8"))
    lines = F.slice(F.split(clean_text(text), "\r\n|\n"), 2, 1_000_000_000)
    return files.select(*rest, wide.alias("wide"), F.posexplode(lines).alias("number", "line")).where("trim(line) <> ''")


def read_dimension(files: DataFrame, content: str = "content", columns: str = DIMENSION) -> DataFrame:
    """Rows of dimension CSVs given as bytes, with the other columns of the file (its version, say). UTF-16 with a byte order
    mark is tab-separated, UTF-8 comma-separated. The header and blank lines are left out, fields are trimmed. ``columns`` may be
    those of another table, such as ``ROUTES``."""
    rest = [c for c in files.columns if c != content]
    held = files.select(F.struct(*rest).alias("file") if rest else F.lit(None).alias("file"), F.col(content).alias("content"))
    options = {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    parsed = F.when(F.col("wide"), F.from_csv("line", columns, {"sep": "\t", **options})).otherwise(F.from_csv("line", columns, options))
    return dimension_lines(held, "content").select(*[F.col("file")[c].alias(c) for c in rest], parsed.alias("r")).select(*rest, "r.*")


#: Columns of the segment-to-route table.
ROUTES = "segment_id string, route string"


_CLOCK = r"(\d{1,2})(?::(\d{2}))?\s*(a\.m\.|p\.m\.|noon|midnight)"
PERIOD = rf"(?i)between\s+(\d{{1,2}})(?::(\d{{2}}))?\s*(a\.m\.|p\.m\.|noon|midnight)?\s+and\s+{_CLOCK}"
_RAIN = r"(?m)^\s*([A-Z][A-Za-z&; ]*?)\s+(\d+)(?:\s+to\s+(\d+))?\s*mm"


def read_bulletins(files: DataFrame, text: str = "text", issued: str = "issued") -> DataFrame:
    """Rain per district of bulletin texts: issued, end of the period, district, min_mm, max_mm. One amount is both. The stated
    end is the latest such clock time not after the issue time. Bulletins without the sentence have no rows."""
    end = [F.regexp_extract(text, PERIOD, k) for k in (4, 5, 6)]
    minutes = clock(end[0], F.when(end[1] != "", end[1]), end[2])
    rows = files.where(F.col(text).rlike(PERIOD)).select(issued, latest_clock(minutes, F.col(issued)).alias("period_end"), F.explode(F.regexp_extract_all(text, F.lit(_RAIN), F.lit(0))).alias("x"))
    part = lambda k: F.regexp_extract("x", _RAIN, k)
    low = part(2).cast("int")
    return rows.select(issued, "period_end", norm_district(part(1)).alias("district"), low.alias("min_mm"), F.coalesce(part(3).try_cast("int"), low).alias("max_mm"))


DAY_LINE = r'^\s*"?\d{4}"?,"?\d{1,2}"?,"?\d{1,2}"?,'


def made_date(year: str, month: str, day: str) -> Column:
    """The date, or null if there is no such day."""
    return F.try_to_date(F.concat_ws("-", year, month, day), "y-M-d")


def read_daily_rain(lines: DataFrame, line: str = "value") -> DataFrame:
    """Daily totals of CSV lines: date, mm, trace, completeness. Only lines that begin with year, month and day count; Trace is
    0 and flagged, *** is null; a day that doesn't exist has a null date."""
    rows = lines.where(F.col(line).rlike(DAY_LINE)).select(F.from_csv(line, "y int, m int, d int, v string, c string").alias("r")).select("r.*")
    value = F.trim("v")
    return rows.select(made_date("y", "m", "d").alias("date"), F.when(value == "Trace", 0.0).otherwise(value.try_cast("double")).alias("mm"), (value == "Trace").alias("trace"), F.trim("c").alias("completeness"))


def read_segments(files: DataFrame, content: str = "content") -> DataFrame:
    """Segment speeds of XML snapshots: time, segment_id, speed, valid."""
    doc = files.select(F.from_xml(content, SEGMENTS).alias("d")).select(segment_time().alias("time"), F.explode("d.segments.segment").alias("s"))
    return doc.select("time", "s.segment_id", "s.speed", "s.valid")


SEGMENTS = "date string, time string, segments struct<segment:array<struct<segment_id:string,speed:double,valid:string>>>"


def segment_time() -> Column:
    """The time of a parsed snapshot ``d``, or null if it can't be read."""
    return F.try_to_timestamp(F.concat_ws(" ", "d.date", "d.time")).cast("timestamp_ntz")


def read_news(files: DataFrame, content: str = "content") -> DataFrame:
    """Messages of traffic-news XML: id, status, time, heading, district (may be absent)."""
    rows = files.select(F.explode(F.from_xml(content, NEWS)["message"]).alias("m"))
    return rows.select("m.id", "m.status", news_time(F.col("m.time")).alias("time"), "m.heading", "m.district")


NEWS = "message array<struct<id:string,status:string,time:string,heading:string,district:string>>"


def news_time(value: Column) -> Column:
    """The time of a message, or null if it can't be read."""
    return F.try_to_timestamp(value).cast("timestamp_ntz")


GRID_LINE = r"^\d{12},\d{12},"
GRID = "u string, e string, lat double, lon double, rain double"


def grid_time(value: Column) -> Column:
    return F.try_to_timestamp(value, F.lit("yyyyMMddHHmm")).cast("timestamp_ntz")


def read_grid(lines: DataFrame, line: str = "value") -> DataFrame:
    """Nowcast cells of CSV lines: updated, ending, lat, lon, rain and the lead time in minutes; header lines are left out, times that
    don't exist are null."""
    rows = lines.where(F.col(line).rlike(GRID_LINE)).select(F.from_csv(line, GRID).alias("r")).select("r.*")
    out = rows.select(grid_time(F.col("u")).alias("updated"), grid_time(F.col("e")).alias("ending"), "lat", "lon", "rain")
    return out.withColumn("lead_min", F.expr("timestampdiff(MINUTE, updated, ending)"))
