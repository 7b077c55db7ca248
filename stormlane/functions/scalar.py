"""Column expressions for wall-clock times, codes, names and request items. All times are zone-less local wall time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Warning codes, their levels and names.
LEVELS = {"A": 1, "R": 2, "B": 3}
LEVEL_NAMES = {1: "Amber", 2: "Red", 3: "Black"}


def _lookup(pairs: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), key)


def level_of(code: Column) -> Column:
    """A, R, B as 1, 2, 3; anything else is null."""
    return _lookup(LEVELS, code)


def level_name(level: Column) -> Column:
    """The name of a level; empty for any other number or null."""
    return F.coalesce(_lookup(LEVEL_NAMES, level), F.lit(""))


def wall_time(year: Column, month: Column, day: Column, hour: Column, minute: Column) -> Column:
    """A time from its parts; hour 24 is midnight at the end of the day. Null if the date does not exist."""
    midnight = F.try_make_timestamp_ntz(year, month, day, F.lit(0), F.lit(0), F.lit(0))
    return midnight + F.make_dt_interval(F.lit(0), hour, minute)


def hhmm(value: Column) -> Column:
    """A time of day of one to four digits as four digits."""
    return F.lpad(F.trim(value), 4, "0")


def clean_text(value: Column) -> Column:
    """Without a leading byte order mark."""
    return F.regexp_replace(value, "^\\uFEFF", "")


def norm_district(name: Column) -> Column:
    """District names as the dimension has them: no ' District' at the end, '&' for 'and'."""
    short = F.regexp_replace(F.trim(name), " District$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(short, "&amp;", "&"), " and ", " & "))


def redate(date: Column, period_from: Column, archived: Column) -> Column:
    """The date of a period; one that starts at midnight may carry the day before, then the archive's own day counts."""
    day = F.to_date(archived)
    return F.when((period_from == "00:00:00") & (day > date), F.date_add(date, 1)).otherwise(date)


def clock(hour: Column, minute: Column, half: Column) -> Column:
    """Minutes after midnight of a 12-hour clock value; half is a.m., p.m., noon or midnight."""
    first = F.substring(F.lower(half), 1, 1)
    return (hour.cast("int") % 12) * 60 + F.coalesce(minute.cast("int"), F.lit(0)) + F.when(first.isin("p", "n"), 720).otherwise(0)


def latest_clock(minutes: Column, issued: Column) -> Column:
    """The latest time with this clock value that is not after ``issued``."""
    same_day = F.date_trunc("day", issued).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    return F.when(same_day > issued, same_day - F.expr("interval 1 day")).otherwise(same_day)


def to_local(value: Column, zone: str = "Asia/Hong_Kong") -> Column:
    """UTC wall time as wall time of the zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), value)


def member_stamp(name: Column) -> Column:
    """The archive time of a bundle member ``<folder>/<YYYYMMDD-HHMM>-<file>``."""
    return F.try_to_timestamp(F.regexp_extract(name, r"(\d{8}-\d{4})-[^/]*$", 1), F.lit("yyyyMMdd-HHmm")).cast("timestamp_ntz")


def member_file(name: Column) -> Column:
    """The file name of a bundle member, without folder and archive time."""
    return F.regexp_extract(name, r"\d{8}-\d{4}-([^/]*)$", 1)


def url_path(url: Column) -> Column:
    """Host and path of a URL, without scheme and query: where its output goes."""
    return F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://", ""), r"[?#].*$", "")


def item_kind(item: Column) -> Column:
    """month (YYYY-MM), day (YYYY-MM-DD) or stamp (YYYYMMDD); anything else is bad."""
    return (
        F.when(item.rlike(r"^\d{4}-\d{2}$") & F.try_to_date(F.concat(item, F.lit("-01")), "yyyy-MM-dd").isNotNull(), "month")
        .when(item.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(item, "yyyy-MM-dd").isNotNull(), "day")
        .when(item.rlike(r"^\d{8}$") & F.try_to_date(item, "yyyyMMdd").isNotNull(), "stamp")
        .otherwise("bad")
    )


def item_first_day(item: Column) -> Column:
    kind = item_kind(item)
    return F.when(kind == "month", F.try_to_date(F.concat(item, F.lit("-01")), "yyyy-MM-dd")).when(kind == "day", F.try_to_date(item, "yyyy-MM-dd")).when(kind == "stamp", F.try_to_date(item, "yyyyMMdd"))


def item_last_day(item: Column) -> Column:
    return F.when(item_kind(item) == "month", F.last_day(item_first_day(item))).otherwise(item_first_day(item))


def slot(time: Column, minutes: int = 15) -> Column:
    """Number of the time bin within the day."""
    return ((F.hour(time) * 60 + F.minute(time)) / minutes).cast("int")


def day_type(date: Column, is_holiday: Column) -> Column:
    """holiday, weekend or working."""
    return F.when(is_holiday, "holiday").when(F.weekday(date) >= 5, "weekend").otherwise("working")
