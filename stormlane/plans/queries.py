"""One function per registered query; each takes the views of one folder of tables and has SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormlane.operators import align, catalog, cleaning, days, intervals, modelling, study
from stormlane.plans.views import Views, with_views
from stormlane.sources.tables import kept

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Queries with a column date.
_DATED = {"latest_wins", "calendar_join", "prev_week_ratio", "coverage_daily", "event_days", "excluded_days", "select_days", "event_days_all", "excluded_days_all", "select_days_all", "select_days_black", "parse_calendar", "read_daily_rain", "pending_partitions", "redate_midnight"}


def query(name: str, views: str = "", sql: str | None = None):
    """Registers a function of Views under a name, with its SQL over the named views. Dates are returned as text."""

    def put(function):
        def run(spark, sf_dir):
            out = function(Views(spark, sf_dir))
            return out.withColumns({c: F.col(c).cast("string") for c, kind in out.dtypes if kind == "date"})

        QUERIES[name] = run
        if sql:
            whole = with_views(views, sql)
            dated = name in _DATED
            ORACLE_SQL[name] = f"SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM ({whole})" if dated else whole
        return function

    return put


def _r(column: str, digits: int = 6):
    return F.round(F.col(column).cast("double"), digits).alias(column)


# Cleaning

_ROW = "event_id, time, detector_id, lane_id, speed, occupancy, volume"


@query("valid_drop_lane", "readings", f"SELECT {_ROW} FROM readings WHERE valid = 'Y'")
def valid_drop_lane(v: Views) -> DataFrame:
    return cleaning.filter_valid(v.readings).drop("valid")


@query("valid_drop_period", "readings", "SELECT event_id, hour AS time, detector_id FROM (SELECT *, date_trunc('hour', time) AS hour FROM readings) WHERE (hour, detector_id) NOT IN (SELECT (date_trunc('hour', time), detector_id) FROM readings WHERE valid <> 'Y')")
def valid_drop_period(v: Views) -> DataFrame:
    hourly = v.readings.withColumn("time", F.date_trunc("hour", "time").cast("timestamp_ntz"))
    return cleaning.filter_valid(hourly, "drop_period").select("event_id", "time", "detector_id")


@query("bounds_filter", "readings", f"SELECT event_id, CASE WHEN speed BETWEEN 0 AND 130 THEN speed END AS speed, CASE WHEN occupancy BETWEEN 0 AND 100 THEN occupancy END AS occupancy FROM readings")
def bounds_filter(v: Views) -> DataFrame:
    return cleaning.filter_bounds(v.readings).select("event_id", "speed", "occupancy")


@query("placeholder_null", "readings", "SELECT event_id, CASE WHEN volume <> 0 THEN speed END AS speed FROM readings")
def placeholder_null(v: Views) -> DataFrame:
    return cleaning.null_placeholder(v.readings).select("event_id", "speed")


_STUCK = """SELECT event_id, run, max(time) OVER w - min(time) OVER w > INTERVAL 6 hours AS stuck FROM (SELECT *, sum(changed) OVER (PARTITION BY detector_id ORDER BY time, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN band = lag(band) OVER (PARTITION BY detector_id ORDER BY time, event_id) THEN 0 ELSE 1 END AS changed FROM (SELECT *, floor(speed / 40) AS band FROM readings))) WINDOW w AS (PARTITION BY detector_id, run)"""


def _banded(v: Views) -> DataFrame:
    return v.readings.withColumn("band", F.floor(F.col("speed") / 40))


@query("stuck_runs", "readings", f"SELECT event_id, CAST(run AS BIGINT) AS run, stuck FROM ({_STUCK})")
def stuck_runs(v: Views) -> DataFrame:
    return cleaning.stuck_runs(_banded(v), ["detector_id"], "band", "6 hours", "week").select("event_id", F.col("run").cast("long").alias("run"), "stuck")


@query("stuck_drop_day", "readings", f"SELECT event_id FROM readings WHERE (detector_id, CAST(time AS DATE)) NOT IN (SELECT (detector_id, CAST(time AS DATE)) FROM readings WHERE event_id IN (SELECT event_id FROM ({_STUCK}) WHERE stuck))")
def stuck_drop_day(v: Views) -> DataFrame:
    return cleaning.drop_stuck_days(_banded(v), ["detector_id"], "band", "6 hours", "week").select("event_id")


@query("robust_z", "readings", "SELECT event_id, coalesce(0.6745 * off / nullif(mad, 0) > 3.5, false) AS outlier FROM (SELECT *, median(off) OVER (PARTITION BY detector_id) AS mad FROM (SELECT *, abs(speed - median(speed) OVER (PARTITION BY detector_id)) AS off FROM readings))")
def robust_z(v: Views) -> DataFrame:
    return cleaning.robust_z(v.readings).select("event_id", "outlier")


@query("iqr_filter", "readings", "SELECT event_id FROM readings JOIN (SELECT detector_id, quantile_cont(speed, 0.25) AS a, quantile_cont(speed, 0.75) AS b FROM readings GROUP BY detector_id) USING (detector_id) WHERE speed BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)")
def iqr_filter(v: Views) -> DataFrame:
    return cleaning.iqr_filter(v.readings).select("event_id")


def _snapshots(v: Views) -> DataFrame:
    """Each reading in the hourly snapshots of its own and of the next hour."""
    return v.readings.withColumn("archived", F.explode(F.array(*[(F.date_trunc("hour", "time").cast("timestamp_ntz") + F.expr(f"interval {k} hours")) for k in (1, 2)])))


@query("dedup_overlap", "readings", f"SELECT {_ROW}, date_trunc('hour', time) + INTERVAL 2 hours AS archived FROM readings")
def dedup_overlap(v: Views) -> DataFrame:
    return cleaning.dedup_overlap(_snapshots(v)).select(*_ROW.split(", "), "archived")


@query("latest_wins", "holidays", "SELECT date, CASE WHEN n % 2 = 0 THEN name || ' (moved)' ELSE name END AS name FROM holidays")
def latest_wins(v: Views) -> DataFrame:
    old = v.holidays.select("date", "name", F.lit(1).alias("version"))
    new = v.holidays.where("n % 2 = 0").select("date", F.concat("name", F.lit(" (moved)")).alias("name"), F.lit(2).alias("version"))
    return cleaning.latest_wins(old.unionByName(new), "date", "version").select("date", "name")


_MEMBERS = "SELECT '20240101-0001-' || l_orderkey || '.xml' AS name, l_suppkey % 3 AS checksum, min(l_linenumber) AS position FROM lineitem GROUP BY ALL"


@query("version_suffix", "", f"SELECT name, CAST(copy AS INTEGER) AS copy, CAST(checksum AS BIGINT) AS checksum, CASE WHEN copy = 1 THEN name ELSE '20240101-0001_' || copy || substr(name, 14) END AS stored_as FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY position, checksum) AS copy FROM ({_MEMBERS}))")
def version_suffix(v: Views) -> DataFrame:
    name = F.concat(F.lit("20240101-0001-"), F.col("l_orderkey").cast("string"), F.lit(".xml"))
    members = v.table("lineitem").select(name.alias("name"), (F.col("l_suppkey") % 3).alias("checksum"), F.struct(F.col("l_linenumber").alias("line"), (F.col("l_suppkey") % 3).alias("checksum")).alias("position"))
    return cleaning.version_suffix(members).select("name", "copy", "checksum", "stored_as")


@query("quality_report", "readings", "SELECT count(*) AS n_rows, count(*) FILTER (valid <> 'Y') AS n_invalid, count(*) FILTER (NOT speed BETWEEN 0 AND 130) AS n_speed_out, count(*) FILTER (NOT occupancy BETWEEN 0 AND 100) AS n_occupancy_out, count(*) FILTER (volume = 0) AS n_placeholder, count(*) FILTER (speed = 0 AND volume > 0) AS n_still_with_volume, count(*) FILTER (occupancy = -1) AS n_no_occupancy FROM readings")
def quality_report(v: Views) -> DataFrame:
    return cleaning.quality_report(v.readings)


_KEPT = "r WHERE CAST(time AS DATE) NOT IN (SELECT date FROM holidays) AND NOT EXISTS (SELECT 1 FROM cyclones s WHERE time >= s.\"start\" AND time < s.\"end\")"


@query("exclude_confounders", "readings holidays cyclones", f"SELECT event_id FROM readings {_KEPT}")
def exclude_confounders(v: Views) -> DataFrame:
    return align.exclude_days(v.readings, v.days, v.cyclones).select("event_id")


@query("exclude_incidents", "readings", """SELECT event_id FROM readings r WHERE NOT EXISTS (SELECT 1 FROM (SELECT detector_id, min(time) AS "start", coalesce(min(time) FILTER (lane_id = 'purchase'), min(time) + INTERVAL 1 day) AS "end" FROM readings WHERE lane_id IN ('error', 'purchase') GROUP BY detector_id, CAST(time AS DATE)) i WHERE time >= i."start" AND time < i."end" AND i.detector_id = r.detector_id)""")
def exclude_incidents(v: Views) -> DataFrame:
    some = v.readings.where("lane_id in ('error', 'purchase')")
    news = some.groupBy("detector_id", F.to_date("time").alias("day")).agg(F.min("time").alias("start"), F.min(F.when(F.col("lane_id") == "purchase", F.col("time"))).alias("closed"))
    incidents = news.select(F.col("detector_id").alias("where"), "start", F.col("closed").alias("end"))
    return intervals.exclude_incidents(v.readings, incidents, {"detector_id": "where"}).select("event_id")


# Joins


@query("join_detector", "readings detectors", "SELECT event_id, detector_id, road, district FROM readings JOIN detectors USING (detector_id)")
def join_detector(v: Views) -> DataFrame:
    return align.join_detector(v.readings, v.detectors).select("event_id", "detector_id", "road", "district")


@query("unmatched_ids", "readings detectors", "SELECT DISTINCT detector_id, 'readings' AS side FROM readings WHERE detector_id NOT IN (SELECT detector_id FROM detectors) UNION ALL SELECT detector_id, 'dimension' FROM detectors WHERE detector_id NOT IN (SELECT detector_id FROM readings)")
def unmatched_ids(v: Views) -> DataFrame:
    return align.unmatched_ids(v.readings, v.detectors)


@query("asof_version", "versions probes", 'SELECT order_no, line_no, p."key" AS "key", p.time AS time, valid_from, version FROM probes p ASOF LEFT JOIN versions v ON p."key" = v."key" AND p.time >= v.valid_from')
def asof_version(v: Views) -> DataFrame:
    return align.asof_version(v.probes, v.versions, "key", "time", "valid_from", "version", "year")


@query("interval_join", "readings signals", 'SELECT event_id, signal_id, level FROM readings JOIN signals s ON time >= s."start" AND time < s."end"')
def interval_join(v: Views) -> DataFrame:
    return intervals.interval_join(v.readings.select("event_id", "time"), v.signals.drop("detector_id")).select("event_id", "signal_id", "level")


def _with_hours(v: Views) -> DataFrame:
    return align.join_detector(v.readings, v.detectors).withColumn("hour", F.date_trunc("hour", "time").cast("timestamp_ntz"))


@query("rain_join", "readings detectors rain", "SELECT event_id, CASE WHEN b.hour IS NOT NULL THEN coalesce((min_mm + max_mm) / 2.0, 0) END AS rain FROM readings JOIN detectors d USING (detector_id) LEFT JOIN rain r ON r.hour = date_trunc('hour', time) AND r.district = d.district LEFT JOIN (SELECT DISTINCT hour FROM rain) b ON b.hour = date_trunc('hour', time)")
def rain_join(v: Views) -> DataFrame:
    return align.rain_join(_with_hours(v), v.rain).select("event_id", "rain")


for _how, _sql in (("mid", "(min_mm + max_mm) / 2.0"), ("max", "max_mm")):
    query(f"rain_{_how}", "rain", f"SELECT hour, district, CAST({_sql} AS DOUBLE) AS rain FROM rain")(lambda v, how=_how: v.rain.select("hour", "district", align.rain_value(how).cast("double").alias("rain")))


@query("territory_rain", "rain", "SELECT hour, max(max_mm) AS rain FROM rain GROUP BY hour")
def territory_rain(v: Views) -> DataFrame:
    return align.territory_rain(v.rain)


@query("calendar_join", "readings holidays", "SELECT event_id, CAST(time AS DATE) AS date, h.name AS holiday, CASE WHEN h.name IS NOT NULL THEN 'holiday' WHEN isodow(time) >= 6 THEN 'weekend' ELSE 'working' END AS day_type FROM readings LEFT JOIN holidays h ON h.date = CAST(time AS DATE)")
def calendar_join(v: Views) -> DataFrame:
    return align.calendar_join(v.readings, v.days).select("event_id", "date", "holiday", "day_type")


def _daily(v: Views) -> DataFrame:
    return v.readings.groupBy("detector_id", F.to_date("time").alias("date")).agg(F.avg("speed").alias("speed"))


@query("prev_week_ratio", "readings", "WITH d AS (SELECT detector_id, CAST(time AS DATE) AS date, avg(speed) AS speed FROM readings GROUP BY ALL) SELECT a.detector_id, a.date, round(a.speed / nullif(b.speed, 0), 6) AS ratio FROM d a LEFT JOIN d b ON a.detector_id = b.detector_id AND b.date = a.date - 7".replace("WITH d AS", ", d AS"))
def prev_week_ratio(v: Views) -> DataFrame:
    lagged = align.lag_weeks(_daily(v), ["detector_id"], "speed")
    return lagged.select("detector_id", "date", F.round(F.col("speed") / F.nullif(F.col("speed_before"), F.lit(0.0)), 6).alias("ratio"))


@query("nearest_district", "detectors", ", c AS (SELECT district, avg(x) AS x, avg(y) AS y FROM detectors GROUP BY district) SELECT district, nearest FROM (SELECT a.district, b.district AS nearest, row_number() OVER (PARTITION BY a.district ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.district) AS k FROM c a JOIN c b ON a.district <> b.district) WHERE k = 1")
def nearest_district(v: Views) -> DataFrame:
    return align.nearest_district(v.detectors)


@query("nearest_cell", "detectors", ", g AS (SELECT s_suppkey AS cell_id, round(s_acctbal / 500) * 500 AS cx, CAST(s_suppkey % 100 AS DOUBLE) AS cy FROM supplier) SELECT id, cell_id FROM (SELECT d.detector_id AS id, g.cell_id, row_number() OVER (PARTITION BY d.detector_id ORDER BY (x - cx) ** 2 + (y - cy) ** 2, g.cell_id) AS k FROM detectors d, g) WHERE k = 1")
def nearest_cell(v: Views) -> DataFrame:
    cells = v.table("supplier").select(F.col("s_suppkey").alias("cell_id"), (F.round(F.col("s_acctbal") / 500) * 500).alias("cx"), (F.col("s_suppkey") % 100).cast("double").alias("cy"))
    return align.nearest_cell(v.detectors.select(F.col("detector_id").alias("id"), "x", "y"), cells, 500)


@query("segment_route", "", "SELECT p_brand AS route, count(*) AS n, count(s_suppkey) AS n_matched FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0 GROUP BY p_brand")
def segment_route(v: Views) -> DataFrame:
    routes = v.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("route"))
    centre = v.table("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(1).alias("known"))
    joined = v.table("lineitem").select("l_partkey", "l_suppkey").join(align.sized(routes), "l_partkey").join(align.sized(centre), "l_suppkey", "left")
    return joined.groupBy("route").agg(F.count("*").alias("n"), F.count("known").alias("n_matched"))


# Aggregates and bins

_LANE_KEYS = "detector_id, date_trunc('day', time) AS time"
for _how, _sql in (("weighted", "sum(speed * volume) / nullif(sum(CASE WHEN speed IS NOT NULL THEN volume END), 0)"), ("mean", "avg(speed)"), ("slowest", "min(speed)")):
    query(f"lane_{_how}", "readings", f"SELECT {_LANE_KEYS}, round({_sql}, 6) AS speed, CAST(sum(volume) AS BIGINT) AS volume, round(avg(occupancy), 6) AS occupancy FROM readings GROUP BY ALL")(
        lambda v, how=_how: align.lanes_to_detector(v.readings.withColumn("time", F.date_trunc("day", "time").cast("timestamp_ntz")), how).select("detector_id", "time", _r("speed"), "volume", _r("occupancy"))
    )
for _m in (5, 15, 60):
    query(f"bin_{_m}", "readings", f"SELECT detector_id, time_bucket(INTERVAL {_m} minutes, time) AS bin, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume, round(avg(speed), 6) AS speed, round(avg(occupancy), 6) AS occupancy FROM readings GROUP BY ALL")(
        lambda v, m=_m: align.bin_time(v.readings, m).select("detector_id", "bin", "n", "volume", _r("speed"), _r("occupancy"))
    )


@query("coverage_daily", "readings", "SELECT detector_id, CAST(time AS DATE) AS date, count(DISTINCT date_trunc('minute', time)) AS present, round(count(DISTINCT date_trunc('minute', time)) / 1440.0, 6) AS share FROM readings GROUP BY ALL")
def coverage_daily(v: Views) -> DataFrame:
    minutes = v.readings.withColumn("minute", F.date_trunc("minute", "time"))
    return align.coverage_daily(minutes, 1440, "minute").withColumn("share", F.round("share", 6))


@query("territory_join", "readings rain", "SELECT event_id, t.rain AS territory_rain FROM readings LEFT JOIN (SELECT hour, max(max_mm) AS rain FROM rain GROUP BY hour) t ON t.hour = date_trunc('hour', time)")
def territory_join(v: Views) -> DataFrame:
    return align.territory_join(v.readings.withColumn("hour", F.date_trunc("hour", "time").cast("timestamp_ntz")), v.rain).select("event_id", "territory_rain")


@query("segment_match_rate", "", "SELECT p_brand AS route, count(*) AS n, count(s_suppkey) AS n_matched, round(count(s_suppkey) / count(*), 6) AS match_rate FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10 LEFT JOIN supplier ON l_partkey = s_suppkey AND s_acctbal > 0 GROUP BY p_brand")
def segment_match_rate(v: Views) -> DataFrame:
    segments = v.table("lineitem").select(F.col("l_partkey").alias("segment_id"))
    routes = v.table("part").where("p_size > 10").select(F.col("p_partkey").alias("segment_id"), F.col("p_brand").alias("route"))
    centre = v.table("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("segment_id"))
    return align.segment_route(segments, routes, centre).withColumn("match_rate", F.round("match_rate", 6))


@query("grid_to_district", "detectors", ", g AS (SELECT s_suppkey AS cell_id, s_acctbal AS cx, CAST(s_suppkey % 100 AS DOUBLE) AS cy FROM supplier), o AS (SELECT DISTINCT district, cell_id FROM (SELECT district, cell_id, row_number() OVER (PARTITION BY detector_id ORDER BY (x - cx) ** 2 + (y - cy) ** 2, cell_id) AS k FROM detectors, g) WHERE k = 1) SELECT district, l_shipdate AS ending, round(avg(l_quantity), 6) AS mean_rain, CAST(max(l_quantity) AS DOUBLE) AS max_rain FROM lineitem JOIN o ON l_suppkey = cell_id GROUP BY ALL")
def grid_to_district(v: Views) -> DataFrame:
    cells = v.table("supplier").select(F.col("s_suppkey").alias("cell_id"), F.col("s_acctbal").alias("cx"), (F.col("s_suppkey") % 100).cast("double").alias("cy"))
    values = v.table("lineitem").select(F.col("l_suppkey").alias("cell_id"), F.col("l_shipdate").alias("ending"), F.col("l_quantity").cast("double").alias("rain"))
    return align.grid_to_district(values.join(align.sized(cells), "cell_id"), v.detectors, 50.0).withColumn("mean_rain", F.round("mean_rain", 6))


for _how, _sql in (("ffill", "last_value(rain IGNORE NULLS) OVER (PARTITION BY district ORDER BY slot ROWS UNBOUNDED PRECEDING)"), ("linear", "coalesce(rain, CASE WHEN nk - pk <= 4 THEN pv + (nv - pv) * (k - pk) / (nk - pk) END)")):
    query(f"rain_{_how}", "rain", f", h AS (SELECT district, hour AS slot, CAST((min_mm + max_mm) / 2.0 AS DOUBLE) AS rain FROM rain), s AS (SELECT district, slot, rain, row_number() OVER (PARTITION BY district ORDER BY slot) AS k FROM (SELECT district, unnest(generate_series(min(slot), max(slot), INTERVAL 15 minutes)) AS slot FROM h GROUP BY district) LEFT JOIN h USING (district, slot)), f AS (SELECT *, last_value(CASE WHEN rain IS NOT NULL THEN k END IGNORE NULLS) OVER b AS pk, last_value(rain IGNORE NULLS) OVER b AS pv, first_value(CASE WHEN rain IS NOT NULL THEN k END IGNORE NULLS) OVER a AS nk, first_value(rain IGNORE NULLS) OVER a AS nv FROM s WINDOW b AS (PARTITION BY district ORDER BY slot ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY district ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT district, slot, round({_sql}, 6) AS rain FROM f")(
        lambda v, how=_how: align.align_rain(v.rain, how).select("district", "slot", _r("rain"))
    )


@query("baseline_median", "readings holidays", "SELECT detector_id, CASE WHEN h.date IS NOT NULL THEN 'holiday' WHEN isodow(time) >= 6 THEN 'weekend' ELSE 'working' END AS day_type, CAST(hour(time) // 6 AS INTEGER) AS slot, round(median(speed), 6) AS baseline FROM readings LEFT JOIN holidays h ON h.date = CAST(time AS DATE) GROUP BY ALL")
def baseline_median(v: Views) -> DataFrame:
    from stormlane.functions.scalar import slot

    slots = align.calendar_join(v.readings, v.days).withColumn("slot", slot(F.col("time"), 360))
    return study.dry_baseline(slots, ["detector_id", "day_type", "slot"]).withColumn("baseline", F.round("baseline", 6))


@query("grid_district", "detectors", "SELECT district, date_trunc('hour', ts) AS ending, round(avg(value), 6) AS mean_rain, max(value) AS max_rain FROM events JOIN detectors ON user_id = detector_id GROUP BY ALL")
def grid_district(v: Views) -> DataFrame:
    cells = align.join_detector(v.readings, v.detectors)
    return cells.groupBy("district", F.date_trunc("hour", "time").cast("timestamp_ntz").alias("ending")).agg(F.round(F.avg("speed"), 6).alias("mean_rain"), F.max("speed").alias("max_rain"))


# Intervals and days

_EPISODE = 'episode_id, "start", "end", max_level, n_signals, provisional'
_EPISODE_COLUMNS = ["episode_id", "start", "end", "max_level", "n_signals", "provisional"]


def _merged_sql(keys: str, gap: str, source: str = "signals") -> str:
    by = f"PARTITION BY {keys} " if keys else ""
    named = f"{keys}, " if keys else ""
    return f"""SELECT {named}CAST(row_number() OVER ({by}ORDER BY "start") AS INTEGER) AS episode_id, * EXCLUDE ({named}island) FROM (SELECT {named}island, min("start") AS "start", max("end") AS "end", max(level) AS max_level, count(*) AS n_signals, bool_or(provisional) AS provisional FROM (SELECT *, sum(opens) OVER ({by}ORDER BY "start", signal_id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN "start" <= max("end") OVER ({by}ORDER BY "start", signal_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL {gap} THEN 0 ELSE 1 END AS opens FROM {source})) GROUP BY {named}island)"""


@query("merge_intervals", "signals", _merged_sql("", "0 minutes"))
def merge_intervals(v: Views) -> DataFrame:
    return intervals.merge_intervals(v.signals).select(*_EPISODE_COLUMNS)


@query("merge_intervals_gap", "signals", _merged_sql("", "30 minutes"))
def merge_intervals_gap(v: Views) -> DataFrame:
    return intervals.merge_intervals(v.signals, max_gap="30 minutes").select(*_EPISODE_COLUMNS)


@query("merge_intervals_keyed", "signals", _merged_sql("detector_id", "0 minutes"))
def merge_intervals_keyed(v: Views) -> DataFrame:
    return intervals.merge_intervals(v.signals, ["detector_id"]).select("detector_id", *_EPISODE_COLUMNS)


@query("merge_session", "signals", f"""SELECT detector_id, "start", "end", max_level, n_signals FROM ({_merged_sql("detector_id", "0 minutes", '(SELECT * FROM signals WHERE "end" > "start")')})""")
def merge_session(v: Views) -> DataFrame:
    return intervals.merge_sessions(v.signals, ["detector_id"])


def _collapse_sql(unit: str, rows: str) -> str:
    day, number, form = ("date_trunc('month', date)", "year(date) * 12 + month(date)", "%Y-%m") if unit == "month" else ("date", "date - DATE '1970-01-01'", "%Y-%m-%d")
    return f"""SELECT k, string_agg(CASE WHEN a = b THEN strftime(a, '{form}') ELSE strftime(a, '{form}') || '..' || strftime(b, '{form}') END, ', ' ORDER BY a) AS ranges FROM (SELECT k, min(day) AS a, max(day) AS b FROM (SELECT *, n - row_number() OVER (PARTITION BY k ORDER BY n) AS run FROM (SELECT DISTINCT k, CAST({day} AS DATE) AS day, {number} AS n FROM (SELECT {rows}))) GROUP BY k, run) GROUP BY k"""


@query("collapse_months", "", _collapse_sql("month", "o_custkey AS k, CAST(o_orderdate AS DATE) AS date FROM orders"))
def collapse_months(v: Views) -> DataFrame:
    return intervals.collapse_runs(v.table("orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("date")), ["k"], "date", "month")


@query("collapse_days", "", _collapse_sql("day", "user_id AS k, CAST(ts AS DATE) AS date FROM events"))
def collapse_days(v: Views) -> DataFrame:
    return intervals.collapse_runs(v.events.select(F.col("user_id").alias("k"), F.to_date("ts").alias("date")), ["k"], "date", "day")


_TOUCHED = """SELECT *, CAST(unnest(generate_series(CAST("start" - INTERVAL {pad} hours AS DATE), CAST("end" + INTERVAL {pad} hours AS DATE), INTERVAL 1 day)) AS DATE) AS date FROM {source}"""
_EVENTS = f"SELECT date, list_sort(list(DISTINCT episode_id)) AS ids, max(max_level) AS max_level FROM ({_TOUCHED.format(pad=3, source='episodes')}) GROUP BY date"
_BLACK = _EVENTS.replace("FROM episodes", "FROM (SELECT * FROM episodes WHERE max_level >= 3)")
_EXCLUDED = f"SELECT date FROM ({_TOUCHED.format(pad=0, source='episodes')}) UNION SELECT date FROM ({_TOUCHED.format(pad=0, source='cyclones')})"
_SELECTED = f"""(SELECT date, 'event' AS role, array_to_string(ids, ' ') AS episode_ids, max_level FROM ev UNION ALL SELECT date, 'control', '', 0 FROM (SELECT DISTINCT CAST(date - CAST(7 * k AS INTEGER) AS DATE) AS date FROM ev, range(1, 3) t(k)) WHERE date NOT IN (SELECT date FROM ev) AND date NOT IN ({_EXCLUDED}))"""
_MANIFEST = f"SELECT date, role, episode_ids, max_level, CASE max_level WHEN 1 THEN 'Amber' WHEN 2 THEN 'Red' WHEN 3 THEN 'Black' ELSE '' END AS max_level_name FROM {_SELECTED}"
_ROLES = f"SELECT count(*) FILTER (role = 'event') AS n_event, count(*) FILTER (role = 'control') AS n_control FROM {_SELECTED}"
_STUDIED = "WHERE date >= DATE '2023-12-01'"


def _ids_as_text(found: DataFrame) -> DataFrame:
    return found.withColumn("episode_ids", F.array_join(F.col("episode_ids").cast("array<string>"), " "))


def _selected(v: Views, min_level: int = 1, years: tuple = (2023, 2025), since: str = "2023-12-01") -> DataFrame:
    """Over every signal and every cyclone; years and first day are those of the study unless given."""
    return days.select_days(intervals.merge_intervals(v.signals), v.cyclones, years, min_level=min_level, since=since)


_EVERY = {"years": (1, 9999), "since": "0001-01-01"}


@query("event_days_all", "episodes", f"SELECT date, array_to_string(ids, ' ') AS episode_ids, max_level FROM ({_EVENTS})")
@query("event_days", "episodes", f"SELECT date, array_to_string(ids, ' ') AS episode_ids, max_level FROM ({_EVENTS})")
def event_days(v: Views) -> DataFrame:
    return _ids_as_text(days.event_days(intervals.merge_intervals(v.signals)))


@query("excluded_days_all", "episodes cyclones", _EXCLUDED)
@query("excluded_days", "episodes cyclones", _EXCLUDED)
def excluded_days(v: Views) -> DataFrame:
    return days.excluded_days(intervals.merge_intervals(v.signals), v.cyclones)


@query("select_days", "episodes cyclones", f", ev AS ({_EVENTS}) {_MANIFEST} {_STUDIED}")
def select_days(v: Views) -> DataFrame:
    return _ids_as_text(_selected(v))


@query("select_days_all", "episodes cyclones", f", ev AS ({_EVENTS}) {_MANIFEST}")
def select_days_all(v: Views) -> DataFrame:
    return _ids_as_text(_selected(v, **_EVERY))


@query("select_days_black", "episodes cyclones", f", ev AS ({_BLACK}) {_MANIFEST}")
def select_days_black(v: Views) -> DataFrame:
    return _ids_as_text(_selected(v, 3, **_EVERY))


@query("role_counts", "episodes cyclones", f", ev AS ({_EVENTS}) {_ROLES} {_STUDIED}")
def role_counts(v: Views) -> DataFrame:
    return days.role_counts(_selected(v))


@query("role_counts_all", "episodes cyclones", f", ev AS ({_EVENTS}) {_ROLES}")
def role_counts_all(v: Views) -> DataFrame:
    return days.role_counts(_selected(v, **_EVERY))


@query("episodes_pivot", "episodes", "SELECT CAST(year(\"start\") AS INTEGER) AS year, count(*) FILTER (max_level = 1) AS amber, count(*) FILTER (max_level = 2) AS red, count(*) FILTER (max_level = 3) AS black FROM episodes GROUP BY ALL")
def episodes_pivot(v: Views) -> DataFrame:
    return days.episodes_by_year(intervals.merge_intervals(v.signals))


@query("warning_ordinal", "levels", "SELECT event_id, level, CAST(CASE WHEN level > 0 THEN minutes_since END AS BIGINT) AS minutes_since FROM levels")
def warning_ordinal(v: Views) -> DataFrame:
    return _levels(v).select("event_id", "level", "minutes_since")


@query("warning_onehot", "levels", "SELECT event_id, CAST(level = 1 AS INTEGER) AS is_amber, CAST(level = 2 AS INTEGER) AS is_red, CAST(level = 3 AS INTEGER) AS is_black, CAST(level > 0 AS INTEGER) AS warned FROM levels")
def warning_onehot(v: Views) -> DataFrame:
    return _levels(v).select("event_id", "is_amber", "is_red", "is_black", "warned")


@query("news_latest", "readings", """SELECT detector_id AS id, CASE arg_max(lane_id, (time, event_id)) WHEN 'purchase' THEN 'CLOSED' ELSE 'UPDATED' END AS status, min(time) AS "start", min(time) FILTER (lane_id = 'purchase') AS "end", count(*) AS n_messages FROM readings GROUP BY detector_id""")
def news_latest(v: Views) -> DataFrame:
    news = v.readings.select(F.col("detector_id").alias("id"), "time", F.when(F.col("lane_id") == "purchase", "CLOSED").otherwise("UPDATED").alias("status"))
    return intervals.news_intervals(news)


# Filling and lags


def _six(v: Views) -> DataFrame:
    clean = cleaning.null_placeholder(cleaning.filter_bounds(cleaning.filter_valid(v.readings), "drop"))
    return align.bin_time(clean, 360)


_SPINE = "f AS (SELECT detector_id, bin, speed, row_number() OVER (PARTITION BY detector_id ORDER BY bin) AS k FROM (SELECT detector_id, unnest(generate_series(min(bin), max(bin), INTERVAL 6 hours)) AS bin FROM six GROUP BY detector_id) LEFT JOIN six USING (detector_id, bin))"
_BACK, _AHEAD = "OVER (PARTITION BY detector_id ORDER BY bin ROWS UNBOUNDED PRECEDING)", "OVER (PARTITION BY detector_id ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query("interp_short", "six", f", {_SPINE} SELECT detector_id, bin, round(coalesce(speed, CASE WHEN nk - pk - 1 <= 2 THEN pv + (nv - pv) * (k - pk) / (nk - pk) END), 6) AS filled FROM (SELECT *, last_value(CASE WHEN speed IS NOT NULL THEN k END IGNORE NULLS) {_BACK} AS pk, first_value(CASE WHEN speed IS NOT NULL THEN k END IGNORE NULLS) {_AHEAD} AS nk, last_value(speed IGNORE NULLS) {_BACK} AS pv, first_value(speed IGNORE NULLS) {_AHEAD} AS nv FROM f)")
def interp_short(v: Views) -> DataFrame:
    return align.fill_linear(_six(v), ["detector_id"], "bin", "speed", "6 hours", piece="week").select("detector_id", "bin", _r("filled"))


@query("ffill", "six", f", {_SPINE} SELECT detector_id, bin, round(last_value(speed IGNORE NULLS) {_BACK}, 6) AS filled FROM f")
def ffill(v: Views) -> DataFrame:
    return align.fill(_six(v), ["detector_id"], "bin", "speed", "6 hours", piece="week").select("detector_id", "bin", _r("filled"))


@query("fill_seasonal", "six", f", {_SPINE} SELECT detector_id, bin, round(coalesce(speed, avg(speed) OVER (PARTITION BY detector_id, hour(bin))), 6) AS filled FROM f")
def fill_seasonal(v: Views) -> DataFrame:
    return align.fill(_six(v), ["detector_id"], "bin", "speed", "6 hours", "seasonal").select("detector_id", "bin", _r("filled"))


@query("fill_seasonal_week", "readings", ", q AS (SELECT detector_id, time_bucket(INTERVAL 15 minutes, time) AS bin, avg(speed) AS speed FROM readings GROUP BY ALL), s AS (SELECT detector_id, bin, speed FROM (SELECT detector_id, unnest(generate_series(min(bin), max(bin), INTERVAL 15 minutes)) AS bin FROM q GROUP BY detector_id) LEFT JOIN q USING (detector_id, bin)), m AS (SELECT detector_id, isodow(bin) >= 6 AS weekend, hour(bin) * 4 + minute(bin) // 15 AS slot, avg(speed) AS mean FROM q GROUP BY ALL) SELECT s.detector_id, bin, round(coalesce(speed, mean), 4) AS filled FROM s JOIN m ON m.detector_id = s.detector_id AND m.weekend = (isodow(s.bin) >= 6) AND m.slot = hour(s.bin) * 4 + minute(s.bin) // 15")
def fill_seasonal_week(v: Views) -> DataFrame:
    """Quarter-hour bins that any bin of the detector at that quarter of a working day or weekend tells something about."""
    bins = align.bin_time(v.readings, 15).select("detector_id", "bin", "speed")
    filled = align.fill(bins, ["detector_id"], "bin", "speed", "15 minutes", "seasonal", align.weekly_slot("bin"), "month")
    return filled.where("filled is not null").select("detector_id", "bin", _r("filled", 4))


@query("rain_slots", "rain", "SELECT district, hour + to_minutes(CAST(15 * k AS BIGINT)) AS slot, (min_mm + max_mm) / 2.0 AS rain FROM rain, range(-1, 3) t(k)")
def rain_slots(v: Views) -> DataFrame:
    return align.rain_slots(v.rain)


@query("rain_lags", "rain", ", m AS (SELECT district, hour, (min_mm + max_mm) / 2.0 AS rain FROM rain) SELECT a.district, a.hour, a.rain, b.rain AS rain_1, c.rain AS rain_2 FROM m a LEFT JOIN m b ON b.district = a.district AND b.hour = a.hour - INTERVAL 1 hour LEFT JOIN m c ON c.district = a.district AND c.hour = a.hour - INTERVAL 2 hours")
def rain_lags(v: Views) -> DataFrame:
    return align.rain_lags(v.rain)


@query("zscore_norm", "six", "SELECT detector_id, bin, round((speed - avg(speed) OVER w) / nullif(stddev_samp(speed) OVER w, 0), 5) AS z FROM six WINDOW w AS (PARTITION BY detector_id)")
def zscore_norm(v: Views) -> DataFrame:
    return study.normalise(_six(v)).select("detector_id", "bin", _r("z", 5))


# The study


def _under(v: Views, rows: DataFrame) -> DataFrame:
    """Rows with their detector's district, whose signals they are under."""
    return rows.join(v.places, "detector_id", "left")


def _levels(v: Views) -> DataFrame:
    return intervals.encode_warning(_under(v, v.readings), _under(v, v.signals), {"under": "under"}).drop("under")


def _usable(v: Views, bounded: bool = True) -> DataFrame:
    rows = cleaning.null_placeholder(cleaning.filter_valid(_levels(v))).where("speed is not null")
    return cleaning.filter_bounds(rows, "drop") if bounded else rows


def _sensitivity(rows: DataFrame) -> DataFrame:
    return study.sensitivity_by_level(rows, ["detector_id"])


def _ranking(v: Views, bounded: bool = True) -> DataFrame:
    return study.overall(_sensitivity(_usable(v, bounded)))


@query("sensitivity", "sensitive", "SELECT detector_id, level, n, round(sensitivity, 6) AS sensitivity FROM sensitive")
def sensitivity(v: Views) -> DataFrame:
    return _sensitivity(_usable(v)).select("detector_id", "level", "n", _r("sensitivity"))


@query("sensitivity_occupancy", "levels", ", u AS (SELECT * FROM levels WHERE valid = 'Y' AND volume <> 0 AND speed BETWEEN 0 AND 130) SELECT detector_id, level, count(*) AS n, round(median(occupancy / nullif(b, 0)) - 1, 6) AS sensitivity FROM u JOIN (SELECT detector_id, median(occupancy) AS b FROM u WHERE level = 0 GROUP BY detector_id) USING (detector_id) WHERE level > 0 GROUP BY ALL")
def sensitivity_occupancy(v: Views) -> DataFrame:
    """How much occupancy rises per detector and level."""
    rows = _usable(v)
    return study.sensitivity_by_level(rows, ["detector_id"], "occupancy").select("detector_id", "level", "n", _r("sensitivity"))


for _place in ("district", "road"):

    @query(f"sensitivity_{_place}", "ratios detectors", f"SELECT {_place}, level, count(*) AS n, round(median(ratio) - 1, 6) AS sensitivity FROM ratios JOIN detectors USING (detector_id) WHERE level > 0 GROUP BY ALL")
    def sensitivity_place(v: Views, place: str = _place) -> DataFrame:
        rows = align.join_detector(_usable(v), v.detectors)
        return study.sensitivity(rows, study.dry_baseline(rows.where("level = 0"), ["detector_id"]), ["detector_id"], by=[place]).select(place, "level", "n", _r("sensitivity"))


@query("sensitivity_rank", "ranking", "SELECT detector_id, CAST(rank() OVER (ORDER BY round(sensitivity, 9)) AS BIGINT) AS place FROM ranking WHERE sensitivity IS NOT NULL")
def sensitivity_rank(v: Views) -> DataFrame:
    ranking = _ranking(v).where("sensitivity is not null").select("detector_id", F.round("sensitivity", 9).alias("sensitivity"))
    return study.ranks(kept(ranking), "sensitivity", "place", ties="min").select("detector_id", F.col("place").cast("long").alias("place"))


@query("topk", "ranking", "SELECT detector_id, round(sensitivity, 6) AS sensitivity FROM ranking WHERE sensitivity IS NOT NULL ORDER BY ranking.sensitivity, detector_id LIMIT 20")
def topk(v: Views) -> DataFrame:
    return study.top(_ranking(v)).select("detector_id", _r("sensitivity"))


@query("topk_per_district", "ranking detectors", "SELECT district, detector_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY district ORDER BY sensitivity, detector_id) AS place FROM ranking JOIN detectors USING (detector_id) WHERE sensitivity IS NOT NULL) WHERE place <= 3")
def topk_per_district(v: Views) -> DataFrame:
    return study.top_per(align.join_detector(_ranking(v), v.detectors), "district").select("district", "detector_id", "place")


_LOOSE = ", lr AS (SELECT l.*, speed / nullif(b, 0) AS ratio FROM levels l JOIN (SELECT detector_id, median(speed) AS b FROM levels WHERE level = 0 AND valid = 'Y' AND volume <> 0 GROUP BY detector_id) USING (detector_id) WHERE valid = 'Y' AND volume <> 0), ls AS (SELECT detector_id, avg(s) AS sensitivity FROM (SELECT detector_id, level, median(ratio) - 1 AS s FROM lr WHERE level > 0 GROUP BY ALL) GROUP BY detector_id)"
_TOP = "(SELECT detector_id FROM {0} WHERE sensitivity IS NOT NULL ORDER BY sensitivity, detector_id LIMIT 20)"
query("top_overlap", "ranking", f"{_LOOSE} SELECT count(*) AS n_common FROM (SELECT * FROM {_TOP.format('ranking')} INTERSECT SELECT * FROM {_TOP.format('ls')})")(lambda v: study.overlap(_ranking(v), _ranking(v, False)))

#: Variants of the cleaning steps, one step at a time varied against the default: the condition under which a row counts, in SQL.
_STEPS = {
    "default": "valid = 'Y' AND volume <> 0 AND speed BETWEEN 0 AND 130",
    "no_bounds": "valid = 'Y' AND volume <> 0",
    "keep_invalid": "volume <> 0 AND speed BETWEEN 0 AND 130",
    "keep_placeholder": "valid = 'Y' AND speed BETWEEN 0 AND 130",
    "low_bounds": "valid = 'Y' AND volume <> 0 AND speed BETWEEN 0 AND 80",
    "busy_only": "valid = 'Y' AND volume <> 0 AND speed BETWEEN 0 AND 130 AND occupancy BETWEEN 20 AND 100",
}
_USED = " UNION ALL ".join(f"SELECT '{name}' AS variant, detector_id, level, speed FROM levels WHERE {keep}" for name, keep in _STEPS.items())
_ABLATED = f""", u AS ({_USED}), sc AS (SELECT variant, detector_id, avg(s) AS x FROM (SELECT variant, detector_id, level, median(speed / nullif(b, 0)) - 1 AS s FROM u JOIN (SELECT variant, detector_id, median(speed) AS b FROM u WHERE level = 0 GROUP BY ALL) USING (variant, detector_id) WHERE level > 0 GROUP BY ALL) GROUP BY ALL HAVING x IS NOT NULL),
bo AS (SELECT a.variant, a.x, b.x AS y FROM sc a JOIN sc b ON a.detector_id = b.detector_id AND b.variant = 'default'),
rk AS (SELECT variant, rank() OVER (PARTITION BY variant ORDER BY x) + (count(*) OVER (PARTITION BY variant, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY variant ORDER BY y) + (count(*) OVER (PARTITION BY variant, y) - 1) / 2.0 AS ry FROM bo),
fi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY x, detector_id) AS place FROM sc) WHERE place <= 20),
co AS (SELECT a.variant, count(*) AS n_common FROM fi a JOIN fi b ON a.detector_id = b.detector_id AND b.variant = 'default' GROUP BY a.variant)"""
_NAMES = "(SELECT unnest([" + ", ".join(f"'{name}'" for name in _STEPS) + "]) AS variant)"


def _ablated(v: Views) -> DataFrame:
    return study.ablate(_levels(v), {name: F.expr(keep) for name, keep in _STEPS.items()}, "default")


@query("ablation_overlap", "levels", f"{_ABLATED} SELECT variant, coalesce(n_common, 0) AS n_common FROM {_NAMES} LEFT JOIN co USING (variant)")
def ablation_overlap(v: Views) -> DataFrame:
    return _ablated(v).select("variant", "n_common")


@query("ablation_steps", "levels", f"{_ABLATED} SELECT variant, count(rx) AS n, round(corr(rx, ry), 4) AS spearman, coalesce(any_value(n_common), 0) AS n_common FROM {_NAMES} LEFT JOIN rk USING (variant) LEFT JOIN co USING (variant) GROUP BY variant")
def ablation_steps(v: Views) -> DataFrame:
    return _ablated(v).select("variant", "n", _r("spearman", 4), "n_common")


@query("ablation_spearman", "ranking", f"{_LOOSE}, r AS (SELECT detector_id, rank() OVER (ORDER BY a.sensitivity) + (count(*) OVER (PARTITION BY a.sensitivity) - 1) / 2.0 AS x, rank() OVER (ORDER BY b.sensitivity) + (count(*) OVER (PARTITION BY b.sensitivity) - 1) / 2.0 AS y FROM ranking a JOIN ls b USING (detector_id) WHERE a.sensitivity IS NOT NULL AND b.sensitivity IS NOT NULL) SELECT count(*) AS n, round(corr(x, y), 4) AS spearman FROM r")
def ablation_spearman(v: Views) -> DataFrame:
    variants = {name: F.expr(_STEPS[name]) for name in ("default", "no_bounds")}
    return study.ablate(_levels(v), variants, "default").where("variant = 'no_bounds'").select("n", _r("spearman", 4))


@query("within_regression", "ratios rain detectors", ", j AS (SELECT r.detector_id, r.ratio AS y, r.level AS x FROM ratios r WHERE ratio IS NOT NULL), c AS (SELECT *, x - avg(x) OVER (PARTITION BY detector_id) AS dx, y - avg(y) OVER (PARTITION BY detector_id) AS dy FROM j) SELECT CAST(count(*) AS BIGINT) AS n, round(sum(dx * dy) / nullif(sum(dx * dx), 0), 5) AS slope FROM c")
def within_regression(v: Views) -> DataFrame:
    return study.within_regression(_ratio(v), "ratio", "level", "detector_id").select("n", _r("slope", 5))


@query("within_regression_rain", "ratios rain detectors", ", j AS (SELECT q.detector_id, q.ratio AS y, CAST(q.level AS DOUBLE) AS a, coalesce((min_mm + max_mm) / 2.0, 0) AS b FROM ratios q JOIN detectors d ON q.detector_id = d.detector_id JOIN (SELECT DISTINCT hour FROM rain) h ON h.hour = date_trunc('hour', time) LEFT JOIN rain r ON r.hour = h.hour AND r.district = d.district WHERE ratio IS NOT NULL), c AS (SELECT a - avg(a) OVER w AS a, b - avg(b) OVER w AS b, y - avg(y) OVER w AS y FROM j WINDOW w AS (PARTITION BY detector_id)), t AS (SELECT count(*) AS n, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS bby FROM c) SELECT n, round((ay * bb - bby * ab) / (aa * bb - ab * ab), 5) AS slope_level, round((bby * aa - ay * ab) / (aa * bb - ab * ab), 5) AS slope_rain FROM t")
def within_regression_rain(v: Views) -> DataFrame:
    """Speed ratio on warning level and rain together, within detectors; hours without a bulletin are left out."""
    found = study.within_regression_two(_model_table(v), "ratio", "level", "rain", "detector_id")
    return found.select("n", F.round("slope_1", 5).alias("slope_level"), F.round("slope_2", 5).alias("slope_rain"))


@query("linear_eval", "ratios", ", m AS (SELECT *, CAST(hour(time) AS DOUBLE) AS hr, week(time) % 3 AS fold FROM ratios WHERE ratio IS NOT NULL), l AS (SELECT regr_slope(ratio, level) AS s, regr_intercept(ratio, level) AS i, regr_slope(ratio, hr) AS ts, regr_intercept(ratio, hr) AS ti FROM m WHERE fold <> 0) SELECT count(*) AS n, round(avg(abs(ratio - (i + s * level))), 5) AS mae, round(avg(abs(ratio - (ti + ts * hr))), 5) AS mae_time_only FROM m, l WHERE fold = 0")
def linear_eval(v: Views) -> DataFrame:
    """A straight line on the warning level beside one on the hour of day alone; whole weeks are held out."""
    rows = _ratio(v).where("ratio is not null").select("ratio", F.col("level").cast("double").alias("level"), F.hour("time").cast("double").alias("hour"), (F.weekofyear("time") % 3).alias("fold"))
    both = study.linear_by(study.linear_by(rows, "ratio", "level", F.col("fold") != 0).withColumnRenamed("prediction", "by_level"), "ratio", "hour", F.col("fold") != 0)
    error = lambda guess: F.round(F.avg(F.abs(F.col("ratio") - F.col(guess))), 5)
    return both.where("fold = 0").agg(F.count("*").alias("n"), error("by_level").alias("mae"), error("prediction").alias("mae_time_only"))


for _how, _sql in (("ratio", "speed / nullif(median(speed) OVER (PARTITION BY detector_id), 0)"), ("prev_week", "speed / nullif((SELECT b.speed FROM six b WHERE b.detector_id = six.detector_id AND b.bin = six.bin - INTERVAL 7 days), 0)")):
    query(f"{_how}_norm", "six", f"SELECT detector_id, bin, round({_sql}, 5) AS ratio FROM six")(lambda v, how=_how: study.normalise(_six(v), how=how).select("detector_id", "bin", _r("ratio", 5)))


def _ratio(v: Views) -> DataFrame:
    rows = _usable(v)
    return rows.join(study.dry_baseline(rows.where("level = 0"), ["detector_id"]), "detector_id").withColumn("ratio", F.col("speed") / F.nullif(F.col("baseline"), F.lit(0.0)))


@query("f1_mae", "ratios", ", m AS (SELECT *, avg(ratio) OVER (PARTITION BY level, hour(time)) AS guess FROM ratios WHERE ratio IS NOT NULL) SELECT count(*) AS n, round(avg(abs(ratio - guess)), 5) AS mae, round(2.0 * count(*) FILTER (ratio < 0.7 AND guess < 0.7) / nullif(2 * count(*) FILTER (ratio < 0.7 AND guess < 0.7) + count(*) FILTER (ratio >= 0.7 AND guess < 0.7) + count(*) FILTER (ratio < 0.7 AND guess >= 0.7), 0), 5) AS f1 FROM m")
def f1_mae(v: Views) -> DataFrame:
    rows = _ratio(v).where("ratio is not null").withColumn("hour", F.hour("time"))
    guess = rows.groupBy("level", "hour").agg(F.avg("ratio").alias("guess"))
    return study.f1_mae(rows.join(align.sized(guess), ["level", "hour"]), "ratio", "guess").select("n", _r("mae", 5), _r("f1", 5))


def _model_table(v: Views) -> DataFrame:
    """Readings with district, rain, warning and calendar."""
    warned = _ratio(v)
    located = align.join_detector(warned, v.detectors).withColumn("hour", F.date_trunc("hour", "time").cast("timestamp_ntz"))
    return align.calendar_join(align.rain_join(located, v.rain), v.days)


@query("model_table", "ratios detectors rain holidays", "SELECT event_id, q.detector_id, d.district, round(q.ratio, 6) AS ratio, q.level, CASE WHEN b.hour IS NOT NULL THEN coalesce((min_mm + max_mm) / 2.0, 0) END AS rain, CASE WHEN h.date IS NOT NULL THEN 'holiday' WHEN isodow(time) >= 6 THEN 'weekend' ELSE 'working' END AS day_type FROM ratios q JOIN detectors d ON q.detector_id = d.detector_id LEFT JOIN rain r ON r.hour = date_trunc('hour', time) AND r.district = d.district LEFT JOIN (SELECT DISTINCT hour FROM rain) b ON b.hour = date_trunc('hour', time) LEFT JOIN holidays h ON h.date = CAST(time AS DATE)")
def model_table(v: Views) -> DataFrame:
    return _model_table(v).select("event_id", "detector_id", "district", _r("ratio"), "level", "rain", "day_type")


_FEATURES = ["level", "rain", "hour"]


def _learnable(v: Views) -> DataFrame:
    number = {"level": F.col("level").cast("double"), "rain": F.coalesce("rain", F.lit(0.0)), "hour": F.hour("time").cast("double")}
    return _model_table(v).where("ratio is not null").select("event_id", "time", "district", "ratio", *[c.alias(name) for name, c in number.items()])


@query("model_eval")
def model_eval(v: Views) -> DataFrame:
    """Gradient-boosted trees on level, rain and hour of day; whole weeks are held out, so an episode over a week's end is in
    both parts (``split_episodes`` and ``congestion_eval`` hold out whole episodes)."""
    rows = kept(_learnable(v).select(*_FEATURES, "ratio", (F.weekofyear("time") % 3).alias("fold")))
    return study.f1_mae(study.fit_and_score(rows.where("fold <> 0"), rows.where("fold = 0"), _FEATURES, "ratio"), "ratio", "prediction")


def _in_folds(v: Views, rows: DataFrame) -> DataFrame:
    return study.split_by_episode(rows, intervals.merge_intervals(v.signals))


@query("split_episodes", "readings episodes", """SELECT event_id, episode_id, CAST(coalesce(episode_id, CAST(time AS DATE) - DATE '1970-01-01') % 3 AS INTEGER) AS fold FROM readings LEFT JOIN episodes ON time >= "start" AND time < "end" """)
def split_episodes(v: Views) -> DataFrame:
    return _in_folds(v, v.readings).select("event_id", "episode_id", "fold")


@query("congestion_eval")
def congestion_eval(v: Views) -> DataFrame:
    """A logistic model of congestion (ratio below 0.7) on level, rain and hour beside one on the hour alone; whole episodes of a
    district are held out."""
    rows = kept(_district_folds(v, _learnable(v)))
    train, test, truth = rows.where("fold <> 0"), rows.where("fold = 0"), F.col("ratio") < 0.7
    scored = [study.class_scores(study.congestion(train, test, names), truth, F.col("congested") == 1).withColumn("model", F.lit(model)) for model, names in (("all", _FEATURES), ("time only", ["hour"]))]
    return scored[0].unionByName(scored[1]).select("model", "n", "n_true", _r("accuracy", 5), _r("f1", 5))


@query("model_importances")
def model_importances(v: Views) -> DataFrame:
    return study.importances(_learnable(v), _FEATURES, "ratio").select("feature", _r("importance", 5))


# Configurations


class _Study:
    """The views as inputs of a modelling table; each is only read if it is asked for."""

    def __init__(self, v: Views):
        self.v = v

    readings = property(lambda self: self.v.readings)
    detectors = property(lambda self: self.v.detectors)
    signals = property(lambda self: _under(self.v, self.v.signals).withColumnRenamed("under", "district"))
    rain = property(lambda self: self.v.rain)
    holidays = property(lambda self: self.v.days)
    cyclones = property(lambda self: self.v.cyclones)


_BASE = {"minutes": 360, "calendar": "none"}
#: The ablation's configurations: what each changes against the first.
_CONFIGS: dict[str, dict] = {
    "default": {}, "keep_invalid": {"validity": "keep"}, "slowest_lane": {"lanes": "slowest"}, "bin_60": {"minutes": 60}, "bin_720": {"minutes": 720},
    "fill_linear": {"fill": "linear"}, "fill_ffill": {"fill": "ffill"}, "rain_max": {"rain": "max"}, "rain_ffill": {"rain_align": "ffill"}, "no_rain": {"rain": "none"},
    "zscore": {"normalise": "zscore"}, "prev_week": {"normalise": "prev_week"},
}
_CONFIGS = {name: modelling.Config(**_BASE | changes) for name, changes in _CONFIGS.items()}


def _bins_sql(c: modelling.Config) -> str:
    """The bins of a configuration with their district, level and rain, as far as the ablation varies them."""
    keep = ["speed BETWEEN 0 AND 130 AND occupancy BETWEEN 0 AND 100"] + ["valid = 'Y'"] * (c.validity == "drop_lane")
    lane = {"weighted": "sum(speed * volume) / nullif(sum(CASE WHEN speed IS NOT NULL THEN volume END), 0)", "slowest": "min(speed)"}[c.lanes]
    step = f"INTERVAL {c.minutes} minutes"
    bins = f"SELECT detector_id, time_bucket({step}, time) AS bin, avg(speed) AS speed FROM (SELECT detector_id, time, {lane} AS speed FROM (SELECT detector_id, time, volume, CASE WHEN volume <> 0 THEN speed END AS speed FROM readings WHERE {' AND '.join(keep)}) GROUP BY ALL) GROUP BY ALL"
    if c.fill != "none":
        filled = {"ffill": "last_value(speed IGNORE NULLS) OVER b", "linear": "coalesce(speed, CASE WHEN first_value(CASE WHEN speed IS NOT NULL THEN k END IGNORE NULLS) OVER a - last_value(CASE WHEN speed IS NOT NULL THEN k END IGNORE NULLS) OVER b - 1 <= 2 THEN last_value(speed IGNORE NULLS) OVER b + (first_value(speed IGNORE NULLS) OVER a - last_value(speed IGNORE NULLS) OVER b) * (k - last_value(CASE WHEN speed IS NOT NULL THEN k END IGNORE NULLS) OVER b) / (first_value(CASE WHEN speed IS NOT NULL THEN k END IGNORE NULLS) OVER a - last_value(CASE WHEN speed IS NOT NULL THEN k END IGNORE NULLS) OVER b) END)"}[c.fill]
        spine = f"SELECT detector_id, bin, speed, row_number() OVER (PARTITION BY detector_id ORDER BY bin) AS k FROM (SELECT detector_id, unnest(generate_series(min(bin), max(bin), {step})) AS bin FROM ({bins}) GROUP BY detector_id) LEFT JOIN ({bins}) USING (detector_id, bin)"
        bins = f"SELECT detector_id, bin, {filled} AS speed FROM ({spine}) WINDOW b AS (PARTITION BY detector_id ORDER BY bin ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY detector_id ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    placed = f"SELECT q.*, d.district FROM ({bins}) q LEFT JOIN detectors d USING (detector_id) WHERE speed IS NOT NULL"
    leveled = f"SELECT p.*, coalesce(level, 0) AS level FROM ({placed}) p LEFT JOIN (SELECT district, bin, max(level) AS level FROM (SELECT DISTINCT district, bin FROM ({placed})) JOIN (SELECT \"start\", \"end\", level, district FROM signals JOIN detectors USING (detector_id)) s USING (district) WHERE bin >= s.\"start\" AND bin < s.\"end\" GROUP BY ALL) w USING (district, bin)"
    value = {"mid": "(min_mm + max_mm) / 2.0", "max": "max_mm"}.get(c.rain)
    if c.rain == "none":
        return f"SELECT *, CAST(NULL AS DOUBLE) AS rain FROM ({leveled})"
    if c.rain_align == "ffill":
        return f"SELECT l.*, CASE WHEN l.bin <= z.last THEN {value} END AS rain FROM ({leveled}) l ASOF LEFT JOIN rain r ON r.district = l.district AND l.bin >= r.hour LEFT JOIN (SELECT district, max(hour) AS last FROM rain GROUP BY district) z ON z.district = l.district"
    return f"SELECT l.*, CASE WHEN b.hour IS NOT NULL THEN coalesce({value}, 0) END AS rain FROM ({leveled}) l LEFT JOIN rain r ON r.hour = date_trunc('hour', bin) AND r.district = l.district LEFT JOIN (SELECT DISTINCT hour FROM rain) b ON b.hour = date_trunc('hour', bin)"


def _config_sql(c: modelling.Config) -> str:
    y = {
        "ratio": "speed / nullif(baseline, 0)", "zscore": "(speed - avg(speed) OVER (PARTITION BY detector_id)) / nullif(stddev_samp(speed) OVER (PARTITION BY detector_id), 0)", "prev_week": "q.speed / nullif(w.speed, 0)",
    }[c.normalise]
    source = {"ratio": "q JOIN (SELECT detector_id, median(speed) AS baseline FROM q WHERE level = 0 GROUP BY detector_id) USING (detector_id)", "zscore": "q", "prev_week": "q LEFT JOIN q w ON w.detector_id = q.detector_id AND w.bin = q.bin - INTERVAL 7 days"}[c.normalise]
    return f"(WITH q AS ({_bins_sql(c)}) SELECT q.detector_id, q.bin, q.speed, q.district, q.level, q.rain, {y} AS y FROM {source})"


_CONFIG_ROWS = " UNION ALL ".join(f"SELECT '{name}' AS variant, {str(c.normalise in ('ratio', 'prev_week')).lower()} AS ratio, detector_id, level, hour(bin) AS hour, coalesce(rain > 0, false) AS wet, y FROM {_config_sql(c)} WHERE y IS NOT NULL" for name, c in _CONFIGS.items())
_CONFIG_NAMES = "(SELECT unnest([" + ", ".join(f"'{name}'" for name in _CONFIGS) + "]) AS variant)"
_COMPARED = _ABLATED[_ABLATED.index("bo AS") :]


@query("ablation_configs", "readings detectors signals rain", f""", lo AS MATERIALIZED ({_CONFIG_ROWS}), sc AS (SELECT variant, detector_id, avg(m) AS x FROM (SELECT variant, detector_id, level, median(y) AS m FROM lo WHERE level > 0 GROUP BY ALL) GROUP BY ALL), {_COMPARED},
er AS (SELECT variant, count(*) AS n_rows, avg(abs(y - guess)) AS mae, 2.0 * count(*) FILTER (ratio AND y < 0.7 AND guess < 0.7) / nullif(2 * count(*) FILTER (ratio AND y < 0.7 AND guess < 0.7) + count(*) FILTER (ratio AND y >= 0.7 AND guess < 0.7) + count(*) FILTER (ratio AND y < 0.7 AND guess >= 0.7), 0) AS f1 FROM (SELECT *, avg(y) OVER (PARTITION BY variant, level, hour, wet) AS guess FROM lo) GROUP BY variant),
co1 AS (SELECT variant, count(rx) AS n, round(corr(rx, ry), 4) AS spearman FROM rk GROUP BY variant)
SELECT variant, coalesce(n, 0) AS n, spearman, coalesce(n_common, 0) AS n_common, coalesce(n_rows, 0) AS n_rows, round(mae, 5) AS mae, round(f1, 5) AS f1 FROM {_CONFIG_NAMES} LEFT JOIN co1 USING (variant) LEFT JOIN co USING (variant) LEFT JOIN er USING (variant)""")
def ablation_configs(v: Views) -> DataFrame:
    """Bin width, lanes, filling, rain and normalisation varied one at a time, all from one tree of steps."""
    return modelling.ablate(_CONFIGS, _Study(v), "default").select("variant", "n", _r("spearman", 4), "n_common", "n_rows", _r("mae", 5), _r("f1", 5))


_FULL = modelling.Config(minutes=60, confounders="feature", rain_lags=(1, 2))
_LEAN = modelling.Config(minutes=720, rain="none", calendar="none", warning="onehot", confounders="keep", fill="linear")


@query("model_table_full", "readings detectors signals rain holidays cyclones", f""", q AS MATERIALIZED {_config_sql(_FULL)} SELECT q.detector_id, q.bin, q.district, q.level, round(q.y, 6) AS y, q.rain, a.rain AS rain_1, b.rain AS rain_2, h.date IS NOT NULL AS on_holiday, EXISTS (SELECT 1 FROM cyclones s WHERE q.bin >= s."start" AND q.bin < s."end") AS under_cyclone, CASE WHEN h.date IS NOT NULL THEN 'holiday' WHEN isodow(q.bin) >= 6 THEN 'weekend' ELSE 'working' END AS day_type
FROM q LEFT JOIN (SELECT hour, district, (min_mm + max_mm) / 2.0 AS rain FROM rain) a ON a.district = q.district AND a.hour = date_trunc('hour', q.bin) - INTERVAL 1 hour LEFT JOIN (SELECT hour, district, (min_mm + max_mm) / 2.0 AS rain FROM rain) b ON b.district = q.district AND b.hour = date_trunc('hour', q.bin) - INTERVAL 2 hours LEFT JOIN holidays h ON h.date = CAST(q.bin AS DATE)""")
def model_table_full(v: Views) -> DataFrame:
    """Hourly bins with all the configuration can add: rain and its lags, warning, calendar and confounders."""
    return modelling.model_table(_FULL, _Study(v)).select("detector_id", "bin", "district", "level", _r("y"), "rain", "rain_1", "rain_2", "on_holiday", "under_cyclone", "day_type")


@query("model_table_lean", "readings detectors signals rain", f"SELECT detector_id, bin, CAST(level = 1 AS INTEGER) AS is_amber, CAST(level = 2 AS INTEGER) AS is_red, CAST(level = 3 AS INTEGER) AS is_black, round(y, 6) AS y FROM {_config_sql(_LEAN)}")
def model_table_lean(v: Views) -> DataFrame:
    """Half-day bins, short gaps filled, one-hot warnings, and nothing else: neither rain nor calendar is read."""
    return modelling.model_table(_LEAN, _Study(v)).select("detector_id", "bin", "is_amber", "is_red", "is_black", _r("y"))


def _district_folds(v: Views, rows: DataFrame) -> DataFrame:
    """Whole episodes of a district in one fold; rows have a district."""
    episodes = intervals.merge_intervals(_under(v, v.signals), ["under"])
    return study.split_by_episode(rows, episodes, keys={"district": "under"})


_CV = f"""SELECT q.ratio, CAST(q.level AS DOUBLE) AS a, coalesce((min_mm + max_mm) / 2.0, 0)::DOUBLE AS b, CAST(hour(time) AS DOUBLE) AS h, CAST(coalesce(e.episode_id, CAST(time AS DATE) - DATE '1970-01-01') % 3 AS INTEGER) AS fold FROM ratios q JOIN detectors d ON q.detector_id = d.detector_id LEFT JOIN rain r ON r.hour = date_trunc('hour', time) AND r.district = d.district LEFT JOIN ({_merged_sql("district", "0 minutes", "(SELECT s.*, district FROM signals s JOIN detectors USING (detector_id))")}) e ON e.district = d.district AND time >= e."start" AND time < e."end" WHERE ratio IS NOT NULL"""
_LINES = """SELECT f.fold, (cay * vb - cby * cab) / (va * vb - cab * cab) AS sa, (cby * va - cay * cab) / (va * vb - cab * cab) AS sb, my, ma, mb, ts, ti FROM (SELECT DISTINCT fold FROM m) f, LATERAL (SELECT covar_pop(ratio, a) AS cay, covar_pop(ratio, b) AS cby, covar_pop(a, b) AS cab, var_pop(a) AS va, var_pop(b) AS vb, avg(ratio) AS my, avg(a) AS ma, avg(b) AS mb, regr_slope(ratio, h) AS ts, regr_intercept(ratio, h) AS ti FROM m WHERE m.fold <> f.fold)"""


@query("linear_cv", "ratios rain detectors signals", f", m AS MATERIALIZED ({_CV}), l AS ({_LINES}) SELECT m.fold, count(*) AS n, round(any_value(sa), 5) AS slope_level, round(any_value(sb), 5) AS slope_rain, round(avg(abs(ratio - (my + sa * (a - ma) + sb * (b - mb)))), 5) AS mae, round(avg(abs(ratio - (ti + ts * h))), 5) AS mae_time_only FROM m JOIN l USING (fold) GROUP BY m.fold")
def linear_cv(v: Views) -> DataFrame:
    """A line of the speed ratio on level and rain, fitted without the fold of whole episodes it is tried on, beside one on the hour."""
    rows = _model_table(v).where("ratio is not null").select("time", "district", "ratio", F.col("level").cast("double").alias("level"), F.coalesce("rain", F.lit(0.0)).cast("double").alias("rain"), F.hour("time").cast("double").alias("hour"))
    rows = kept(_district_folds(v, rows))
    both, lines = study.linear_cv(rows, "ratio", ["level", "rain"])
    both, _ = study.linear_cv(both.withColumnRenamed("prediction", "by_both"), "ratio", ["hour"])
    error = lambda guess: F.round(F.avg(F.abs(F.col("ratio") - F.col(guess))), 5)
    slope = lambda k: F.create_map(*[F.lit(x) for fold, line in lines.items() for x in (fold, round(line[k], 5) if line else None)])[F.col("fold")]
    per_fold = both.groupBy("fold").agg(F.count("*").alias("n"), error("by_both").alias("mae"), error("prediction").alias("mae_time_only"))
    return per_fold.select("fold", "n", slope(1).alias("slope_level") if lines else F.lit(None).cast("double").alias("slope_level"), slope(2).alias("slope_rain") if lines else F.lit(None).cast("double").alias("slope_rain"), "mae", "mae_time_only")


@query("baseline_sketch", "readings", "SELECT detector_id, count(*) AS n, quantile_disc(speed, 0.5) AS baseline, quantile_disc(speed, 0.25) AS low, quantile_disc(speed, 0.75) AS high FROM readings WHERE speed IS NOT NULL AND CAST(time AS DATE) >= DATE '2024-01-10' GROUP BY detector_id")
def baseline_sketch(v: Views) -> DataFrame:
    """Quartiles of a period from sketches of days; exact where a detector has as many rows as a sketch holds, as here."""
    since = F.col("date") >= F.lit("2024-01-10").cast("date")
    return study.sketched_quantiles(study.daily_sketches(v.readings, ["detector_id"]), ["detector_id"], {"baseline": 0.5, "low": 0.25, "high": 0.75}, since)


def flagship(spark, sf_dir: str) -> DataFrame:
    return QUERIES["sensitivity"](spark, sf_dir)


from stormlane.plans import text_queries  # noqa: E402, F401  registers the readers' queries
