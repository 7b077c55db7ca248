"""The given tables seen as road and weather data, as DataFrames and as SQL for DuckDB.

Readings and signals come from events, detectors from customers and nations, versions from orders, rain from page views.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormlane.operators.align import sized
from stormlane.sources.tables import kept


class Views:
    """The views over one folder of tables. Those that are small sums of the events are made once, written and read from there."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))

    @property
    def readings(self) -> DataFrame:
        return self.events.select(
            "event_id",
            F.col("ts").alias("time"),
            F.col("user_id").alias("detector_id"),
            F.col("event_type").alias("lane_id"),
            F.col("value").alias("speed"),
            F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("occupancy"),
            (F.col("event_id") % 7).cast("int").alias("volume"),
            F.when(F.col("event_id") % 200 == 0, "N").otherwise("Y").alias("valid"),
        )

    @cached_property
    def detectors(self) -> DataFrame:
        nation = self.table("nation").select("n_nationkey", F.col("n_name").alias("district"))
        return self.table("customer").join(sized(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("detector_id"), F.col("c_name").alias("road"), "district", F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 100).cast("double").alias("y"))

    @cached_property
    def places(self) -> DataFrame:
        """Each detector's district as column under, broadcast if their number allows."""
        return sized(self.detectors.select("detector_id", F.col("district").alias("under")))

    def _intervals(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("start", F.col("ts")).withColumn("end", F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.floor("value").cast("int")))

    @cached_property
    def signals(self) -> DataFrame:
        last = kept(self.events.agg((F.max("event_id") * 9).alias("last")))
        rows = self._intervals(self.events.where("event_type = 'error'")).crossJoin(F.broadcast(last))
        return rows.select(F.col("event_id").alias("signal_id"), F.col("user_id").alias("detector_id"), "start", "end", (F.col("event_id") % 3 + 1).cast("int").alias("level"), (F.col("event_id") * 10 > F.col("last")).alias("provisional"))

    @property
    def cyclones(self) -> DataFrame:
        return self._intervals(self.events.where("event_type = 'purchase' and value > 200")).select(F.col("event_id").alias("signal_id"), "start", "end", F.lit(8).alias("signal"))

    @cached_property
    def rain(self) -> DataFrame:
        views = self.events.where("event_type = 'view'").withColumnRenamed("user_id", "detector_id").join(self.detectors, "detector_id")
        hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
        return views.groupBy(hour.alias("hour"), "district").agg(F.floor(F.min("value") / 10).cast("int").alias("min_mm"), F.ceil(F.max("value") / 10).cast("int").alias("max_mm"))

    @cached_property
    def holidays(self) -> DataFrame:
        """Days whose largest value is above the mean of all days' largest, named by its event; the view's n tells versions apart."""
        day = kept(self.events.groupBy(F.to_date("ts").alias("date")).agg(F.max("value").alias("top"), F.max_by("event_id", F.struct("value", "event_id")).alias("n")))
        mean = F.broadcast(day.agg(F.avg("top").alias("mean")))
        return day.crossJoin(mean).where("top > mean").select("date", F.concat(F.lit("Holiday "), F.col("n").cast("string")).alias("name"), "n")

    @property
    def days(self) -> DataFrame:
        return self.holidays.select("date", "name")

    @property
    def versions(self) -> DataFrame:
        return self.table("orders").groupBy(F.col("o_custkey").alias("key"), F.col("o_orderdate").cast("timestamp_ntz").alias("valid_from")).agg(F.max("o_orderkey").alias("version"))

    @property
    def probes(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("order_no"), F.col("l_linenumber").alias("line_no"), F.col("l_suppkey").alias("key"), F.col("l_shipdate").cast("timestamp_ntz").alias("time"))


#: The same views in SQL; a query takes those it names.
SQL = {
    "readings": """SELECT event_id, ts AS time, user_id AS detector_id, event_type AS lane_id, value AS speed, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS occupancy, CAST(event_id % 7 AS INTEGER) AS volume, CASE WHEN event_id % 200 = 0 THEN 'N' ELSE 'Y' END AS valid FROM events""",
    "detectors": """SELECT c_custkey AS detector_id, c_name AS road, n_name AS district, c_acctbal AS x, CAST(c_custkey % 100 AS DOUBLE) AS y FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "signals": """SELECT event_id AS signal_id, user_id AS detector_id, ts AS "start", ts + to_minutes(CAST(floor(value) AS BIGINT)) AS "end", CAST(event_id % 3 + 1 AS INTEGER) AS level, event_id * 10 > 9 * (SELECT max(event_id) FROM events) AS provisional FROM events WHERE event_type = 'error'""",
    "cyclones": """SELECT event_id AS signal_id, ts AS "start", ts + to_minutes(CAST(floor(value) AS BIGINT)) AS "end", 8 AS signal FROM events WHERE event_type = 'purchase' AND value > 200""",
    "rain": """SELECT date_trunc('hour', ts) AS hour, n_name AS district, CAST(floor(min(value) / 10) AS INTEGER) AS min_mm, CAST(ceil(max(value) / 10) AS INTEGER) AS max_mm FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE event_type = 'view' GROUP BY ALL""",
    "holidays": """SELECT date, 'Holiday ' || n AS name, n FROM (SELECT *, avg(top) OVER () AS mean FROM (SELECT CAST(ts AS DATE) AS date, max(value) AS top, max(struct_pack(value := value, n := event_id)).n AS n FROM events GROUP BY ALL)) WHERE top > mean""",
    "versions": """SELECT o_custkey AS "key", o_orderdate AS valid_from, max(o_orderkey) AS version FROM orders GROUP BY ALL""",
    "probes": """SELECT l_orderkey AS order_no, l_linenumber AS line_no, l_suppkey AS "key", l_shipdate AS time FROM lineitem""",
    "clean": """SELECT event_id, time, detector_id, lane_id, CASE WHEN volume <> 0 THEN speed END AS speed, occupancy, volume FROM readings WHERE valid = 'Y' AND speed BETWEEN 0 AND 130 AND occupancy BETWEEN 0 AND 100""",
    "six": """SELECT detector_id, time_bucket(INTERVAL 6 hours, time) AS bin, count(*) AS n, avg(speed) AS speed, avg(occupancy) AS occupancy, sum(volume) AS volume FROM clean GROUP BY ALL""",
    "episodes": """SELECT CAST(row_number() OVER (ORDER BY "start") AS INTEGER) AS episode_id, * FROM (SELECT min("start") AS "start", max("end") AS "end", max(level) AS max_level, count(*) AS n_signals, bool_or(provisional) AS provisional FROM (SELECT *, sum(opens) OVER (ORDER BY "start", signal_id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN "start" <= max("end") OVER (ORDER BY "start", signal_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM signals)) GROUP BY island)""",
    "levels": """SELECT r.*, coalesce(w.level, 0) AS level, (epoch_us(r.time) - epoch_us(w."start")) // 60000000 AS minutes_since FROM readings r LEFT JOIN (SELECT event_id, max(struct_pack(level := level, "start" := s."start")).level AS level, max(struct_pack(level := level, "start" := s."start"))."start" AS "start" FROM (SELECT event_id, time, district FROM readings JOIN detectors USING (detector_id)) p JOIN (SELECT "start", "end", level, district FROM signals JOIN detectors USING (detector_id)) s ON p.district = s.district AND time >= s."start" AND time < s."end" GROUP BY event_id) w USING (event_id)""",
    "baseline": """SELECT detector_id, median(speed) AS baseline FROM levels WHERE level = 0 AND valid = 'Y' AND volume <> 0 AND speed BETWEEN 0 AND 130 GROUP BY detector_id""",
    "ratios": """SELECT l.*, speed / nullif(baseline, 0) AS ratio FROM levels l JOIN baseline USING (detector_id) WHERE valid = 'Y' AND volume <> 0 AND speed BETWEEN 0 AND 130""",
    "sensitive": """SELECT detector_id, level, count(*) AS n, median(ratio) - 1 AS sensitivity FROM ratios WHERE level > 0 GROUP BY ALL""",
    "ranking": """SELECT detector_id, avg(sensitivity) AS sensitivity FROM sensitive GROUP BY detector_id""",
}
_NEEDS = {"clean": ["readings"], "six": ["clean"], "episodes": ["signals"], "levels": ["readings", "signals", "detectors"], "baseline": ["levels"], "ratios": ["baseline"], "sensitive": ["ratios"], "ranking": ["sensitive"]}


def with_views(names: str, query: str) -> str:
    """The query behind a WITH of the named views and of those they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in ordered) + " " + query if ordered else query
