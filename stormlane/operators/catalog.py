"""Plans of requests, what of them is pending, and the coverage of archived resources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stormlane.functions.scalar import item_first_day, item_kind
from stormlane.operators.intervals import collapse_runs

PLAN = "url string, dates array<string>, `range` array<string>, exclude array<string>, dictionary array<string>, `schema` array<string>"


def read_plan(text: DataFrame, column: str = "content") -> DataFrame:
    """Entries of JSON plans, one row each."""
    return text.select(F.explode(F.from_json(column, f"array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in PLAN.split(', '))}>>")).alias("e")).select("e.*")


def expand_plan(entries: DataFrame) -> DataFrame:
    """(url, kind, item): the files of each entry (its dates, or the months of its range less the excluded), then documents.

    An entry with both dates and range, with neither nor documents, or with an exclude but no range has one row of kind
    'rejected'; items of a wrong shape have kind 'bad'; an excluded month that the range doesn't have has one of kind 'idle exclude'.
    """
    both = F.col("dates").isNotNull() & F.col("range").isNotNull()
    idle = F.col("dates").isNull() & F.col("range").isNull() & F.col("dictionary").isNull() & F.col("schema").isNull()
    wrong = both | idle | (F.col("exclude").isNotNull() & F.col("range").isNull())
    months = F.transform(F.sequence(item_first_day(F.col("range")[0]), item_first_day(F.col("range")[1]), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM"))
    items = F.coalesce("dates", F.array_except(months, F.coalesce("exclude", F.array().cast("array<string>"))), F.array().cast("array<string>"))
    none = F.array().cast("array<struct<kind:string,item:string>>")
    tagged = lambda column, kind: F.coalesce(F.transform(column, lambda x: F.struct(kind(x).alias("kind"), x.alias("item"))), none)
    idle_excludes = tagged(F.when(F.col("range").isNotNull(), F.array_except("exclude", months)), lambda x: F.lit("idle exclude"))
    documents = [tagged(F.col(c), lambda x, c=c: F.lit(c)) for c in ("dictionary", "schema")]
    requests = F.when(wrong, F.array(F.struct(F.lit("rejected").alias("kind"), F.lit(None).cast("string").alias("item")))).otherwise(F.concat(tagged(items, item_kind), idle_excludes, *documents))
    return entries.select("url", F.explode(requests).alias("r")).select("url", "r.kind", "r.item")


def pending(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks without an output."""
    return tasks.join(done.select(*keys).distinct(), keys, "left_anti")


def plan_totals(tasks: DataFrame) -> DataFrame:
    """Number, known bytes and unknown sizes per URL and in total (url null)."""
    return tasks.rollup("url").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.count_if(F.col("size").isNull()).alias("n_unknown"))


def estimated_sizes(tasks: DataFrame, above: int = 20, n: int = 5, order=None) -> DataFrame:
    """Bytes per URL: all sizes summed, or with more than ``above`` tasks the mean of ``n`` of them times their number.

    The first ``n`` by ``order`` are taken; of tasks that it leaves equal the smaller sizes come first, so reruns agree.
    """
    place = F.row_number().over(Window.partitionBy("url").orderBy(*(order or [F.rand(1)]), "size"))
    chosen = tasks.withColumn("place", place).groupBy("url").agg(F.count("*").alias("n"), F.sum("size").alias("all"), F.avg(F.when(F.col("place") <= n, F.col("size"))).alias("mean"))
    return chosen.select("url", "n", F.when(F.col("n") > above, F.col("mean") * F.col("n")).otherwise(F.col("all").cast("double")).alias("bytes"))


def read_coverage(text: DataFrame, column: str = "content") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(resources, bundles, snapshots) of saved coverage responses with columns url and JSON text."""
    schema = "`data-files` array<struct<timestamp:string,period:string,size:bigint>>, timestamps array<string>, `version-count` bigint, `total-size` bigint"
    parsed = text.select("url", F.from_json(column, schema).alias("c"))
    resources = parsed.select("url", F.col("c.version-count").alias("version_count"), F.col("c.total-size").alias("total_size"), F.size("c.timestamps").cast("long").alias("listed"))
    bundles = parsed.select("url", F.explode("c.data-files").alias("f")).select("url", "f.timestamp", "f.period", "f.size")
    return resources, bundles, parsed.select("url", F.explode("c.timestamps").alias("timestamp"))


def listing_truncated(resources: DataFrame) -> DataFrame:
    return resources.withColumn("truncated", F.col("listed") < F.col("version_count"))


def coverage_brief(resources: DataFrame, bundles: DataFrame) -> DataFrame:
    """A line per resource: versions, ranges of monthly and daily bundles, number of others."""
    ranges = None
    for period, unit, name in (("M", "month", "months"), ("D", "day", "days")):
        dated = bundles.where(F.col("period") == period).withColumn("day", F.to_date(F.substring("timestamp", 1, 8), "yyyyMMdd"))
        found = collapse_runs(dated, ["url"], "day", unit).withColumnRenamed("ranges", name)
        ranges = found if ranges is None else ranges.join(found, "url", "full")
    others = bundles.where(~F.col("period").isin("M", "D")).groupBy("url").agg(F.count("*").alias("others"))
    joined = resources.select("url", "version_count").join(ranges, "url", "left").join(others, "url", "left")
    part = lambda name: F.when(F.col(name).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(name)))
    rest = F.when(F.col("others").isNotNull(), F.concat(F.lit("other: "), F.col("others").cast("string")))
    return joined.select("url", F.concat_ws("; ", F.concat(F.lit("versions: "), F.col("version_count").cast("string")), part("months"), part("days"), rest).alias("line"))


def doc_dates(entries: DataFrame) -> DataFrame:
    """Distinct dates per URL, ascending."""
    return entries.groupBy("url").agg(F.array_join(F.array_sort(F.collect_set("item")), " ").alias("dates"))
