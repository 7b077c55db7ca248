"""Typed CSV tables, incremental output by partition, and the latest version of a source."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MINUTES = "yyyy-MM-dd'T'HH:mm"
EPISODES = "episode_id int, start timestamp_ntz, end timestamp_ntz, max_level int, n_signals bigint, provisional boolean"

MANIFEST = "date date, role string, episode_ids string, max_level int, max_level_name string"


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, set from ``spark.checkpoint.dir`` if it isn't set yet.

    Where the setting is absent a temporary folder serves, but only in local mode, where driver and tasks share it.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc._jsc.sc().getCheckpointDir().get()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the job's own, in whatever store it is; nothing happens if there is none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def kept(df: DataFrame) -> DataFrame:
    """A small result of long work, written once to the session's checkpoint folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def write_csv(df: DataFrame, path: str) -> None:
    """With a header and times to the minute; an empty table gives a header alone."""
    df.write.option("header", True).option("timestampNTZFormat", MINUTES).mode("overwrite").csv(path)


def write_sorted(df: DataFrame, path: str, *order: str) -> None:
    """As ``write_csv``, in order over all files and within each: the i-th file by name holds the i-th range of ``order``."""
    write_csv(df.orderBy(*order), path)


def write_manifest(days: DataFrame, path: str) -> None:
    """Selected days (date, role, episode_ids, max_level, max_level_name) by date; an array of ids becomes text with spaces between."""
    ids = F.array_join(F.col("episode_ids").cast("array<string>"), " ") if dict(days.dtypes)["episode_ids"].startswith("array") else F.col("episode_ids")
    write_sorted(days.withColumn("episode_ids", ids).select(*[f.split(" ")[0] for f in MANIFEST.split(", ")]), path, "date")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The days of a manifest; episode_ids as text, empty for control days."""
    return read_csv(spark, path, MANIFEST).fillna("", ["episode_ids", "max_level_name"])


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).option("timestampNTZFormat", MINUTES).schema(schema).csv(path)


def write_pending(df: DataFrame, path: str, by: str = "date") -> None:
    """Writes the partitions of ``df``; those it has replace older ones, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def pending_partitions(df: DataFrame, done: DataFrame, by: str = "date") -> DataFrame:
    """The rows of partitions that are not among the done ones."""
    return df.join(done.select(by).distinct(), by, "left_anti")


def latest_snapshot(versions: DataFrame, key: str, at: str, content: str, now, days: int = 30) -> DataFrame:
    """Per key the newest content of the last ``days`` days before ``now``, or null, flagged, if there is none."""
    recent = F.col(at) >= F.lit(now) - F.make_dt_interval(F.lit(days))
    return versions.where(F.col(at) <= F.lit(now)).groupBy(key).agg(F.max_by(F.when(recent, F.col(content)), F.when(recent, F.struct(at, content))).alias(content), F.max(F.when(recent, F.col(at))).alias(at), (~F.bool_or(recent)).alias("missing"))
