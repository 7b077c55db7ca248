"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormlane.sources.tables import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark removes an execution's shuffle files at its end; else they stay until the driver happens to collect its garbage.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back: lineage ends here, lost executors cost no more than what follows, and
    the shuffle files behind the rows go."""
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(_FREE_SHUFFLES)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a frame takes the setting that holds when it is made
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)


#: A key with more than one row in so many is a hot one, so there are fewer hot keys than this.
HOT_SHARE = 1000


def join_spread(rows: DataFrame, facts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """``rows`` joined to ``facts`` (one row per key, column ``n`` with the key's number of rows, best checkpointed) without its ``n``.

    The facts of hot keys, fewer than ``HOT_SHARE`` of them, are broadcast, so that their rows stay where they are; the others' rows
    are shuffled. Null keys and keys without facts are left out; ``rows`` is read twice.
    """
    total = facts.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(facts.where(F.col(n) * HOT_SHARE > total).drop(n))
    rest = facts.where(F.col(n) * HOT_SHARE <= total).drop(n)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key))


#: Spark fills Arrow batches up to 64 MB of its own accord; JVM and worker hold a batch several times over.
_BATCH, _DEFAULT_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow over batches of about ``BATCH_BYTES``, unless the session has a bound of its own. What Arrow has freed goes back
    to the system after each batch and task: workers live on over stages, and what they keep counts as the executor's memory."""

    def releasing(batches):
        for out in run(batches):
            yield out
            pa.default_memory_pool().release_unused()
        pa.default_memory_pool().release_unused()

    if df.sparkSession.conf.get(_BATCH) == _DEFAULT_BATCH:
        df.sparkSession.conf.set(_BATCH, BATCH_BYTES)
    return df.mapInArrow(releasing, schema)


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % n


def is_fold(id_col: Column, n: int, k: int) -> Column:
    """Whether the row belongs to fold k; false for a null id."""
    return F.coalesce(fold(id_col, n) == k, F.lit(False))


def sql_type(df: DataFrame, col: str) -> str:
    """The type of a column in DDL form, for the schemas of Arrow functions."""
    return df.schema[col].dataType.simpleString()
