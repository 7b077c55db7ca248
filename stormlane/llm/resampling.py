"""Importance resampling of documents towards a target distribution of hashed n-grams.

Texts become features by Arrow kernels, a batch at a time: ``ascii_lower``, ``split_pattern_regex`` and ``list_flatten`` give the
words, ``dictionary_encode`` their indices. An n-gram is the index of the n-gram one word shorter beside the index of the word n
places on; equal pairs are encoded again, and only distinct ones are hashed, by carrying the shorter one's CRC-32 on over the next
word. A task adds up its bucket counts and hands over one row per bucket; the gains of all buckets, eight bytes each, go back to
the tasks, where ``take`` and a reduction by segments give each document its weight.

Gumbel noise from a hash of the id makes the highest scores a sample without replacement that is proportional to the weights.
Scores are whole numbers, so there are few of them: a gain is between -1000 ln and 1000 ln of the corpus size, the noise within
25,000. Documents are counted per score, the counts are added up from the top, and rows are only ordered within their own score.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stormlane.llm.common import checkpointed, map_arrow, sql_type, table

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Settings:
    longest: int = 1
    buckets: int = 10_000
    scale: float = 1000.0
    seed: int = 2024
    least_words: int = 20
    percent: float = 10


def features(texts: pa.Array, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1 to ``longest`` words: the row of every feature, ascending, and its bucket. Null texts have none."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), _BETWEEN)
    words, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    some = pc.not_equal(words, "")  # a text may begin or end between words
    coded, rows = words.filter(some).dictionary_encode(), rows.filter(some).to_numpy()
    index, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.binary()).to_pylist()
    crcs, grams = [zlib.crc32(name) for name in names], index
    spaced = [b" " + name for name in names] if longest > 1 else []
    yield rows, np.array(crcs, dtype=np.int64)[grams] % buckets if len(grams) else grams
    for n in range(2, longest + 1):
        whole = rows[: len(rows) - n + 1] == rows[n - 1 :]  # the run stays within its text
        pairs = pa.array((grams[: len(rows) - n + 1] * len(names) + index[n - 1 :])).dictionary_encode()
        first, second = np.divmod(pairs.dictionary.to_numpy(), max(1, len(names)))
        crcs, grams = [zlib.crc32(spaced[b], crcs[a]) for a, b in zip(first.tolist(), second.tolist())], pairs.indices.to_numpy().astype(np.int64)
        yield rows[: len(grams)][whole], np.array(crcs, dtype=np.int64)[grams[whole]] % buckets if whole.any() else grams[whole]


def bucket_counts(docs: DataFrame, text_col: str, settings: Settings) -> np.ndarray:
    """How many features of all texts fall in each bucket; at most ``buckets`` sums come to the driver."""

    def run(batches):
        counts = np.zeros(settings.buckets, dtype=np.int64)
        for batch in batches:
            for _, buckets in features(batch.column(0), settings.longest, settings.buckets):
                counts += np.bincount(buckets, minlength=settings.buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["bucket", "n"])

    sums = map_arrow(docs.select(F.col(text_col).cast("string").alias("text")), run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(settings.buckets, dtype=np.int64)
    for row in sums.collect():
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: float) -> np.ndarray:
    """Whole-numbered log ratios of target to source per bucket, both smoothed by one feature a bucket."""
    s, t, n = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(scale * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(source.tolist(), target.tolist())], dtype=np.int64)


def weights(docs: DataFrame, found: np.ndarray, settings: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) per row of ``docs``: the mean gain of its features, rounded down; 0 without any."""
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches):
        table_of_gains = pa.array(shared.value)
        for batch in batches:
            total, count, words = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for n, (rows, buckets) in enumerate(features(batch.column(1), settings.longest, settings.buckets)):
                if not len(rows):
                    continue
                starts = np.flatnonzero(np.diff(rows, prepend=-1))
                own = rows[starts]
                sizes = np.diff(starts, append=len(rows))
                total[own] += np.add.reduceat(table_of_gains.take(pa.array(buckets)).to_numpy(), starts)
                count[own] += sizes
                if n == 0:
                    words[own] = sizes
            weight = np.where(count > 0, total // np.maximum(count, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, count, weight))], ["id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, f"id {sql_type(docs, id_col)}, n_words bigint, n_features bigint, weight bigint")


def noise(id_col: str, settings: Settings):
    """Gumbel noise from the first 32 bits of a hash of the id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-settings.scale) * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def draw(scored: DataFrame, settings: Settings) -> DataFrame:
    """``scored`` (id, n_words, n_features, weight, score) with rank: 1, 2, 3... by falling score, then by id (a null id last), of the
    drawn ``percent`` of the rows with ``least_words``; null elsewhere.

    Equal rows are ordered as one and take ranks in a row, so an id that repeats very often is no large group.
    """
    enough, columns = F.col("n_words") >= settings.least_words, scored.columns
    down = Window.orderBy(F.desc("score"))
    by_score = scored.where(enough).groupBy("score").agg(F.count("*").alias("_at_score"))
    by_score = by_score.withColumn("_above", F.coalesce(F.sum("_at_score").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    wanted = F.floor(F.sum("_at_score").over(Window.partitionBy()) * settings.percent / 100)
    high = by_score.withColumn("_wanted", wanted).where(F.col("_above") < F.col("_wanted")).select("score", "_above", "_wanted")
    met = scored.join(F.broadcast(high), "score", "left")  # as many rows as there are scores
    chosen = enough & F.col("_above").isNotNull()
    low = met.where(~chosen).select(*columns, F.lit(None).cast("long").alias("rank"))
    equal = met.where(chosen).groupBy(*columns, "_above", "_wanted").agg(F.count("*").alias("_copies"))
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("id"), "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1)
    placed = equal.withColumn("_before", F.col("_above") + F.coalesce(F.sum("_copies").over(order), F.lit(0)))
    each = placed.withColumn("rank", F.explode(F.sequence(F.col("_before") + 1, F.col("_before") + F.col("_copies"))))
    return low.unionByName(each.select(*columns, F.when(F.col("rank") <= F.col("_wanted"), F.col("rank")).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) per row of ``docs``, drawn towards the texts of ``target``.

    Null and empty texts have no features, weight 0 and no rank. Repeated rows each count and each are ranked; other columns are
    left out. An empty ``docs`` gives no rows; an empty ``target`` makes all features of a common bucket cost alike.
    """
    found = gains(bucket_counts(docs, text_col, settings), bucket_counts(target, target_text_col, settings), settings.scale)
    scored = weights(docs, found, settings, id_col, text_col).withColumn("score", F.col("weight") + noise("id", settings))
    return draw(checkpointed(scored), settings)


def op13_importance_resampling(spark, sf_dir):
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


_WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, {_WORDS} AS words FROM documents),
dw AS (SELECT row_no, unnest(words) AS w FROM d),
bw AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
v AS MATERIALIZED (SELECT w, xor(list_reduce(list_transform(range(0, strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS BIGINT), 2))::BIGINT), lambda c, b: list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295), 4294967295) % 10000 AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
sc AS (SELECT bucket, count(*) AS s FROM dw JOIN v USING (w) GROUP BY bucket),
tc AS (SELECT bucket, count(*) AS t FROM bw JOIN v USING (w) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1e0) * ((SELECT sum(s) FROM sc) + 1e4) / ((s + 1e0) * (coalesce((SELECT sum(t) FROM tc), 0) + 1e4)))) AS BIGINT) AS gain FROM sc LEFT JOIN tc USING (bucket)),
m AS (SELECT row_no, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM dw JOIN v USING (w) JOIN g USING (bucket) GROUP BY row_no),
c AS (SELECT row_no, doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5e0) / 4294967296e0))) AS BIGINT) AS score FROM d LEFT JOIN m USING (row_no)),
r AS (SELECT row_no, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS rank FROM c WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= floor(10 * (SELECT count(*) FROM r) / 100e0) THEN rank END AS rank FROM c LEFT JOIN r USING (row_no)
"""

QUERIES = {"op13_importance_resampling": op13_importance_resampling}
ORACLE_SQL = {"op13_importance_resampling": _SQL}
