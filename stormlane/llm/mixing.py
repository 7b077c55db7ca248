"""Mixing sources to target weights with DataFrame functions only.

Each source gets a share of the words by its ratio, up to a cap; what a capped source can't take is shared out again among the rest.
That ends where sources, ordered by cap over ratio, are capped up to some place and take one level times their ratio from there on.

A source whose target exceeds its size is taken whole as often as it goes (complete epochs). The rest of the target is filled by
weighted sampling without replacement: a document's key is -ln(u) over its quality weight, u coming from a hash of its id, and
documents are taken by rising key until the words are up; the last one is cut. So that no source is one group, keys fall in cells of
1/1024 of a doubling, which keep their order. Sizes are added up over the cells of a source, and within a cell over its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormlane.llm.common import table

RATIOS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Quality weights in the query: of documents labelled bad, not labelled, labelled good.
BAD, UNKNOWN, GOOD = 1.0, 2.0, 4.0
_WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]"
_CELLS, _LAST = 1024.0, 1 << 40


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, ratios: tuple = RATIOS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from one row per source (source, source_size), which is all that is ordered as a whole.

    Sources take ``ratios`` in turn, by code point, a null source last. Targets add up to ``share`` of all sizes unless every
    source is capped at ``most`` times its own.
    """
    turn = F.pmod(F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(len(ratios)))
    rows = sizes.withColumn("_ratio", F.get(F.array(*[F.lit(float(r)) for r in ratios]), turn)).withColumn("_cap", most * F.col("source_size"))
    every = Window.partitionBy()
    rows = rows.withColumn("_words", share * F.sum("source_size").over(every)).withColumn("_ratios", F.sum("_ratio").over(every))
    need = Window.orderBy(F.col("_cap") / F.col("_ratio"), F.asc_nulls_last("source"))
    before = need.rowsBetween(Window.unboundedPreceding, -1)
    left = lambda whole, part: F.col(whole) - F.coalesce(F.sum(part).over(before), F.lit(0.0))
    level = rows.withColumn("_level", left("_words", "_cap") / left("_ratios", "_ratio"))
    open_ = F.when(F.col("_level") * F.col("_ratio") <= F.col("_cap"), F.col("_level"))
    level = level.withColumn("_level", F.first(open_, ignorenulls=True).over(need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return level.select("source", "source_size", F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_level") * F.col("_ratio"))).alias("target"))


def sampling_key(id_col: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight; u has 52 bits of a hash of the id (a null one counts as empty). Without a positive weight it is infinite."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    good = weight.isNotNull() & ~F.isnan(weight) & (weight > 0) & (weight < float("inf"))
    return F.when(good, -F.ln(u) / weight).otherwise(F.lit(float("inf")))


def mix(docs: DataFrame, weight: Column | None = None, weights: DataFrame | None = None, default_weight: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", ratios: tuple = RATIOS, share: float = SHARE, most: float = MOST, seed: int = 12) -> DataFrame:
    """(id, size, source_size, target, taken, source, text_hash) per row of ``docs``.

    Quality weights are an expression ``weight`` over the columns of ``docs``, or a table ``weights`` (id, weight) of one row an id, which
    sizes are joined with rather than texts; documents it lacks have ``default_weight``. Without either all weigh alike. Documents with
    a null or non-positive weight come last. ``taken`` counts words: whole epochs, and the words of the last, partial one. The taken words of a
    source add up to its target, rounded down; with ``most`` a whole number none takes more than that times its size.
    Null and empty texts have size 0. Equal rows are ordered as one, each counting; an empty table gives no rows; other columns are
    left out.
    """
    weighed = F.lit(default_weight) if weight is None else weight.cast("double")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("text_hash"), weighed.alias("weight"))
    if weights is not None:
        known = weights.select(F.col("id"), F.col("weight").cast("double").alias("own_weight"), F.lit(True).alias("known"))
        rows = rows.join(known, "id", "left").withColumn("weight", F.when(F.col("known"), F.col("own_weight")).otherwise(F.col("weight"))).drop("own_weight", "known")
    rows = rows.withColumn("key", sampling_key(F.col("id"), F.col("weight"), seed)).drop("weight")
    rows = rows.groupBy("id", "source", "size", "text_hash", "key").agg(F.count("*").alias("copies"))
    cell = F.when((F.col("key") > 0) & (F.col("key") < float("inf")), F.floor(F.log2("key") * _CELLS)).when(F.col("key") <= 0, -_LAST).otherwise(_LAST).cast("long")
    rows = rows.withColumn("cell", cell).withColumn("words", F.col("size") * F.col("copies"))
    cells = rows.groupBy("source", "cell").agg(F.sum("words").alias("words"))
    aims = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), ratios, share, most).alias("t")
    up = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("below", F.coalesce(F.sum("words").over(up), F.lit(0))).drop("words").alias("c")
    cells = cells.join(aims, F.col("c.source").eqNullSafe(F.col("t.source"))).select(F.col("c.source").alias("its_source"), F.col("cell").alias("its_cell"), "below", "source_size", "target")
    met = rows.join(cells, F.col("source").eqNullSafe(F.col("its_source")) & (F.col("cell") == F.col("its_cell")))
    within = Window.partitionBy("source", "cell").orderBy("key", F.asc_nulls_last("id"), "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long")
    placed = met.withColumn("start", F.col("below") + F.coalesce(F.sum("words").over(within), F.lit(0))).withColumn("epochs", epochs)
    placed = placed.withColumn("budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    more = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("budget") - F.col("start") - F.col("copy") * F.col("size")))
    return placed.select("id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + more).alias("taken"), "source", "text_hash")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, as it stands."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"{_SPACE}*{_WORD}"), F.lit(0)), F.lit(1), n.cast("int")), "")


def mixture(docs: DataFrame, weight: Column | None = None, weights: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """(id, source, epoch, text): the mix itself, a row per document and epoch from 0, the last one perhaps the first words only.

    Documents that aren't taken, and texts without words, have no row. Equal rows stand in it as often as they are.
    """
    plan = mix(docs, weight, weights, id_col=id_col, text_col=text_col, source_col=source_col, **options).where("taken > 0").groupBy("id", "source", "text_hash", "size", "taken").agg(F.count("*").alias("copies"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash")).groupBy("id", "source", "text_hash").agg(F.first("text").alias("text")).alias("d")
    p = plan.alias("p")
    same = F.col("p.id").eqNullSafe(F.col("d.id")) & F.col("p.source").eqNullSafe(F.col("d.source")) & (F.col("p.text_hash") == F.col("d.text_hash"))
    each = p.join(texts, same).select("p.id", "p.source", "size", "taken", "text", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    each = each.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    rest = F.col("taken") - F.col("epoch") * F.col("size")
    return each.select("id", "source", "epoch", F.when(rest >= F.col("size"), F.col("text")).otherwise(first_words(F.col("text"), rest)).alias("text"))


def op12_mixing_sources(spark, sf_dir):
    """Documents labelled good are taken before others, those labelled bad after them; several labels of a document are averaged."""
    quality = table(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("quality")).where("quality is not null")
    weights = quality.select(F.col("doc_id").alias("id"), F.when(F.col("quality") >= 0.5, GOOD).otherwise(BAD).alias("weight"))
    return mix(table(spark, sf_dir, "documents"), weights=weights, default_weight=UNKNOWN).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


_SQL = rf"""
WITH q AS (SELECT doc_id, avg(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT row_number() OVER () AS row_no, doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS BIGINT) AS size, -ln((('0x' || substr(sha256('12:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT + 0.5e0) / 4503599627370496e0) / (CASE WHEN quality >= 0.5 THEN {GOOD} WHEN quality IS NOT NULL THEN {BAD} ELSE {UNKNOWN} END)::DOUBLE AS key FROM documents LEFT JOIN q USING (doc_id)),
s AS (SELECT source, sum(size)::DOUBLE AS source_size, [3e0, 1e0, 2e0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS ratio FROM d GROUP BY source),
l AS (SELECT max(level) AS level FROM (SELECT a.source, (1.5e0 * (SELECT sum(source_size) FROM s) - coalesce(sum(2 * b.source_size) FILTER (2 * b.source_size / b.ratio < 2 * a.source_size / a.ratio), 0)) / sum(b.ratio) FILTER (2 * b.source_size / b.ratio >= 2 * a.source_size / a.ratio) AS level, any_value(2 * a.source_size / a.ratio) AS need FROM s a, s b GROUP BY a.source) WHERE level <= need),
t AS (SELECT source, source_size, least(2 * source_size, level * ratio) AS target FROM s, l),
w AS (SELECT d.*, t.source_size, t.target, coalesce(floor(t.target / nullif(t.source_size, 0)), 0) AS epochs, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS LAST, size, row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, round(target, 6) AS target, CAST(epochs * size + least(size, greatest(0, floor(target - epochs * source_size) - before)) AS BIGINT) AS taken FROM w
"""

QUERIES = {"op12_mixing_sources": lambda spark, sf_dir: op12_mixing_sources(spark, sf_dir).withColumn("target", F.round("target", 6))}
ORACLE_SQL = {"op12_mixing_sources": _SQL}
