"""Compression of vectors to codes, a byte per part, with equal-average search for the nearest codebook entry.

Components become whole numbers, vectors are cut into equal parts, and each part position has a codebook of its own. Entries are
sorted by the sum of their components. A part starts at the entry whose sum is nearest to its own and goes outwards, always to the
side with the smaller gap. The squared gap over the number of components is never more than the squared distance, so the search ends
where it strictly exceeds the best distance so far: an equal one may still belong to an entry of a lower index. All parts of a batch
take their steps together, and those that have ended drop out.

Fitting starts from the vectors of the least ids and repeats: every part goes to its nearest entry, tasks add up components and
counts per entry, and entries become the means, rounded down. Only these sums and the codebooks pass through the driver, one row per
part, entry and position, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormlane.llm.common import checkpointed, map_arrow, sql_type, table

_ROWS = 4096


@dataclass(frozen=True)
class Settings:
    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256


class Codebooks:
    """Entries by part, (parts, entries, width), and their order by component sum."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        sums = entries.sum(axis=2)
        self.order = np.argsort(sums, axis=1, kind="stable")
        self.sums = np.take_along_axis(sums, self.order, axis=1)
        self.sorted = np.take_along_axis(entries, self.order[:, :, None], axis=1)

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part of whole-numbered vectors (rows, parts, width), of equals the one of the lowest index,
        and its squared distance: (rows, parts) each."""
        rows, parts, width = vectors.shape
        m = self.entries.shape[1]
        flat, part = vectors.reshape(-1, width), np.tile(np.arange(parts), rows)
        own = flat.sum(axis=1)
        above = np.stack([np.searchsorted(self.sums[p], own[p::parts]) for p in range(parts)], axis=1).ravel() if rows else np.empty(0, dtype=np.int64)
        far = np.int64(1) << 31
        best, found = np.full(rows * parts, (np.int64(1) << 62) // width), np.full(rows * parts, m)
        going, low, high = np.arange(rows * parts), above - 1, above
        while len(going):
            p = part[going]
            under = np.where(low >= 0, own[going] - self.sums[p, np.maximum(low, 0)], far)
            over = np.where(high < m, self.sums[p, np.minimum(high, m - 1)] - own[going], far)
            down, gap = under <= over, np.minimum(under, over)
            on = (gap < far) & (gap * gap <= best[going] * width)
            going, p, low, high, down = going[on], p[on], low[on], high[on], down[on]
            place = np.where(down, low, high)
            off = flat[going] - self.sorted[p, place]
            distance, index = (off * off).sum(axis=1), self.order[p, place]
            better = (distance < best[going]) | ((distance == best[going]) & (index < found[going]))
            best[going[better]], found[going[better]] = distance[better], index[better]
            low, high = low - down, high + ~down
        return found.reshape(rows, parts), best.reshape(rows, parts)

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usable(rows: DataFrame, vector: str, parts: int) -> tuple[DataFrame, int]:
    """Rows whose vector is not null and has finite components only, of the commonest of the lengths that ``parts`` divides (of
    several, the largest), and that length; 0 if there is none."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = rows.where(F.col(vector).isNotNull() & F.forall(vector, finite) & (F.size(vector) > 0) & (F.size(vector) % parts == 0))
    size = good.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return good.where(F.size(vector) == (size.n if size else 0)), size.n if size else 0


def whole_numbers(column: pa.Array, dimension: int, s: Settings) -> np.ndarray:
    """floor(scale * x) of the components, (rows, parts, width). Beyond 2**28 / width, where squared distances would no longer fit,
    they stay at that bound."""
    width = dimension // s.parts
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    bound = (1 << 28) // width
    return np.clip(np.floor(values * s.scale), -bound, bound).astype(np.int64).reshape(-1, s.parts, width)


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()) -> Codebooks | None:
    """The codebooks of the usable vectors, or None without any. The first are the vectors of the least ids (equal ids by vector, null
    ids last); entries that no part is nearest to stay."""
    s = settings
    some, dimension = usable(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")), "vector", s.parts)
    first = some.orderBy(F.asc_nulls_last("id"), "vector").limit(s.entries).select("vector").toArrow().column("vector").combine_chunks()
    if not len(first):
        return None
    books = Codebooks(whole_numbers(first, dimension, s).transpose(1, 0, 2).copy())
    width, m = dimension // s.parts, len(first)
    for _ in range(s.rounds):
        shared = vectors.sparkSession.sparkContext.broadcast(books)

        def run(batches, shared=shared):
            sums = np.zeros((width + 1, s.parts * m), dtype=np.int64)
            for whole in batches:
                for at in range(0, whole.num_rows, _ROWS):
                    values = whole_numbers(whole.column(0).slice(at, _ROWS), dimension, s)
                    slot = (shared.value.assign(values)[0] + np.arange(s.parts) * m).ravel()
                    flat = values.reshape(-1, width)
                    for c in range(width):  # sums of a batch are exact in doubles
                        sums[c] += np.bincount(slot, weights=flat[:, c], minlength=s.parts * m).astype(np.int64)
                    sums[width] += np.bincount(slot, minlength=s.parts * m)
            used = np.flatnonzero(np.tile(sums[width] > 0, width + 1))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums.ravel()[used])], ["slot", "total"])

        found = map_arrow(some.select("vector"), run, "slot int, total bigint").groupBy("slot").agg(F.sum("total").alias("total")).collect()
        sums = np.zeros((width + 1) * s.parts * m, dtype=np.int64)
        for row in found:
            sums[row.slot] = row.total
        sums = sums.reshape(width + 1, s.parts, m)
        count = sums[width][:, :, None]
        books = Codebooks(np.where(count > 0, sums[:width].transpose(1, 2, 0) // np.maximum(count, 1), books.entries))
    return books


_HEX = np.array([f"{i:02x}" for i in range(256)])


def encode(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", settings: Settings = Settings()) -> DataFrame:
    """(id, label, code, error) per usable row of ``vectors``: two hex digits a part, and the squared distances of all parts added up.

    Null ids and labels and repeated rows are kept; other columns are left out; an empty table gives no rows.
    """
    s = settings
    if books.entries.shape[1] > 256:
        raise ValueError("a code has a byte a part, so codebooks have 256 entries at most")
    dimension = books.entries.shape[0] * books.entries.shape[2]
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    some = usable(rows, "vector", s.parts)[0].where(F.size("vector") == dimension)
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                index, distance = shared.value.assign(whole_numbers(batch.column(2), dimension, s))
                codes = ["".join(row) for row in _HEX[index].tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(distance.sum(axis=1))], ["id", "label", "code", "error"])

    return map_arrow(some, run, f"id {sql_type(vectors, id_col)}, label {sql_type(vectors, label_col)}, code string, error bigint")


def decode(codes: DataFrame, books: Codebooks, code_col: str = "code", settings: Settings = Settings()) -> DataFrame:
    """``codes`` with vector: the entries that the codes stand for, at the vectors' own scale; null for a null code."""
    flat = [[(np.array(e) / settings.scale).tolist() for e in part] for part in books.entries.tolist()]
    entries = F.array(*[F.array(*[F.array(*map(F.lit, e)) for e in part]) for part in flat])
    one = lambda p: F.get(F.get(entries, p), F.conv(F.substring(F.col(code_col), 2 * p + 1, F.lit(2)), 16, 10).cast("int"))
    return codes.withColumn("vector", F.when(F.col(code_col).isNotNull(), F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(flat) - 1)), one))))


def with_group_sums(rows: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over their group, nulls being one group. Sums are formed before they move. Groups of more than a
    thousandth of all rows, so a thousand at most, are broadcast, the rest is joined by group: no task gets a large group."""
    sums = checkpointed(rows.groupBy(F.col(group).alias("_group")).agg(F.sum(value).alias(name), F.count("*").alias("_n")))
    total = sums.agg(F.sum("_n")).first()[0] or 0
    large, small = sums.where(F.col("_n") * 1000 > total), sums.where(F.col("_n") * 1000 <= total)
    same = F.col(group).eqNullSafe(F.col("_group"))
    inside = rows.join(F.broadcast(large), same)
    outside = rows.join(F.broadcast(large.select("_group")), same, "left_anti").join(small, same)
    return inside.unionByName(outside).drop("_group", "_n")


def op11_vector_codes(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    books = fit(vectors)
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = with_group_sums(checkpointed(encode(vectors, books)), "label", "error", "label_error")
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _sql() -> str:
    steps = ["""k AS MATERIALIZED (SELECT row_number() OVER () AS row_no, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))""",
        """p AS MATERIALIZED (SELECT row_no, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS x FROM k, range(16) t(part))""",
        """b0 AS MATERIALIZED (SELECT part, e, x AS c FROM p JOIN (SELECT row_no, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM k QUALIFY e < 64) USING (row_no))"""]  # fmt: skip
    for r in range(3):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT row_no, part, best.e AS e, best.d AS d FROM (SELECT row_no, p.part AS part, min(struct_pack(d := CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), e := e)) AS best FROM p JOIN b{r} ON p.part = b{r}.part GROUP BY ALL))""")
        if r < 2:
            steps.append(f"""b{r + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(n.c, b.c) AS c FROM b{r} b LEFT JOIN (SELECT part, e, list(m ORDER BY i) AS c FROM (SELECT part, e, i, CAST(floor(sum(y)::DOUBLE / count(*)) AS BIGINT) AS m FROM (SELECT part, e, unnest(x) AS y, unnest(range(len(x))) AS i FROM a{r} JOIN p USING (row_no, part)) GROUP BY ALL) GROUP BY ALL) n ON b.part = n.part AND b.e = n.e)""")
    steps.append("""f AS (SELECT row_no, string_agg(format('{:02x}', CAST(e AS BIGINT)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY row_no)""")
    return f"""WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) FROM b2) AS codebooks_sha256 FROM k JOIN f USING (row_no)"""


QUERIES = {"op11_vector_codes": op11_vector_codes}
ORACLE_SQL = {"op11_vector_codes": _sql()}
