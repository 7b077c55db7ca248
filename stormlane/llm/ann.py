"""Approximate nearest neighbours by cosine with a forest of hash prefixes.

Each tree gives every vector a long string of bits, the sides of random hyperplanes. A tree is the sorted array of these strings,
dealt out by prefix into cells of at most ``block_rows`` rows: where a prefix has more, longer ones divide it, until strings end. A
row is in one cell of each tree, so it is copied ``trees`` times, however many rows and queries there are.

A query descends, in every tree, to its own cell and there by binary search to the rows with the longest prefix in common with it,
and takes shorter and shorter prefixes until ``least`` rows match. These candidates give the query a first k-th best cosine. A
nearer vector agrees with it in each bit with a known probability, so how long a prefix may be before such a vector matches in none
of the trees more often than ``1 - recall`` follows from that cosine: the query ascends to this length in all trees at once, and all
rows that match it there are its candidates. Where its own cell covers the length, nothing else is asked; where the length is
shorter than the cell's prefix, the query goes to the other cells below it. Near neighbours thus end in a few short slices, and only
queries without any near neighbour see much of the table. Candidates are ranked by their exact cosine in double precision.

Queries stream past the rows of a cell, which alone are held, so a cell may have any number of them. Only a group of rows whose
strings are equal to the last bit is divided in another way, by hash, and its queries go to each part.

A bounded sample (``sample_rows`` rows) gives the centre that vectors are held against before their bits are taken.

Equal vectors are collapsed first: no more of them than a result can hold, and one, matter. That is exact.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormlane.llm.common import checkpointed, map_arrow, table
from stormlane.operators.align import sized


@dataclass(frozen=True)
class Settings:
    trees: int = 16
    bits: int = 48
    block_rows: int = 8192
    #: Queries of one slice that are scored together.
    query_rows: int = 512
    least: int = 256
    sample_rows: int = 8192
    recall: float = 0.92
    seed: int = 7


#: Bits by which cells of too many rows are divided at a time.
_STEP = 4
#: Slack by which scores from a matrix product may differ from those that are returned.
_SLACK = 1e-9


def planes(dimension: int, settings: Settings) -> np.ndarray:
    return np.random.default_rng(settings.seed).standard_normal((dimension, settings.trees * settings.bits))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, its largest component between 1/2 and 1: the same cosines without overflow."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, initial=0.0))[1][:, None])


def strings(vectors: np.ndarray, sides: np.ndarray, centre: np.ndarray, settings: Settings) -> np.ndarray:
    """The bit string of each (scaled) vector in each tree, the first bit highest: (rows, trees)."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True) - centre
    weights = np.int64(1) << np.arange(settings.bits - 1, -1, -1, dtype=np.int64)
    out = np.empty((len(vectors), settings.trees), dtype=np.int64)
    for at in range(0, len(vectors), 1024):
        part = unit[at : at + 1024] @ sides > 0
        out[at : at + 1024] = (part.reshape(-1, settings.trees, settings.bits) * weights).sum(axis=2)
    return out


def match_lengths(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Length of the common prefix of bit strings."""
    return bits - np.frexp((a ^ b).astype(np.float64))[1]


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Of scaled vectors with a scaled one."""
    return (vectors * query).sum(axis=1) / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))


def level_needed(cosine: Column, spread: Column, settings: Settings) -> Column:
    """The longest prefix at which a vector with this cosine to the query matches in some tree with probability ``recall``.

    ``spread`` is the squared length of the query's unit vector less the centre; the other one's is taken to be alike.
    """
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - (1 - cosine) / F.greatest(spread, F.lit(1e-12))))) / math.pi
    agree = F.greatest(1 - apart, F.lit(1e-12))
    enough = math.log(1 - (1 - settings.recall) ** (1 / settings.trees))
    return F.when(agree >= 1, settings.bits).otherwise(F.least(F.lit(settings.bits), F.floor(F.lit(enough) / F.ln(agree)))).cast("int")


class Cell:
    """A sorted array of a tree's strings and the vectors behind them."""

    def __init__(self, found: np.ndarray, vectors: np.ndarray, first: np.ndarray):
        self.order = np.lexsort((first, found))
        self.sorted, self.first = found[self.order], first[self.order]
        self.vectors = vectors[self.order]
        self.unit = self.vectors / np.linalg.norm(self.vectors, axis=1, keepdims=True)

    def slices(self, queries: np.ndarray, shifts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the rows stand that match each query in all but its last ``shifts`` bits."""
        low = queries >> shifts << shifts
        return np.searchsorted(self.sorted, low), np.searchsorted(self.sorted, low + (np.int64(1) << shifts))

    def descend(self, queries: np.ndarray, bits: int, depth: int, least: int) -> np.ndarray:
        """The bits each query leaves out: none of its longest match, then more while fewer than ``least`` rows match, up to all
        behind the cell's own ``depth``."""
        place = np.searchsorted(self.sorted, queries)
        near = [match_lengths(self.sorted[np.clip(place + k, 0, len(self.sorted) - 1)], queries, bits) for k in (-1, 0)]
        shifts, last = bits - np.maximum(*near), bits - depth
        while True:
            start, end = self.slices(queries, shifts)
            few = (end - start < least) & (shifts < last)
            if not few.any():
                return shifts
            shifts = np.where(few, shifts + 1, shifts)

    def nearest(self, queries: np.ndarray, wanted: np.ndarray, shifts: np.ndarray, bounds: np.ndarray, most: int, together: int):
        """Per query its number, the places of its ``most`` nearest among the rows that match it in all but the last ``shifts``
        bits and have a cosine of ``bounds`` or more, and their scores. Queries with one slice are held against it together."""
        start, end = self.slices(queries, shifts)
        order = np.lexsort((end, start))
        groups = np.flatnonzero((np.diff(start[order], prepend=-1) != 0) | (np.diff(end[order], prepend=-1) != 0))
        for members in np.split(order, groups[1:]) if len(order) else []:
            a, b = start[members[0]], end[members[0]]
            for at in range(0, len(members) if b > a else 0, together):
                some = members[at : at + together]
                about = (wanted[some] / np.linalg.norm(wanted[some], axis=1, keepdims=True)) @ self.unit[a:b].T
                best = np.partition(about, -most, axis=1)[:, -most] if about.shape[1] > most else np.full(len(some), -2.0)
                for q, row, bound in zip(some.tolist(), about, np.maximum(best, bounds[some])):
                    places = a + np.flatnonzero(row >= bound - _SLACK)
                    score = cosines(self.vectors[places], wanted[q])
                    top = np.lexsort((self.first[places], -score))[:most]
                    yield q, places[top], score[top]


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows with an id whose vector is neither null nor zero nor has a null or non-finite component, of the commonest dimension
    (of several, the largest)."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.col("id").isNotNull() & F.col(vector).isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0))
    size = rows.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size(vector) == (size.n if size else 0))


def _matrix(column: pa.ChunkedArray | pa.Array, kind: str, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, dimension).astype(np.float64)


_PLACE = ("tree", "depth", "cell", "part")


class _Forest:
    """The rows of an index, (key, first, vector as bytes, strings), dealt into cells, and searches in it."""

    def __init__(self, index: DataFrame, rows: int, kind: str, dimension: int, settings: Settings):
        self.index, self.kind, self.dimension, self.settings = index, kind, dimension, settings
        self.route = max(0, (rows - 1) // settings.block_rows).bit_length()
        depths = sized(checkpointed(self._depths()))
        cell = F.expr(f"shiftright(string, {settings.bits} - depth)")
        self.places = lambda df: self._filed(df).join(depths, ["tree", "base"]).withColumn("cell", cell).drop("base")
        self.cells = checkpointed(self.places(index).groupBy("tree", "depth", "cell").agg(F.ceil(F.count("*") / settings.block_rows).cast("int").alias("parts")))
        divided = self.cells.where("parts > 1")
        self.divided = None if divided.isEmpty() else sized(divided)

    def _filed(self, df: DataFrame) -> DataFrame:
        whole = df.select("key", F.posexplode("strings").alias("tree", "string"))
        return whole.withColumn("base", F.shiftright("string", self.settings.bits - self.route))

    def _depths(self) -> DataFrame:
        """(tree, base, depth): by how many bits the rows of each prefix of ``route`` bits are divided into cells."""
        s, depth = self.settings, self.route
        filed = self._filed(self.index)
        counts = checkpointed(filed.groupBy("tree", "base").agg(F.count("*").alias("n")))
        full = F.col("n") > s.block_rows
        settled, open_ = counts.where(~full).select("tree", "base", F.lit(depth).alias("depth")), counts.where(full).select("tree", "base")
        while depth < s.bits and not open_.isEmpty():
            depth = min(s.bits, depth + _STEP)
            below = filed.join(sized(open_), ["tree", "base"]).groupBy("tree", "base", F.shiftright("string", s.bits - depth)).agg(F.count("*").alias("n"))
            counts = checkpointed(below.groupBy("tree", "base").agg(F.max("n").alias("n")))
            done = counts.where(~full | F.lit(depth == s.bits)).select("tree", "base", F.lit(depth).alias("depth"))
            settled, open_ = settled.unionAll(done), counts.where(full & F.lit(depth < s.bits)).select("tree", "base")
        return settled

    def _in_parts(self, df: DataFrame, part: Column) -> DataFrame:
        """Adds the part of a divided cell; 0 in all others."""
        if self.divided is None:
            return df.withColumn("part", F.lit(0))
        return df.join(self.divided, ["tree", "depth", "cell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", part).drop("parts")

    def search(self, asked: DataFrame, most: int, descending: bool) -> DataFrame:
        """(query, key, first, score, matched) for the keys ``asked`` (key, level, bound): the ``most`` nearest rows of each cell
        that match in ``level`` bits and have a cosine of ``bound`` or more; where ``descending``, those with the longest match in
        the query's own cell, whatever the level."""
        s, kind, dimension = self.settings, self.kind, self.dimension
        own = self.places(self.index.join(asked.select("key"), "key", "left_semi")).join(asked, "key")
        if descending:
            visits = own
        else:
            below = self.cells.drop("parts").withColumn("level", F.explode(F.sequence(F.lit(0), F.col("depth")))).withColumn("above", F.expr("shiftright(cell, depth - level)"))
            starts = own.drop("cell").withColumn("wanted_level", F.col("level")).withColumn("level", F.least("level", "depth")).withColumn("above", F.expr(f"shiftright(string, {s.bits} - level)"))
            visits = starts.drop("depth").join(below, ["tree", "level", "above"]).drop("above", "level").withColumnRenamed("wanted_level", "level")
        sent = self._in_parts(visits, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        kept = self._in_parts(self.places(self.index), F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
        vectors = self.index.select("key", "first", "vector")
        left = kept.join(vectors, "key").select(*_PLACE, F.lit(0).alias("asks"), "key", "first", "string", "vector", F.lit(0).alias("level"), F.lit(0.0).alias("bound"))
        right = sent.join(vectors, "key").select(*_PLACE, F.lit(1).alias("asks"), "key", "first", "string", "vector", "level", "bound")
        dealt = left.unionByName(right).repartition(*_PLACE).sortWithinPartitions(*_PLACE, "asks")

        def run(batches):
            held, cell, at = [], None, None
            for batch in batches:
                marks = np.stack([batch.column(i).to_numpy() for i in range(5)], axis=1)
                starts = np.flatnonzero((np.diff(marks, axis=0, prepend=marks[:1] - 1) != 0).any(axis=1)) if batch.num_rows else []
                for first, end in zip(starts, [*starts[1:], batch.num_rows]):
                    place, part = tuple(marks[first, :4].tolist()), batch.slice(first, end - first)
                    if place != at:
                        held, cell, at = [], None, place
                    if not marks[first, 4]:
                        held.append(part.select(["key", "first", "string", "vector"]))
                        continue
                    if cell is None:  # rows come before queries
                        rows = pa.Table.from_batches(held)
                        cell = Cell(rows.column("string").to_numpy(), _matrix(rows.column("vector"), kind, dimension), rows.column("first").to_numpy())
                        keys, held = np.array(rows.column("key").to_pylist(), dtype=object)[cell.order], []
                    asking, names = part.column("string").to_numpy(), part.column("key").to_pylist()
                    shifts = cell.descend(asking, s.bits, place[1], s.least) if descending else s.bits - np.maximum(part.column("level").to_numpy().astype(np.int64), 0)
                    out: list[list] = [[], [], [], [], []]
                    for q, places, score in cell.nearest(asking, _matrix(part.column("vector"), kind, dimension), shifts, part.column("bound").to_numpy(), most, s.query_rows):
                        for column, values in zip(out, ([names[q]] * len(places), keys[places].tolist(), cell.first[places].tolist(), score.tolist(), [s.bits - int(shifts[q])] * len(places))):
                            column += values
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int32()))], ["query", "key", "first", "score", "matched"])

        return map_arrow(dealt, run, "query string, key string, first bigint, score double, matched int")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows found for each row of ``vectors`` for which ``is_query`` (over ``id``) holds.

    A query's own row is no candidate, equal vectors under other ids are; ties go to the smaller id; with fewer candidates
    than k all are returned. Vectors that ``usable`` refuses take no part; others count at any scale, however large or small
    their components. Repeats of an id with the same vector count once; an id with several vectors takes part with each, its
    own ids excluded. Other columns are left out; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    s = settings
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0)).alias("vector"))
    rows = usable(rows, "vector").withColumn("key", F.concat(F.hex(F.xxhash64("vector")), F.hex(F.xxhash64(F.lit(k), "vector"))))
    few = Window.partitionBy("key").orderBy("id")
    copies = rows.withColumn("place", F.dense_rank().over(few)).where(F.col("place") <= k + 1).select("key", "id", "vector").groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.any_value("vector").alias("vector"))
    copies = checkpointed(copies)
    queries = checkpointed(rows.where(is_query).select("id", "key").distinct())

    head = copies.orderBy(F.xxhash64("key"), "key").limit(settings.sample_rows).select("vector").toArrow()
    dimension = len(head.column("vector")[0]) if head.num_rows else 1
    sample = scaled(head.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension) if head.num_rows else np.empty((0, dimension)))
    sides = planes(dimension, settings)
    centre = (sample / np.linalg.norm(sample, axis=1, keepdims=True)).mean(axis=0) if len(sample) else np.zeros(dimension)
    shared = spark.sparkContext.broadcast((sides, centre))

    def indexed(batches):
        sides, centre = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                found = scaled(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension))
                bits = pa.FixedSizeListArray.from_arrays(pa.array(strings(found, sides, centre, s).ravel()), s.trees).cast(pa.list_(pa.int64()))
                off = found / np.linalg.norm(found, axis=1, keepdims=True) - centre
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.tobytes() for v in found.astype(kind)], pa.binary()), bits, pa.array((off * off).sum(axis=1))], ["key", "first", "vector", "strings", "spread"])

    index = checkpointed(map_arrow(copies.select("key", F.col("ids")[0].alias("first"), "vector"), indexed, "key string, first bigint, vector binary, strings array<bigint>, spread double"))
    forest = _Forest(index, index.count(), kind, dimension, s)
    spreads = index.select("key", "spread")
    asked = checkpointed(queries.select("key").distinct().select("key", F.lit(s.bits + 1).alias("level"), F.lit(-2.0).alias("bound")))
    found, descending = None, True
    while not asked.isEmpty():
        met = checkpointed(forest.search(asked, k + 1, descending))
        found = met if found is None else found.unionAll(met)
        # A query's level so far: in its own cells the longest of what was matched there.
        so_far = met.groupBy(F.col("query").alias("key")).agg(F.max("matched").alias("matched"))
        others = found.where("query <> key").groupBy("query", "key").agg(F.max("score").alias("score"))
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
        bounds = others.withColumn("place", place).where(F.col("place") == k).select(F.col("query").alias("key"), F.col("score").alias("bound"))
        known = asked.select("key", "level").join(so_far, "key").join(bounds, "key", "left").join(spreads, "key")
        # Without k neighbours yet, half of the prefix is left out.
        need = F.when(F.col("bound").isNotNull(), level_needed(F.col("bound"), F.col("spread"), s)).otherwise(F.floor(F.least(F.col("matched"), F.lit(forest.route)) / 2).cast("int"))
        asked = checkpointed(known.select("key", need.alias("level"), F.coalesce("bound", F.lit(-2.0)).alias("bound"), "matched").where("level < matched").drop("matched"))
        descending = False

    top = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    if found is None:
        return queries.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), "id", F.lit(0.0).alias("score")).limit(0)
    whole = found.drop("matched").dropDuplicates(["query", "key"]).withColumnRenamed("first", "id").withColumn("place", F.row_number().over(top("query"))).where(F.col("place") <= k + 1)
    named = whole.select("query", "key", "score").join(copies.select("key", "ids"), "key").select("query", "score", F.explode("ids").alias("id"))
    named = named.withColumn("place", F.row_number().over(top("query"))).where(F.col("place") <= k + 1).select(F.col("query").alias("key"), "score", F.col("id").alias("id"))
    pairs = named.join(queries.select("key", F.col("id").alias("query_id")), "key").where("id <> query_id").select("query_id", "id", "score").distinct()
    return pairs.withColumn("rank", F.row_number().over(top("query_id"))).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op8_approximate_nearest_neighbours(spark, sf_dir):
    found = nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


QUERIES = {"op8_approximate_nearest_neighbours": op8_approximate_nearest_neighbours}
ORACLE_SQL: dict[str, str] = {}
