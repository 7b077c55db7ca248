"""Near-duplicate texts by the Jaccard similarity of their sets of word shingles, found without a miss.

First comes operator 4's method: a 64-bit SimHash of each set, linked at three or fewer differing bits by Golay keys
(``simhash``). Each text of a component is compared with its smallest one, set against set, and what is linked is contracted.
At a similarity of 0.8 fingerprints differ in more bits than that, so the rest is found in an exact way, by a prefix filter:

With all shingles in one order, two sets of similarity t or more have their first common shingle among the
first n - ceil(t * n) + 1 of either, n being the set's size. Texts therefore meet under the shingles of these prefixes only,
and where a shingle stands in both sets bounds what they can share. Any order finds every pair; common shingles go last, so
prefixes rarely hold them. How common a shingle is is counted on a part of the texts, which decides about the order alone.

Texts that are equal but for case (A-Z) and white space are collapsed first. Of each key's texts the most central one, whose
prefix meets the most texts, is compared with the others, then the most central one of those that are not linked to it; what
is linked is contracted. Only texts of different groups that still meet are compared with each other, so no group's pairs are
all made. A pair passes a 512-bit parity sketch first, which bounds from below how many shingles two sets differ in, so it
refuses no similar pair; every link comes from a comparison of the sets themselves.

The checkpointed tables are: one row a document (id, hashes, prefix: about a third of its text), the shared keys, the nodes
under them, their fingerprints' keys, and the pairs. Texts under no shared key can have no similar one and go no further. Whole texts move only for pairs that the sketch lets pass.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormlane.llm import simhash
from stormlane.llm.common import checkpointed, map_arrow, sql_type
from stormlane.llm.components import connected_components

SHINGLE, SIMILARITY = 5, 0.8
#: Rows of decided copies, or of texts to compare, up to which they are broadcast against the documents; beyond, both sides
#: are shuffled. The result is the same.
BROADCAST_ROWS = 1_000_000
#: Common shingles: counted on one text in COUNTED, from COMMON texts on, the most frequent ones. They shape the order only.
COUNTED, COMMON, COMMON_KEPT = 8, 2, 500_000
SKETCH_BITS = 512
#: Slack of the bounds, so that rounding never loses a pair.
_SLACK = 1e-6
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_MEMO_WORDS, _MEMO_LENGTH = 150_000, 64


class _WordHashes(dict):
    """Hashes of words; it starts anew when full, so its size is bounded."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= _MEMO_LENGTH:
            if len(self) >= _MEMO_WORDS:
                self.clear()
            self[word] = value
        return value


_WORDS = _WordHashes()


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def _shingles(words: list[bytes], shingle: int) -> np.ndarray:
    """The distinct shingles as signed 64-bit numbers, ascending; of fewer words than a shingle, all of them together are one."""
    hashes = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(shingle, len(words))
    total = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total = total * _FACTOR + hashes[k : k + len(total)]
    total = (total ^ (total >> np.uint64(32))) * _MIX
    return np.unique((total ^ (total >> np.uint64(29))).view(np.int64))


def _hashes(text: str, shingle: int) -> np.ndarray:
    """The distinct shingles of a text with at least one word."""
    return _shingles(_words(text), shingle)


def _common(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles, ascending, and their counts."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                if found := [_shingles(w, shingle) for t in batch.column(0).slice(at, 200) if (w := _words(t.as_py()))]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["key"])
        _WORDS.clear()

    some = map_arrow(texts.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("id", "text"), F.lit(COUNTED)) == 0)).select("text"), run, "key bigint")
    found = some.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "key").limit(COMMON_KEPT).toArrow()
    keys, counts = (found.column(k).to_numpy() for k in (0, 1))
    order = np.argsort(keys)
    return keys[order], counts[order]


def prefix(hashes: np.ndarray, similarity: float, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the common order: uncommon ones by hash, then common ones by count."""
    at = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
    rank = np.where(keys[at] == hashes, counts[at], 0) if len(keys) else np.zeros(len(hashes), dtype=np.int64)
    most = len(hashes) - math.ceil(similarity * len(hashes) - _SLACK) + 1
    return hashes[np.lexsort((hashes, rank))[:most]]


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Per bucket whether an odd number of the shingles fall in it, as eight 64-bit numbers: where two sketches differ in d
    bits the sets differ in d shingles or more."""
    odd = np.bincount(hashes & (SKETCH_BITS - 1), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _described(rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(id, mark, node, size, fingerprint, sketch, prefix) of each row of (id, text) whose text has words; node is a 128-bit digest
    of the words, mark a 64-bit hash of the text as it is, by which, with the id, the row is found again."""
    shared = rows.sparkSession.sparkContext.broadcast(_common(rows, shingle))
    names = ["id", "mark", "node", "size", "fingerprint", "sketch", "prefix"]

    def run(batches):
        keys, counts = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch, kept, nodes, sizes, prints, sketches, found = whole.slice(at, 500), [], [], [], [], [], []
                for number, text in enumerate(batch.column(2)):
                    words = _words(text.as_py())
                    if words:
                        hashes = _shingles(words, shingle)
                        kept.append(number)
                        nodes.append(hashlib.md5(b" ".join(words), usedforsecurity=False).digest())
                        sizes.append(len(hashes))
                        prints.append(simhash.majority_bits(hashes))
                        sketches.append(sketch(hashes))
                        found.append(prefix(hashes, similarity, keys, counts))
                if kept:
                    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                    bits = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * (SKETCH_BITS // 64)), pa.array(np.concatenate(sketches)))
                    own = batch.take(pa.array(kept))
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), bits, lists], names)
        _WORDS.clear()

    schema = f"id {sql_type(rows, 'id')}, mark bigint, node binary, size int, fingerprint bigint, sketch array<bigint>, prefix array<bigint>"
    return map_arrow(rows.where("text is not null").select("id", F.xxhash64("text").alias("mark"), "text"), run, schema)


def _enough(similarity: float, a: str, b: str) -> Column:
    """Whether sets of these sizes can be similar enough if the key is their first common shingle and so much follows it."""
    small, large, rest = F.least(f"{a}_size", f"{b}_size"), F.greatest(f"{a}_size", f"{b}_size"), F.least(f"{a}_rest", f"{b}_rest")
    return (small + _SLACK >= similarity * large) & ((1 + similarity) * (1 + rest) + _SLACK >= similarity * (small + large))


def _sized(df: DataFrame) -> DataFrame:
    """Broadcast if it has at most BROADCAST_ROWS rows of fixed width."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _found_again(rows: DataFrame, wanted: DataFrame) -> Column:
    return rows["id"].eqNullSafe(wanted["wanted_id"]) & (rows["mark"] == wanted["wanted_mark"])


class _Comparison:
    """Holds pairs (u, v) of nodes against each other: sketches first, then the sets of the texts."""

    def __init__(self, rows: DataFrame, nodes: DataFrame, shingle: int, similarity: float):
        """rows: (id, mark, text); nodes: (node, size, sketch, first), ``first`` being the struct (no_id, id, mark) of a row with that text."""
        self.rows, self.nodes, self.shingle, self.similarity = rows, nodes, shingle, similarity

    def _possible(self, pairs: DataFrame) -> DataFrame:
        one, two = (self.nodes.select(F.col("node").alias(s), F.col("size").alias(f"{s}_size"), F.col("sketch").alias(f"{s}_sketch")) for s in "uv")
        apart = F.aggregate(F.zip_with("u_sketch", "v_sketch", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
        most = (1 - self.similarity) / (1 + self.similarity) * (F.col("u_size") + F.col("v_size")) + _SLACK
        return checkpointed(pairs.join(one, "u").join(two, "v").where(apart <= most).select("u", "v"))

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sets are similar enough, checkpointed."""
        pairs, shingle, similarity = self._possible(pairs), self.shingle, self.similarity
        ends = pairs.select(F.col("u").alias("node")).unionAll(pairs.select(F.col("v").alias("node"))).distinct()
        wanted = checkpointed(self.nodes.join(ends, "node", "left_semi").select("node", F.col("first.id").alias("wanted_id"), F.col("first.mark").alias("wanted_mark")))
        near = _sized(wanted)
        bodies = checkpointed(self.rows.join(near, _found_again(self.rows, near)).groupBy("node").agg(F.any_value("text").alias("text")))
        both = pairs.join(bodies.select(F.col("node").alias("u"), F.col("text").alias("one")), "u").join(bodies.select(F.col("node").alias("v"), F.col("text").alias("two")), "v")

        def run(batches):
            for whole in batches:
                for at in range(0, whole.num_rows, 200):
                    batch, good = whole.slice(at, 200), []
                    for one, two in zip(batch.column(2), batch.column(3)):
                        x, y = (_hashes(t.as_py(), shingle) for t in (one, two))
                        shared = len(np.intersect1d(x, y, assume_unique=True))
                        good.append(shared >= similarity * (len(x) + len(y) - shared))
                    yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))
            _WORDS.clear()

        return checkpointed(map_arrow(both.select("u", "v", "one", "two"), run, "u binary, v binary"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs of texts whose fingerprints are linked, directly or not: each text and the smallest one of its component."""
    found = simhash.grouped(nodes.select(F.col("node").alias("id"), "fingerprint"))
    return _ordered(found.where(F.col("id") != F.col("component_id")).select(F.col("id").alias("u"), F.col("component_id").alias("v")))


def _stars(rooted: DataFrame, centres: DataFrame, similarity: float) -> DataFrame:
    """Pairs of each key's centre (struct ``hub``) and its texts of other groups."""
    met = rooted.select("key", F.col("node").alias("u"), F.col("root").alias("u_root"), F.col("size").alias("u_size"), F.col("rest").alias("u_rest"))
    hubs = centres.select("key", F.col("hub.node").alias("v"), F.col("hub.root").alias("v_root"), F.col("hub.size").alias("v_size"), F.col("hub.rest").alias("v_rest"))
    return _ordered(met.join(hubs, "key").where((F.col("u_root") != F.col("v_root")) & _enough(similarity, "u", "v")))


def _centres(rooted: DataFrame) -> DataFrame:
    return rooted.groupBy("key").agg(F.max(F.struct("score", "node", "root", "size", "rest")).alias("hub"))


def _rooted(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of the keys that hold several groups, with their groups' roots."""
    rooted = shared.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
    return checkpointed(rooted.join(mixed, "key", "left_semi"))


def _meetings(rooted: DataFrame, similarity: float) -> DataFrame:
    """Pairs of texts of different groups that can be similar by where they meet: groups first, then text by text."""
    crowd = rooted.groupBy("key", "root").agg(F.count("*").alias("n"), F.min("size").alias("low"), F.max("size").alias("high"), F.max("rest").alias("rest"))
    one, two = (crowd.select("key", *(F.col(c).alias(f"{side}_{c}") for c in ("root", "n", "low", "high", "rest"))) for side in "uv")
    close = (F.col("u_n") < F.col("v_n")) | ((F.col("u_n") == F.col("v_n")) & (F.col("u_root") < F.col("v_root")))  # the smaller group asks
    close &= (F.col("u_high") + _SLACK >= similarity * F.col("v_low")) & (F.col("v_high") + _SLACK >= similarity * F.col("u_low"))
    close &= (1 + similarity) * (1 + F.least("u_rest", "v_rest")) + _SLACK >= similarity * (F.col("u_low") + F.col("v_low"))
    met = one.join(two, "key").where(close).select("key", "u_root", "v_root")
    u, v = (rooted.select("key", F.col("node").alias(side), F.col("root").alias(f"{side}_root"), F.col("size").alias(f"{side}_size"), F.col("rest").alias(f"{side}_rest")) for side in "uv")
    return _ordered(met.join(u, ["key", "u_root"]).join(v, ["key", "v_root"]).where(_enough(similarity, "u", "v")))


def _stars_and(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Links whose components hold the known ones and what new links join to them."""
    return links.unionAll(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))


def _linked(rows: DataFrame, described: DataFrame, firsts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, root) of the nodes that are linked, directly or not, to another one.

    rows: (id, mark, text); firsts: (node, first) with the row that stands for each node.
    """
    texts = described.select("node", "size", "prefix").dropDuplicates(["node"])
    keyed = texts.select("node", "size", F.posexplode("prefix").alias("pos", "key")).select("key", "node", "size", (F.col("size") - F.col("pos") - 1).alias("rest"))
    # Counting a column that the other side needs too lets Spark deal out the texts once for both sides.
    shared = checkpointed(keyed.join(keyed.groupBy("key").agg(F.count("size").alias("n")).where("n > 1"), "key"))
    # How many texts a text meets, over its prefix: the middle of a group meets most.
    scores = shared.groupBy("node").agg((F.sum(F.log("n")) / F.first("size")).alias("score"))
    nodes = checkpointed(described.select("node", "size", "fingerprint", "sketch").dropDuplicates(["node"]).join(scores, "node").join(firsts, "node"))
    compare = _Comparison(rows, nodes, shingle, similarity)
    tried = checkpointed(_by_fingerprint(nodes))
    links = compare.links(tried)
    roots = connected_components(links)
    scored = nodes.select("node", "score").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = checkpointed(shared.select("key", "node", "size", "rest", "n").join(scored, "node"))

    again = checkpointed(_stars(rooted, _centres(rooted), similarity).join(tried, ["u", "v"], "left_anti"))
    tried, roots = tried.unionAll(again), connected_components(_stars_and(roots, compare.links(again)))
    rooted = _rooted(rooted.where("n > 2").drop("n"), roots)  # a key's only pair has been compared
    # Of what is not linked to a key's centre, the centre in turn.
    others = rooted.join(_centres(rooted).select("key", F.col("hub.root").alias("main")), "key").where("root <> main")
    again = checkpointed(_stars(rooted, _centres(others), similarity).join(tried, ["u", "v"], "left_anti"))
    tried, more = tried.unionAll(again), compare.links(again)
    if not more.isEmpty():
        roots = connected_components(_stars_and(roots, more))
        rooted = _rooted(rooted, roots)
    # Pairs that were compared already and are still apart have no link.
    rest = compare.links(checkpointed(_meetings(rooted, similarity).join(tried, ["u", "v"], "left_anti")))
    return roots if rest.isEmpty() else connected_components(_stars_and(roots, rest))


def _one_row_each(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Of the rows of each key the one with the least hash of all its columns (maps, which have none, apart)."""
    hashed = F.xxhash64(*[F.col(c) for c in columns if not rows.schema[c].dataType.simpleString().startswith("map")])
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), hashed).alias("row")).select("row.*")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without copies: of each group of linked texts the row with the smallest id stays, a null id counting as largest.

    Texts are linked if equal but for A-Z case and white space, or if their sets of ``shingle``-word shingles have a Jaccard
    similarity of ``similarity`` or more. Texts without words, nulls included, are nobody's copies and stay, all of them. Of
    rows with one id and text one stays, whichever has the least hash of all columns. Columns stay as they are, whatever their names; an empty table gives no rows.
    """
    mark = "_mark"
    while mark.lower() in {c.lower() for c in docs.columns}:
        mark += "_"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    described = checkpointed(_described(rows, shingle, similarity))
    own = F.struct(F.col("id").isNull().alias("no_id"), "id", "mark")
    owned = checkpointed(described.groupBy("node", "id", "mark").agg(F.count("*").alias("n")))
    firsts = owned.groupBy("node").agg(F.min(own).alias("first"))
    linked = _linked(rows.withColumn("mark", F.xxhash64("text")), described, firsts, shingle, similarity)
    grouped = owned.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    winners = grouped.groupBy("root").agg(F.min(own).alias("first"), F.count("*").alias("rows")).where("rows > 1").select("root", "first")
    gone = checkpointed(grouped.join(winners, "root").where(own != F.col("first")).select(F.col("id").alias("gone_id"), F.col("mark").alias("gone_mark")))
    repeated = checkpointed(owned.where("n > 1").select(F.col("id").alias("gone_id"), F.col("mark").alias("gone_mark")))
    marked = docs.withColumn(mark, F.xxhash64(F.col(text_col).cast("string")))
    same = (F.col(mark) == F.col("gone_mark")) & F.col(id_col).eqNullSafe(F.col("gone_id"))
    kept = marked.join(_sized(gone), same, "left_anti")
    if repeated.isEmpty():
        return kept.drop(mark)
    repeats = _sized(repeated)
    return kept.join(repeats, same, "left_anti").drop(mark).unionByName(_one_row_each(kept.join(repeats, same, "left_semi"), [mark, id_col], docs.columns))
