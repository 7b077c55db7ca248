"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each padded to a 23-bit Golay word. Where two fingerprints
differ in at most three bits, at least two of the three segments differ in at most one bit each. Keys are therefore pairs of
segments: one fingerprint files itself under the nearest codeword indices of each pair, another asks under the probe indices
(see ``golay``), and they meet under at least one pair. The join then verifies the distance itself, so no link is lost and
none is invented.

Equal fingerprints are collapsed first. Crowded keys are contracted before the join: all fingerprints of a key are held
against its smallest one only, and the join asks only for fingerprints of other components, so a large group of near copies
yields links in proportion to its size and never all its pairs. Fingerprints and components that hold many rows are named by a
broadcast of bounded size, so their rows are not brought to one task.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormlane.llm import golay
from stormlane.llm.common import checkpointed, join_spread, map_arrow, sql_type, table
from stormlane.llm.components import connected_components

SHINGLE, SEED, MAX_DISTANCE = 3, 42, 3
WIDTHS = (22, 21, 21)
PAIRS = tuple(combinations(range(3), 2))
_BLOCK = 1 << 15


def shingle_hashes(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased (A-Z) text, repeats included, without holding all shingles at once."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype="<u8")
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(whole, seed)], dtype="<u8")
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    return np.fromiter((digest(whole[a : b - 1], seed) for a, b in zip(starts, starts[shingle:])), dtype="<u8", count=len(words) - shingle + 1)


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; 0 without hashes."""
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part = hashes[at : at + _BLOCK]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fingerprint as a signed 64-bit number) per row. A null or empty text has fingerprint zero; other columns are left out."""

    def run(batches):
        for batch in batches:
            prints = [majority_bits(shingle_hashes(t.as_py(), shingle, seed)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, dtype=np.uint64).view(np.int64))], ["id", "fingerprint"])

    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), run, f"id {sql_type(docs, id_col)}, fingerprint bigint")


def _segments(prints: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for width in WIDTHS:
        out.append((prints >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int32))
        at += width
    return out


def _keys(batches, probing: bool):
    """Rows (key, fingerprint): three per fingerprint when filing, up to 3 x 36 when probing."""
    for batch in batches:
        signed = batch.column(0).to_numpy(zero_copy_only=False)
        parts = _segments(signed.view(np.uint64))
        found = [golay.probes(p, w) for p, w in zip(parts, WIDTHS)] if probing else [golay.index(p)[:, None] for p in parts]
        for k, (a, b) in enumerate(PAIRS):
            left, right = found[a][:, :, None], found[b][:, None, :]
            keys = np.where((left >= 0) & (right >= 0), k << 24 | left << 12 | right, -1).reshape(len(signed), -1)
            row, col = np.nonzero(keys >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(keys[row, col].astype(np.int32)), pa.array(signed[row])], ["key", "fingerprint"])


def _keyed(prints: DataFrame, probing: bool) -> DataFrame:
    return map_arrow(prints.select("fingerprint"), lambda batches: _keys(batches, probing), "key int, fingerprint bigint")


def _near(a: str, b: str, distance: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def linked(prints: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(node, root) of all fingerprints that are linked, directly or not, at ``max_distance`` (at most 3) bits.

    prints: distinct values in column fingerprint, best checkpointed.
    """
    if not 0 <= max_distance <= 3:
        raise ValueError("the segment keys cover distances from 0 to 3")
    filed = _keyed(prints, False)
    hubs = filed.groupBy("key").agg(F.min("fingerprint").alias("hub"), F.max("fingerprint").alias("last")).where("hub <> last").drop("last")
    stars = filed.join(hubs, "key").where((F.col("fingerprint") != F.col("hub")) & _near("fingerprint", "hub", max_distance)).select(F.col("fingerprint").alias("u"), F.col("hub").alias("v"))
    first = connected_components(stars)
    known = checkpointed(prints.join(first.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root")))

    filed = _rooted(known, False)
    crowd = filed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.bit_and("fingerprint").alias("every"), F.bit_or("fingerprint").alias("some"))
    # Bits that all fingerprints of a key share and the asking one lacks, or the reverse, count for each of them.
    apart = F.bit_count(F.expr("fingerprint & ~some")) + F.bit_count(F.expr("~fingerprint & every"))
    worth = (F.col("asking.key") == F.col("crowd.key")) & F.expr("least <> root or most <> root") & (apart <= max_distance)
    asking = _rooted(known, True).alias("asking").join(crowd.alias("crowd"), worth).select(F.col("asking.key").alias("key"), F.col("fingerprint").alias("asking"), F.col("root").alias("own"))
    met = asking.join(filed, "key").where((F.col("own") != F.col("root")) & _near("asking", "fingerprint", max_distance))
    more = met.select(F.col("own").alias("u"), F.col("root").alias("v"))
    return connected_components(more.unionAll(first.select(F.col("node").alias("u"), F.col("root").alias("v"))))


def _rooted(known: DataFrame, probing: bool) -> DataFrame:
    """The keys of each fingerprint with the root of its component."""

    def run(batches):
        for batch in batches:
            order = np.argsort(prints := batch.column(0).to_numpy(zero_copy_only=False))
            roots = batch.column(1).to_numpy(zero_copy_only=False)
            for out in _keys([batch], probing):
                at = order[np.searchsorted(prints, out.column(1).to_numpy(), sorter=order)]
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(roots[at])], ["key", "fingerprint", "root"])

    return map_arrow(known.select("fingerprint", "root"), run, "key int, fingerprint bigint, root bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE, seed: int = SEED) -> DataFrame:
    """(id, fingerprint, component_id) per row of ``docs``.

    component_id is the smallest id that is reachable over links of at most ``max_distance`` differing bits, the row's own
    included. Null and empty texts share fingerprint zero and are linked like any other. Repeated rows each give a row; rows
    with a null id get the smallest id of their group that isn't null, or null. An empty table gives no rows. Other columns
    are left out.
    """
    return grouped(checkpointed(fingerprints(docs, id_col, text_col, shingle, seed)), max_distance)


def grouped(own: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(id, fingerprint, component_id) per row of (id, fingerprint), best checkpointed; component_id as in ``near_duplicates``."""
    firsts = checkpointed(own.groupBy("fingerprint").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    groups = linked(firsts.select("fingerprint"), max_distance).withColumnRenamed("node", "fingerprint")
    members = checkpointed(groups.join(firsts, "fingerprint"))
    least = checkpointed(members.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("n")))
    moved = join_spread(members.select("root", "fingerprint"), least, "root").select("fingerprint", "least")
    named = checkpointed(firsts.join(moved, "fingerprint", "left").select("fingerprint", F.coalesce("least", "first").alias("component_id"), "n"))
    return join_spread(own, named, "fingerprint").select("id", "fingerprint", "component_id")


def op4_simhash_near_dedup(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash_near_dedup": op4_simhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}
