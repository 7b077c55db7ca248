"""Token-id output packed into rows of fixed length by best fit decreasing.

Whole texts are encoded and end in an end-of-text id. Texts longer than a row are cut into full rows and a rest, without loss.
Within a pack group the pieces are placed longest first, each into the open row with the least room that still holds it; a
segment tree over the amounts of room finds it in logarithmic time. Rows are written as id matrices (one binary value of
little-endian uint32 per row, padded), cumulative segment lengths, and positions that start again at every segment.

Texts are dealt into pack groups by a hash of id, text and, for repeated rows, which repeat it is: a function of the rows alone,
so a group that is computed again after a lost executor has the same rows. A group is about ``group_chars`` characters whatever
the table's size or skew, and each group is packed by one task; what packing apart costs is about one open row per group. A
text longer than that is in one group whole, so its task holds that text's ids, four bytes each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormlane.llm.common import checkpointed, map_arrow, sql_type, table
from stormlane.llm.token_lengths import encoder, public_ranks, shared_ranks, well_formed

ROW_TOKENS, GROUP_CHARS, END_ID = 2048, 4_000_000, 50256
#: Ids of repeated rows up to which they are broadcast against the documents; beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000


class RoomTree:
    """Open rows by their room. Leaf r counts the rows with room r; an inner node counts those below it."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of an open row with the least room of at least ``need``, which is taken out; None if there is none."""
        node = need + self.size
        if not self.count[node]:
            while node and (node & 1 or not self.count[node + 1]):  # up until a right sibling has rows
                node >>= 1
            if not node:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.size
        self._change(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """The numbers of the pieces in each row, in the order in which they were placed; equal lengths keep their order."""
    tree, out = RoomTree(capacity), []
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[piece]
        if not 0 < need <= capacity:
            raise ValueError("a piece must have between 1 and capacity tokens")
        room, row = tree.take(need) or (capacity, len(out))
        if row == len(out):
            out.append([])
        out[row].append(piece)
        if room > need:
            tree.add(room - need, row)
    return out


def pieces_of(length: int, capacity: int) -> list[tuple[int, int]]:
    return [(at, min(at + capacity, length)) for at in range(0, length, capacity)]


SCHEMA = "pack_group int, row int, n_tokens int, n_segments int, ids binary, cu_seqlens array<int>, position_ids binary, segments array<struct<id:{id},start:int,end:int>>"


def pack(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", row_tokens: int = ROW_TOKENS, group_chars: int = GROUP_CHARS, end_id: int = END_ID) -> DataFrame:
    """One row per packed row: its group and number, ids and position_ids as ``row_tokens`` little-endian uint32 each (padding:
    ``end_id``, positions 0), cu_seqlens from 0 to n_tokens, and per segment the id of its text and the token range in it.

    Null and empty texts have the end-of-text id alone. Repeated rows are packed as often as they occur; null ids stay null;
    other columns are left out; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared, id_type = shared_ranks(spark, path, pattern), sql_type(docs, id_col)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    marks = checkpointed(rows.groupBy("id", "mark").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")))
    groups = max(1, -(-(marks.agg(F.sum("chars")).first()[0] or 0) // group_chars))
    often = checkpointed(marks.where("n > 1").select(F.col("id").alias("again"), F.col("mark").alias("again_mark")))
    rows = rows.withColumn("copy", F.lit(1))
    if not often.isEmpty():
        near = F.broadcast(often) if often.count() <= BROADCAST_ROWS else often
        same = F.col("id").eqNullSafe(F.col("again")) & (F.col("mark") == F.col("again_mark"))
        copies = rows.join(near, same, "left_semi").groupBy("id", "text", "mark").agg(F.count("*").cast("int").alias("n"))
        rows = rows.join(near, same, "left_anti").unionByName(copies.select("id", "text", "mark", F.explode(F.sequence(F.lit(1), "n")).alias("copy")))
    dealt = rows.select("id", "text", F.pmod(F.xxhash64("id", "mark", "copy"), F.lit(groups)).cast("int").alias("pack_group"))

    def encoded(batches):
        encode, _ = encoder(shared)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                ids = [np.array([*encode(well_formed(t)), end_id], dtype="<u4").tobytes() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), batch.column(2)], ["id", "ids", "pack_group"])

    def packed(data: pa.Table) -> pa.Table:
        group = data.column("pack_group")[0].as_py()
        order = sorted(range(data.num_rows), key=lambda i: (str(data.column("id")[i].as_py()), data.column("ids")[i].as_py()))
        data = data.take(pa.array(order))
        names, ids = data.column("id").to_pylist(), [np.frombuffer(x, dtype="<u4") for x in data.column("ids").to_pylist()]
        pieces = [(i, a, b) for i, x in enumerate(ids) for a, b in pieces_of(len(x), row_tokens)]
        out = []
        for number, chosen in enumerate(best_fit_decreasing([b - a for _, a, b in pieces], row_tokens)):
            matrix, positions, ends = np.full(row_tokens, end_id, dtype="<u4"), np.zeros(row_tokens, dtype="<u4"), [0]
            for i, a, b in (pieces[p] for p in chosen):
                matrix[ends[-1] : ends[-1] + b - a] = ids[i][a:b]
                positions[ends[-1] : ends[-1] + b - a] = np.arange(b - a)
                ends.append(ends[-1] + b - a)
            segments = [{"id": names[pieces[p][0]], "start": pieces[p][1], "end": pieces[p][2]} for p in chosen]
            out.append({"pack_group": group, "row": number, "n_tokens": ends[-1], "n_segments": len(chosen), "ids": matrix.tobytes(), "cu_seqlens": ends, "position_ids": positions.tobytes(), "segments": segments})
        segment = pa.struct([("id", data.schema.field("id").type), ("start", pa.int32()), ("end", pa.int32())])
        kinds = [("pack_group", pa.int32()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("n_segments", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_ids", pa.binary()), ("segments", pa.list_(segment))]
        return pa.Table.from_pylist(out, schema=pa.schema(kinds))

    tokens = map_arrow(dealt, encoded, f"id {id_type}, ids binary, pack_group int")
    return tokens.groupBy("pack_group").applyInArrow(packed, SCHEMA.format(id=id_type))


def op2_token_id_binary_output(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), *public_ranks())


QUERIES = {"op2_token_id_binary_output": op2_token_id_binary_output}
ORACLE_SQL: dict[str, str] = {}
