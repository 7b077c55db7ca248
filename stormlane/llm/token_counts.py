"""Token counts per section by offset-mapped attribution.

A whole text is encoded once, so merges run across sections as they would in training. Each token's span of code points is
then joined to the section intervals: both are sorted, so the section of a token's first and of its last sign is a binary
search away. A token that crosses a boundary is counted by an explicit rule: ``first`` gives it to the section of its first
sign, ``last`` to that of its last, ``most`` to the one with most of its bytes (of equals, the first). Every token is counted
exactly once, so the counts of a text add up to its tokens.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormlane.llm.common import map_arrow, sql_type, table
from stormlane.llm.token_lengths import encoder, public_ranks, shared_ranks, well_formed

RULES = ("first", "last", "most")


def line_sections(text: str) -> list[int]:
    """Where sections start: paragraphs of the text, each line with its line end."""
    return [0, *accumulate(len(line) + 1 for line in text.split("\n"))][:-1]


def byte_starts(text: str, starts: list[int]) -> np.ndarray:
    """Places in code points as places in UTF-8."""
    if text.isascii():
        return np.array(starts, dtype=np.int64)
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    first = np.flatnonzero((raw & 0xC0) != 0x80)
    return np.concatenate([first, [len(raw)]])[starts]


def attribute(lengths: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section, and of those the tokens that cross into another; ``lengths`` in bytes, ``starts`` ascending from 0."""
    end = np.cumsum(lengths)
    begin = end - lengths
    low, high = np.searchsorted(starts, begin, side="right") - 1, np.searchsorted(starts, end - 1, side="right") - 1
    crossing = low != high
    owner = high.copy() if rule == "last" else low.copy()
    if rule == "most":
        for t in np.flatnonzero(crossing):
            edges = np.clip(np.append(starts[low[t] : high[t] + 1], end[t]), begin[t], end[t])
            owner[t] = low[t] + int(np.argmax(np.diff(edges)))
    return np.bincount(owner, minlength=len(starts)), np.bincount(owner[crossing], minlength=len(starts))


def section_tokens(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "first", sections=line_sections) -> DataFrame:
    """(id, n_tokens, sections) per row of ``docs``; sections is an array of (start, end, n_tokens, n_crossing), places in code points.

    ``sections`` maps a text to the ascending starts of its sections, the first 0. Null and empty texts have one empty section
    without tokens. Null ids and repeated rows are kept; other columns are left out; an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"the rule must be one of {RULES}")
    shared = shared_ranks(docs.sparkSession, path, pattern)
    part = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("n_tokens", pa.int32()), ("n_crossing", pa.int32())])

    def run(batches):
        encode, sizes = encoder(shared)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                totals, bounds, columns = [], [0], [[], [], [], []]
                for value in batch.column(1).to_pylist():
                    text = well_formed(value)
                    starts, lengths = sections(text), sizes[np.array(encode(text), dtype=np.int64)]
                    counts, crossing = attribute(lengths, byte_starts(text, starts), rule)
                    totals.append(len(lengths))
                    bounds.append(bounds[-1] + len(starts))
                    for column, more in zip(columns, (starts, [*starts[1:], len(text)], counts.tolist(), crossing.tolist())):
                        column += more
                flat = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], fields=list(part))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat)], ["id", "n_tokens", "sections"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, f"id {sql_type(docs, id_col)}, n_tokens bigint, sections array<struct<start:int,end:int,n_tokens:int,n_crossing:int>>")


def op6_token_counts(spark, sf_dir):
    found = section_tokens(table(spark, sf_dir, "documents"), *public_ranks())
    return found.select(F.col("id").alias("doc_id"), "n_tokens", F.size("sections").alias("n_sections"), F.transform("sections", lambda s: s["n_tokens"]).alias("section_tokens"), F.transform("sections", lambda s: s["n_crossing"]).alias("section_crossing"))


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLE_SQL: dict[str, str] = {}
