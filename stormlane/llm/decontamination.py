"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton knows every sequence of words of every normalised item. A document's words are streamed through it once; the
state and the length of the longest match that ends at each word say which windows of which items end there. A window is
``window`` consecutive words of an item; an item with fewer words is one window. Words inside an occurrence of a window are
hit; spans of hit words are cut, and documents with too large a share of hit words are dropped.

The items are a small table beside the documents, but its size is checked: beyond ``shard_words`` words it is split by a hash
of the item into shards of about that size, each with an automaton of its own, and the documents pass through one after the
other. An automaton is built in each Python worker from the shard's broadcast words, at most two states a word.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormlane.llm.common import map_arrow, sql_type, table

WINDOW, SHARD_WORDS, MAX_COVERAGE = 10, 250_000, 0.5
#: A word in a text that isn't lower-cased yet: digits, letters A-Z and a-z, and all beyond ASCII.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_TABLE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words, with A-Z in lower case; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).lower().split()


class Automaton:
    """A generalised suffix automaton over word numbers, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.words = window, {}
        self.length, self.link, self.next = [0], [-1], [{}]
        #: Items of the strings of at least a window's length that end in a state; items that are a state's longest string.
        self.items: dict[int, set[str]] = {}
        self.whole: dict[int, set[str]] = {}
        paths = []
        for item, words in items:
            numbers, state, path = [self.words.setdefault(w, len(self.words)) for w in words], 0, []
            for number in numbers:
                state = self._extend(state, number)
            paths.append((item, numbers))
        for item, numbers in paths:
            state = 0
            for number in numbers:
                state = self.next[state][number]
                if len(numbers) >= window:
                    at = state
                    while self.length[at] >= window and item not in (found := self.items.setdefault(at, set())):
                        found.add(item)
                        at = self.link[at]
            if numbers and len(numbers) < window:
                self.whole.setdefault(state, set()).add(item)
        self._find_windows()

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.length) - 1

    def _split(self, state: int, number: int) -> int:
        """The state of the longest string of ``state`` followed by ``number``, which exists but may share a longer one's state."""
        there = self.next[state][number]
        if self.length[there] == self.length[state] + 1:
            return there
        copy = self._new(self.length[state] + 1, self.link[there], dict(self.next[there]))
        self.link[there] = copy
        while state >= 0 and self.next[state].get(number) == there:
            self.next[state][number] = copy
            state = self.link[state]
        return copy

    def _extend(self, state: int, number: int) -> int:
        if number in self.next[state]:
            return self._split(state, number)
        new = self._new(self.length[state] + 1, 0, {})
        while state >= 0 and number not in self.next[state]:
            self.next[state][number] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, number)
        return new

    def _find_windows(self) -> None:
        """Per state: the state of its last ``window`` words, and the short items that end its proper suffixes."""
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        self.last_window = [0] * len(self.length)
        self.short: list[tuple[int, frozenset[str]]] = [(0, frozenset())] * len(self.length)
        for state in order:
            up = self.link[state]
            self.last_window[state] = self.last_window[up] if self.length[up] >= self.window else state
            size, names = self.short[up]
            if up in self.whole:
                size, names = self.length[up], names | self.whole[up]
            self.short[state] = size, names
        #: Whether anything can be found in a state before its match is a window long.
        self.watched = bytearray(1 if s in self.whole or self.short[s][0] else 0 for s in range(len(self.length)))

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words, merged, as (first, behind last), and the items whose windows occur."""
        following, link, length, watched, window = self.next, self.link, self.length, self.watched, self.window
        state = size = 0
        spans: list[tuple[int, int]] = []
        windows: set[int] = set()
        names: set[str] = set()
        for at, number in enumerate(map(self.words.get, words)):
            if number is None:
                state = size = 0
                continue
            there = following[state].get(number)
            while there is None and state:
                state = link[state]
                size = length[state]
                there = following[state].get(number)
            if there is None:
                size = 0
                continue
            state = there
            size += 1
            if size >= window or watched[state]:
                longest = 0
                if watched[state]:
                    longest, found = self.short[state]
                    names |= found
                    if state in self.whole and size == length[state]:
                        longest = size
                        names |= self.whole[state]
                if size >= window:
                    longest = size
                    windows.add(self.last_window[state])
                if longest:
                    spans.append((at + 1 - longest, at + 1))
        for state in windows:
            names |= self.items[state]
        return merged(spans), names


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def places(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of code points."""
    if not spans:
        return []
    found = [m.span() for m in _WORD.finditer(text)]
    return [(found[a][0], found[b - 1][1]) for a, b in spans]


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans of code points."""
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        at = end
    return "".join([*kept, text[at:]])


_BUILT: dict[tuple[str, int], Automaton] = {}


def _built(shared, window: int) -> Automaton:
    """The automaton of a shard; each Python worker keeps the last one, by the shard's own name."""
    name, items = shared.value
    if (name, window) not in _BUILT:
        _BUILT.clear()
        _BUILT[name, window] = Automaton([(item, words_of(text)) for item, text in items], window)
    return _BUILT[name, window]


def _shards(benchmark: DataFrame, item_col: str, text_col: str, shard_words: int) -> list:
    """Broadcasts of a new name and the shard's (item as text, text), each of about ``shard_words`` words at most."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null").distinct()
    total = rows.agg(F.sum(F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    n = max(1, -(-total // shard_words))
    share = lambda k: rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
    return [rows.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, sorted(map(tuple, share(k).collect())))) for k in range(n)]


def _streamed(docs: DataFrame, text_col: str, shards: list, window: int, finish: Callable, schema) -> DataFrame:
    """Passes ``docs`` through every shard's automaton; ``finish(batch, texts, words, spans, items)`` makes the last one's rows."""
    taken, extra = {c.lower() for c in docs.columns}, []
    for name in ("_spans", "_items"):
        while name in taken:
            name += "_"
        extra.append(name)
    names = docs.columns
    at, width = names.index(text_col), len(names)

    def passing(shared, first: bool, last: bool):
        def run(batches):
            automaton = _built(shared, window)
            for whole in batches:
                for offset in range(0, whole.num_rows, 1000):
                    batch = whole.slice(offset, 1000)
                    texts = batch.column(at).to_pylist()
                    words = [words_of(t) for t in texts]
                    found = [automaton.match(w) for w in words]
                    spans, items = [s for s, _ in found], [i for _, i in found]
                    if not first:
                        before = [list(zip(x[::2], x[1::2])) for x in batch.column(width).to_pylist()]
                        spans = [merged(a + b) for a, b in zip(before, spans)]
                        items = [set(a) | b for a, b in zip(batch.column(width + 1).to_pylist(), items)]
                        batch = pa.RecordBatch.from_arrays(batch.columns[:width], names=names)
                    if last:
                        yield finish(batch, texts, words, spans, items)
                    else:
                        flat = pa.array([list(chain.from_iterable(s)) for s in spans], pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_arrays([*batch.columns, flat, pa.array([sorted(i) for i in items], pa.list_(pa.string()))], names=[*names, *extra])

        return run

    kinds = (T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType()))
    between = T.StructType([*docs.schema.fields, *map(T.StructField, extra, kinds)])
    out = docs
    for k, shared in enumerate(shards):
        last = k == len(shards) - 1
        out = map_arrow(out, passing(shared, k == 0, last), schema if last else between)
    return out


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """(id, n_words, n_hit, items, spans) per row of ``docs``: items as sorted strings, spans of hit words in code points.

    A null or empty text has no words and no hits. Benchmark rows with a null id or text, or without words, are no items;
    several rows of one id are one item with the windows of all. Repeated documents and null ids are kept; other columns are
    left out; an empty table on either side gives no rows, or no hits.
    """

    def finish(batch, texts, words, spans, items):
        marks = [[{"start": a, "end": b} for a, b in places(t or "", s)] for t, s in zip(texts, spans)]
        columns = [
            batch.column(0),
            pa.array(list(map(len, words)), pa.int64()),
            pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
            pa.array([sorted(i) for i in items], pa.list_(pa.string())),
            pa.array(marks, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ]
        return pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_hit", "items", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {sql_type(docs, id_col)}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:int,end:int>>"
    return _streamed(rows, "text", _shards(benchmark, item_col, item_text_col, shard_words), window, finish, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with hit spans cut from their texts; rows with more than ``max_coverage`` of their words hit are dropped.

    All columns stay, whatever their names; texts without hits, nulls included, stay as they are.
    Items are those of ``find``; repeated rows are judged one by one, alike. An empty table of documents gives no rows, one of items
    leaves all as they are.
    """
    names = docs.columns
    at = names.index(text_col)

    def finish(batch, texts, words, spans, items):
        keep = [sum(b - a for a, b in s) <= max_coverage * len(w) for s, w in zip(spans, words)]
        clean = pa.array([cut(t, places(t, s)) if s else t for t, s in zip(texts, spans)], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns[:at], clean, *batch.columns[at + 1 :]], names=names).filter(pa.array(keep, pa.bool_()))

    return _streamed(docs, text_col, _shards(benchmark, item_col, item_text_col, shard_words), window, finish, docs.schema)


def op1_benchmark_decontamination(spark, sf_dir):
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
w AS (SELECT DISTINCT item, k, array_to_string(words[i:i + k - 1], ' ') AS gram FROM (SELECT item, words, least(len(words), 10) AS k, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
g AS (SELECT row_no, k, i, array_to_string(words[i:i + k - 1], ' ') AS gram FROM (SELECT row_no, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM w) WHERE len(words) >= k)),
h AS (SELECT g.row_no, g.i, w.k, w.item FROM g JOIN w ON g.k = w.k AND g.gram = w.gram),
p AS (SELECT row_no, count(DISTINCT place) AS n_hit FROM (SELECT row_no, unnest(range(i, i + k)) AS place FROM h) GROUP BY row_no),
t AS (SELECT row_no, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row_no, item FROM h) GROUP BY row_no)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (row_no) LEFT JOIN t USING (row_no)
"""

QUERIES = {"op1_benchmark_decontamination": op1_benchmark_decontamination}
ORACLE_SQL = {"op1_benchmark_decontamination": _SQL}
