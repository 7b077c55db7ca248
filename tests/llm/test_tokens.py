import random

import numpy as np
import pytest

from stormlane.llm import packing, token_counts
from stormlane.llm.token_lengths import encoder, public_ranks

SCHEMA = "doc_id long, text string, ids string, pack_group int"
ROWS = [(1, "One line\nand é another 😂\n\nlast", "x", 1), (1, "One line\nand é another 😂\n\nlast", None, None), (None, "no id", None, None), (3, None, None, None), (4, "", None, None), (5, "long " * 20000, None, None), (6, "\n\n\n", None, None)]


class Plain:
    """A stand-in for the broadcast of a rank file."""

    def __init__(self):
        path, pattern = public_ranks()
        with open(path, "rb") as file:
            self.value = ("test", file.read(), pattern)


ENCODE, SIZES = encoder(Plain())


def plain_best_fit(lengths, capacity):
    room, rows = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [r for r in range(len(room)) if room[r] >= lengths[i]]
        if fits:
            r = min(fits, key=lambda r: room[r])
        else:
            r = len(room)
            room.append(capacity)
            rows.append([])
        rows[r].append(i)
        room[r] -= lengths[i]
    return room


def test_best_fit_equals_a_plain_search():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([1, 7, 16, 100])
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(60))]
        rows = packing.best_fit_decreasing(lengths, capacity)
        assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
        assert sorted(capacity - sum(lengths[i] for i in r) for r in rows) == sorted(plain_best_fit(lengths, capacity))
    with pytest.raises(ValueError):
        packing.best_fit_decreasing([5], 4)


@pytest.mark.parametrize(("row_tokens", "group_chars"), [(2048, 4_000_000), (16, 2000)])
def test_packing_loses_nothing(spark, row_tokens, group_chars):
    got = packing.pack(spark.createDataFrame(ROWS, SCHEMA), *public_ranks(), row_tokens=row_tokens, group_chars=group_chars).collect()
    texts: dict = {}
    for r in got:
        ids, places = np.frombuffer(r.ids, dtype="<u4"), np.frombuffer(r.position_ids, dtype="<u4")
        assert len(ids) == len(places) == row_tokens and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= row_tokens
        assert (ids[r.n_tokens :] == packing.END_ID).all()
        for s, a, b in zip(r.segments, r.cu_seqlens, r.cu_seqlens[1:]):
            assert (places[a:b] == np.arange(b - a)).all() and b - a == s.end - s.start
            texts.setdefault(s.id, []).append((s.start, ids[a:b].tolist()))
    for name in {r[0] for r in ROWS}:
        want = [[*ENCODE(t or ""), packing.END_ID] for i, t, *_ in ROWS if i == name]
        parts = sorted(texts[name])
        assert sum(len(p) for _, p in parts) == sum(map(len, want))
        if len(want) == 1:
            assert sum((p for _, p in parts), []) == want[0]
    assert packing.pack(spark.createDataFrame([], SCHEMA), *public_ranks()).collect() == []


def test_packed_rows_are_nearly_full_on_small_tables(spark):
    got = packing.op2_token_id_binary_output(spark, "/root/testdata/sf0.001").select("n_tokens").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    assert got.n_tokens.sum() == sum(len(ENCODE(r.text)) + 1 for r in docs)
    assert got.n_tokens.mean() > 0.97 * packing.ROW_TOKENS


def plain_counts(text, rule):
    lines = text.split("\n")
    owner = [k for k, line in enumerate(lines) for _ in range(len((line + "\n").encode()))]
    counts, at = [0] * len(lines), 0
    for token in ENCODE(text):
        own = owner[at : at + SIZES[token]]
        at += SIZES[token]
        counts[{"first": own[0], "last": own[-1], "most": max(sorted(set(own)), key=own.count)}[rule]] += 1
    return counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_counts_equal_brute_force(spark, rule):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = token_counts.section_tokens(docs, *public_ranks(), rule=rule).collect()
    assert sorted((str(r.id), [s.n_tokens for s in r.sections]) for r in got) == sorted((str(i), plain_counts(t or "", rule)) for i, t, *_ in ROWS)
    for r in got:
        assert sum(s.n_tokens for s in r.sections) == r.n_tokens and r.sections[0].start == 0
        assert all(a.end == b.start for a, b in zip(r.sections, r.sections[1:]))
    assert token_counts.section_tokens(docs.limit(0), *public_ranks(), rule=rule).collect() == []


def test_rules():
    lengths, starts = np.array([4, 4, 4]), np.array([0, 3, 7])
    assert [token_counts.attribute(lengths, starts, r)[0].tolist() for r in token_counts.RULES] == [[1, 1, 1], [0, 1, 2], [1, 1, 1]]
    assert token_counts.attribute(lengths, starts, "first")[1].tolist() == [1, 1, 0]
    with pytest.raises(ValueError):
        token_counts.section_tokens(None, "", "", rule="other")


def test_query_on_small_tables(spark):
    got = {r.doc_id: list(r.section_tokens) for r in token_counts.op6_token_counts(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert got == {r.doc_id: plain_counts(r.text, "first") for r in docs}


def plain_rows(names, tokens, capacity):
    """Best fit decreasing by looking at every open row; of rows with equal room the one that got it last."""
    pieces = [(n, at, t[at : at + capacity]) for n, t in sorted(zip(names, tokens), key=lambda x: (str(x[0]), np.array(x[1], dtype="<u4").tobytes())) for at in range(0, len(t), capacity)]
    rows, room, touched = [], [], []
    for step, piece in enumerate(sorted(pieces, key=lambda p: -len(p[2]))):
        fits = [(room[r], -touched[r], r) for r in range(len(rows)) if room[r] >= len(piece[2])]
        r = min(fits)[2] if fits else len(rows)
        if r == len(rows):
            rows.append([])
            room.append(capacity)
            touched.append(0)
        rows[r].append(piece)
        room[r] -= len(piece[2])
        touched[r] = step
    return rows


def test_query_rows_equal_plain_packing(spark):
    """Every packed row of the small tables, from the documents of its group."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    groups = {}
    for r in packing.op2_token_id_binary_output(spark, sf).collect():
        groups.setdefault(r.pack_group, {})[r.row] = r
    for packed in groups.values():
        names = sorted({s.id for r in packed.values() for s in r.segments})
        want = plain_rows(names, [[*ENCODE(texts[n] or ""), packing.END_ID] for n in names], packing.ROW_TOKENS)
        assert sorted(packed) == list(range(len(want)))
        for number, pieces in enumerate(want):
            ids = [t for _, _, p in pieces for t in p]
            assert np.frombuffer(packed[number].ids, dtype="<u4").tolist() == ids + [packing.END_ID] * (packing.ROW_TOKENS - len(ids))
            assert [(s.id, s.start, s.end) for s in packed[number].segments] == [(n, at, at + len(p)) for n, at, p in pieces]
            assert list(packed[number].cu_seqlens) == [0, *np.cumsum([len(p) for _, _, p in pieces]).tolist()]


def test_dealing_does_not_depend_on_the_partitions(spark):
    rows = spark.createDataFrame([(i % 7, f"text {i % 7} " * 40, None, None) for i in range(300)] + [(None, None, None, None)] * 5, SCHEMA)
    packed = lambda n: sorted((r.pack_group, r.row, bytes(r.ids)) for r in packing.pack(rows.repartition(n), *public_ranks(), group_chars=5000).collect())
    assert packed(1) == packed(5)
