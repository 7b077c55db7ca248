import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stormlane.llm import golay, simhash
from stormlane.llm.common import join_spread
from stormlane.llm.components import connected_components

SCHEMA = "doc_id long, text string, fingerprint string, id int"


def plain_fingerprint(text, k=3):
    words = [w for w in (text or "").encode().lower().split()]
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    values = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def plain_components(prints, distance=3):
    """prints: (id, fingerprint); every pair is compared."""
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(prints):
        for j, b in prints[:n]:
            if (a ^ b).bit_count() <= distance:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in prints}


def test_golay_words_one_bit_apart_meet():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)
    found = golay.probes(words)
    assert set((found >= 0).sum(axis=1)) <= {1, 6}
    for bit in range(23):
        assert (found == golay.index(words ^ (1 << bit))[:, None]).any(axis=1).all()


def test_links_equal_brute_force_on_clustered_fingerprints(spark):
    rng = random.Random(5)
    values = []
    for _ in range(60):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 12])):
            value = centre
            for _ in range(rng.randrange(6)):
                value ^= 1 << rng.randrange(64)
            values.append(value)
    values = sorted(set(values) | {0, 7, 1 << 63})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = dict(simhash.linked(spark.createDataFrame([(v,) for v in signed], "fingerprint long")).collect())
    want = plain_components([(s, v) for s, v in zip(signed, values)])
    sizes = {r: list(want.values()).count(r) for r in want.values()}
    assert {k for k in want if sizes[want[k]] > 1} == set(got)
    groups = lambda m: {frozenset(k for k in got if m[k] == r) for r in {m[k] for k in got}}
    assert groups(got) == groups(want)


def test_edge_rows(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "x", 1), (2, text.upper(), None, None), (2, text, "x", 3), (None, text, None, 4), (5, None, None, 5), (6, "", None, 6), (7, " \n\t", None, 7), (8, "One  two\x0bthree", None, 8), (9, "one two three", None, 9), (10, "é" * 5000 + " a b", None, 1), (None, "alone here it is", None, 2)]
    got = [tuple(r) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(rows)
    want = sorted((i, plain_fingerprint(t)) for i, t, *_ in rows if i)
    assert sorted((i, f % 2**64) for i, f, _ in got if i) == want
    by_id = {i: c for i, _, c in got if i}
    assert by_id[2] == 1 and by_id[9] == 8
    assert {by_id[5], by_id[6], by_id[7]} == {5}
    assert sorted(str(c) for i, _, c in got if i is None) == ["1", "None"]
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (200, None)]
    got = dict(connected_components(spark.createDataFrame(links, "u long, v long")).collect())
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_query_on_small_tables(spark):
    got = simhash.op4_simhash_near_dedup(spark, "/root/testdata/sf0.001").collect()
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = [(r.doc_id, plain_fingerprint(r.text)) for r in texts]
    comps = plain_components(want)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{f:016x}", comps[i]) for i, f in want)


def test_distance_beyond_the_keys_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.linked(spark.createDataFrame([], "fingerprint long"), 4)


def test_hot_keys_are_joined_where_their_rows_are(spark):
    rows = [(i, 7 if i % 3 else i) for i in range(6000)] + [(-1, None)]
    own = spark.createDataFrame(rows, "id long, k long")
    facts = own.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), (F.first("k") * 2).alias("twice"))
    got = join_spread(own, facts, "k")
    assert got.columns == ["k", "id", "twice"]
    assert sorted((r.id, r.k, r.twice) for r in got.collect()) == sorted((i, k, 2 * k) for i, k in rows if k is not None)
    assert join_spread(own.limit(0), facts.limit(0), "k").count() == 0


def test_copies_and_null_texts_in_thousands(spark):
    texts = ["one two three four five six"] * 3000 + [None] * 1500 + [f"word{i} other{i} more{i} last{i}" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(texts) and len({r.id for r in found}) == len(texts)
    want = plain_components([(t, plain_fingerprint(t)) for t in sorted(set(texts), key=texts.index)])
    first = {t: texts.index(t) for t in set(texts)}
    least = {root: min(first[t] for t in want if want[t] == root) for root in set(want.values())}
    assert all(r.component_id == least[want[texts[r.id]]] for r in found)
