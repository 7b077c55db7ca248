"""No link of the near-duplicate stage is missed or invented, whatever the similarity and the length."""

import math
import random

import numpy as np
import pytest

from stormlane.llm import similar

SCHEMA = "doc_id long, text string"


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def sets(text):
    return set(similar._hashes(text, 5).tolist())


def jaccard(a, b):
    x, y = sets(a), sets(b)
    return len(x & y) / len(x | y)


def kept(spark, texts):
    return {r.doc_id for r in similar.one_of_each_group(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}


def test_pairs_near_the_threshold_are_all_found(spark):
    rng, texts, want = random.Random(7), [], set()
    while len(texts) < 400:
        one = words(rng, rng.choice([60, 150, 400]))
        two = list(one)
        for _ in range(rng.randrange(1, 12)):
            two[rng.randrange(len(two))] = f"x{rng.randrange(10**6)}"
        pair = " ".join(one), " ".join(two)
        if 0.76 <= (j := jaccard(*pair)) < 0.84:
            want |= {len(texts)} if j >= 0.8 else {len(texts), len(texts) + 1}
            texts += pair
    assert kept(spark, texts) == want


@pytest.mark.parametrize("common", [0, 5])
def test_two_sets_meet_in_their_prefixes_at_the_threshold(common):
    rng = np.random.default_rng(3)
    for size in range(1, 60):
        one = np.unique(rng.integers(-(2**62), 2**62, size))
        two = np.unique(np.concatenate([one[: math.ceil(0.8 * len(one))], rng.integers(-(2**62), 2**62, 3)]))
        shared = len(np.intersect1d(one, two))
        keys = np.sort(one[:common])
        if shared >= 0.8 * (len(one) + len(two) - shared):
            assert set(similar.prefix(one, 0.8, keys, np.arange(len(keys)) + 4)) & set(similar.prefix(two, 0.8, keys, np.arange(len(keys)) + 4))


def test_short_texts_are_judged_by_their_sets(spark):
    rng, texts, want = random.Random(11), [], set()
    for _ in range(60):
        one = words(rng, 9)  # 5 shingles, 4 of them in the other: 0.8
        want.add(len(texts))
        texts += [" ".join(one), " ".join(one[:8])]
    for _ in range(60):
        one = words(rng, 12)  # 8 shingles, 6 of them in the other: 0.75
        want |= {len(texts), len(texts) + 1}
        texts += [" ".join(one), " ".join(one[:10])]
    assert kept(spark, texts) == want


def test_a_sketch_never_differs_in_more_bits_than_the_sets():
    rng = np.random.default_rng(5)
    for size in (1, 5, 60, 900):
        one = np.unique(rng.integers(-(2**62), 2**62, size))
        two = np.unique(np.concatenate([one[size // 3 :], rng.integers(-(2**62), 2**62, size // 2)]))
        apart = sum(int(x).bit_count() for x in (similar.sketch(one) ^ similar.sketch(two)).view(np.uint64))
        assert apart <= len(np.setxor1d(one, two))


def test_chains_and_large_groups_become_one_group(spark):
    """Copies that are linked over others only, and a group of many copies of one text with another word changed in each."""
    rng = random.Random(13)
    chain = [words(rng, 60)]
    for step in range(12):  # each differs from the one before in one word
        chain.append([*chain[-1][: 4 * step], f"c{step}", *chain[-1][4 * step + 1 :]])
    base = words(rng, 90)
    copies = [[*base[:at], f"y{n}", *base[at + 1 :]] for n, at in enumerate(rng.randrange(90) for _ in range(300))]
    texts = [" ".join(t) for t in (*chain, base, *copies, words(rng, 90))]
    assert kept(spark, texts) == {0, len(chain), len(texts) - 1}


def near_texts(n=120):
    rng, texts = random.Random(17), []
    for _ in range(n // 3):
        one = words(rng, 300)
        texts += [one, [*one[:150], "x", *one[151:]], words(rng, 12)]
    return [" ".join(t) for t in texts]


def test_texts_meet_by_the_golay_keys_of_their_fingerprints(spark, monkeypatch):
    asked, linked = [], similar.simhash.linked
    monkeypatch.setattr(similar.simhash, "linked", lambda prints, *rest: asked.append({r.fingerprint for r in prints.collect()}) or linked(prints, *rest))
    texts = near_texts()
    assert kept(spark, texts) == {i for i in range(len(texts)) if i % 3 != 1}
    prints = [int(np.uint64(similar.simhash.majority_bits(similar._hashes(t, 5))).view(np.int64)) for i, t in enumerate(texts) if i % 3 < 2]
    assert len(asked) == 1 and set(prints) <= asked[0]
    rows = [(f"{i:03}".encode(), p) for i, p in enumerate([0, 7, 7 | 7 << 40, 15, 1 << 60 | 0xFF00, 1 << 60 | 0xFF00])]
    pairs = similar._by_fingerprint(spark.createDataFrame(rows, "node binary, fingerprint long")).collect()
    assert {(int(r.u), int(r.v)) for r in pairs} == {(0, 1), (0, 2), (0, 3), (4, 5)}


@pytest.mark.parametrize("fingerprint", ["0L", "xxhash64(node)"])
def test_links_do_not_depend_on_fingerprints(spark, monkeypatch, fingerprint):
    """Where all fingerprints are equal the sets refuse what isn't similar; where none are near the prefixes find what is."""
    from pyspark.sql import functions as F

    described = similar._described
    monkeypatch.setattr(similar, "_described", lambda *a: described(*a).withColumn("fingerprint", F.expr(fingerprint)))
    texts = near_texts()
    assert kept(spark, texts) == {i for i in range(len(texts)) if i % 3 != 1}
