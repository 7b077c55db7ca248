import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stormlane.llm import resampling as rs

SCHEMA = "doc_id long, text string, score string, rank int, _above int"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(text, longest, buckets):
    words = words_of(text)
    return [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain(rows, target, s):
    """Per row (id, n_words, n_features, weight, score, rank) by brute force."""
    found = [grams(t, s.longest, s.buckets) for _, t in rows]
    source, aim = Counter(b for f in found for b in f), Counter(b for t in target for b in grams(t, s.longest, s.buckets))
    n_source, n_aim = sum(source.values()) + s.buckets, sum(aim.values()) + s.buckets
    gain = lambda b: math.floor(s.scale * math.log((aim[b] + 1.0) * n_source / ((source[b] + 1.0) * n_aim)))
    out = []
    for (i, t), f in zip(rows, found):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{s.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words_of(t)), len(f), weight, weight + math.floor(-s.scale * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in out if r[1] >= s.least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for rank, row in enumerate(able[: math.floor(s.percent * len(able) / 100)], 1):
        row[5] = rank
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_features_equal_plain_ones(longest):
    rng = random.Random(longest)
    texts = [None, "", " .,", "a", "A b", "a b  c\x00d Éé éa 中文 x1"] + ["".join(rng.choice(["a", "B", "é", " ", ". ", "zz", "\n", "9"]) for _ in range(rng.randrange(60))) for _ in range(80)]
    got = [[] for _ in texts]
    for rows, buckets in rs.features(pa.array(texts, pa.string()), longest, 997):
        assert (np.diff(rows) >= 0).all()
        for row, bucket in zip(rows.tolist(), buckets.tolist()):
            got[row].append(bucket)
    assert got == [grams(t, longest, 997) for t in texts]
    for _, buckets in rs.features(pa.array([None, ""], pa.string()), longest, 997):
        assert len(buckets) == 0


@pytest.mark.parametrize("settings", [rs.Settings(), rs.Settings(longest=3, buckets=64, least_words=5, percent=37.5, scale=10.0), rs.Settings(percent=100, scale=1.0, least_words=0)])
def test_rows_equal_brute_force(spark, settings):
    """Ties, repeats of one id, null ids and texts, very long texts; a coarse scale makes many equal scores."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("the of and road rain Signal lane speed x9 é".split()) for _ in range(n))
    rows = [(i, text(rng.randrange(60))) for i in range(120)] + [(500, same := text(40))] * 40 + [(500, text(41)), (None, same), (None, None), (601, None), (602, ""), (603, text(20_000)), (604, "x" * 100_000)]
    target = [text(15) + " benchmark" for _ in range(9)] + [None, ""]
    docs = spark.createDataFrame([(i, t, "x", None, 1) for i, t in rows], SCHEMA).repartition(7)
    got = rs.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), settings)
    assert got.columns == ["id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, target, settings)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "some words here", "x", None, 1)], SCHEMA), spark.createDataFrame([], SCHEMA)
    assert rs.resample(none, docs).collect() == []
    assert [tuple(r) for r in rs.resample(docs, none, rs.Settings(least_words=1, percent=100)).collect()] == plain([(1, "some words here")], [], rs.Settings(least_words=1, percent=100))


def test_the_draw_leans_towards_the_target(spark):
    """Documents about the target's subject are a tenth of all and half of what is drawn or more."""
    rng = random.Random(2)
    text = lambda pool: " ".join(rng.choice(pool) for _ in range(60))
    near, far = [f"maths{i}" for i in range(50)], [f"other{i}" for i in range(500)]
    docs = spark.createDataFrame([(i, text(near if i % 10 == 0 else far), None, None, None) for i in range(600)], SCHEMA)
    got = rs.resample(docs, spark.createDataFrame([(text(near),) for _ in range(20)], "text string"))
    drawn = got.where("rank is not null").select(F.count("*").alias("n"), F.count_if(F.col("id") % 10 == 0).alias("near"), F.max("rank").alias("last")).first()
    assert drawn.n == drawn.last == 60 and drawn.near >= 30
