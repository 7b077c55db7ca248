import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormlane.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, _n int, id string"


def plain(rows, s):
    """(id, code, error, label_error) and the digest of the codebooks, every entry compared in whole numbers of any size."""
    good = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    cut = {}
    for k, (_, v, _) in enumerate(good):
        whole, width = [math.floor(s.scale * float(x)) for x in v], len(v) // s.parts
        cut[k] = [whole[p * width : (p + 1) * width] for p in range(s.parts)]
    order = sorted(cut, key=lambda k: (good[k][0] is None, good[k][0] or 0, [float(x) for x in good[k][1]]))
    books = [[list(cut[k][p]) for k in order[: s.entries]] for p in range(s.parts)]
    off = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    assign = lambda: {k: [min((off(x, c), e) for e, c in enumerate(book)) for x, book in zip(parts, books)] for k, parts in cut.items()}
    for _ in range(s.rounds):
        found = assign()
        for p, book in enumerate(books):
            for e in range(len(book)):
                own = [cut[k][p] for k in cut if found[k][p][1] == e]
                if own:
                    book[e] = [sum(c) // len(own) for c in zip(*own)]
    found, by_label = assign(), defaultdict(int)
    for k, parts in found.items():
        by_label[good[k][2]] += sum(d for d, _ in parts)
    out = [(good[k][0], "".join(f"{e:02x}" for _, e in parts), sum(d for d, _ in parts), by_label[good[k][2]]) for k, parts in found.items()]
    return sorted(out, key=str), hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()


def coded(spark, rows, s):
    frame = spark.createDataFrame([(*r, "x", None, "y") for r in rows], SCHEMA).repartition(5)
    books = vc.fit(frame, settings=s)
    done = vc.with_group_sums(vc.encode(frame, books, settings=s), "label", "error", "label_error")
    return sorted(map(tuple, done.select("id", "code", "error", "label_error").collect()), key=str), books


@pytest.mark.parametrize(("n", "s"), [(400, vc.Settings(parts=4, entries=16)), (90, vc.Settings(parts=2, entries=64, rounds=3)), (5, vc.Settings(parts=8)), (300, vc.Settings(parts=1, entries=8, rounds=0))])
def test_codes_equal_brute_force(spark, n, s):
    """Ties, repeated rows and ids, null ids, labels and vectors, non-finite components; more rows than a label's share."""
    rng = np.random.default_rng(n)
    vectors = (rng.integers(-3, 4, (n, 8)) / 256 * rng.choice([1, 40, 300], (n, 1))).astype(np.float32).tolist()
    rows = [(int(rng.integers(0, n)), v, [None, 1, 1, 1, int(rng.integers(5, 2000))][k % 5]) for k, v in enumerate(vectors)] + [(3, vectors[0], 1)] * 3
    rows += [(None, vectors[1], None), (-1, None, 1), (-2, [1.0] * 7 + [None], 1), (-3, [1.0] * 7 + [float("nan")], 1), (-4, [float("inf")] * 8, 1)]
    got, books = coded(spark, rows, s)
    want, digest = plain(rows, s)
    assert got == want and books.sha256() == digest


def test_search_equals_all_entries():
    """Also where many entries have one sum, and where no entry is near."""
    rng = np.random.default_rng(1)
    for spread in (1, 3, 1000, 1 << 26):
        entries, x = rng.integers(-spread, spread + 1, (3, 50, 4)), rng.integers(-spread, spread + 1, (700, 3, 4))
        index, distance = vc.Codebooks(entries).assign(x)
        every = ((x[:, :, None, :] - entries[None]) ** 2).sum(axis=3)
        assert (index == every.argmin(axis=2)).all() and (distance == every.min(axis=2)).all()
    assert vc.Codebooks(entries).assign(x[:0])[0].shape == (0, 3)


def test_other_lengths_empty_tables_and_large_components(spark):
    s = vc.Settings(parts=2)
    assert vc.fit(spark.createDataFrame([], SCHEMA)) is None
    odd = spark.createDataFrame([(1, [1.0, 2.0], 1, None, None, None), (2, [1.0, 2.0, 3.0], 1, None, None, None), (3, [], 1, None, None, None), (4, [1e30, -1e30], 2, None, None, None)], SCHEMA)
    books = vc.fit(odd, settings=s)
    assert [(r.id, r.code, r.error) for r in vc.encode(odd, books, settings=s).orderBy("id").collect()] == [(1, "0000", 0), (4, "0101", 0)]
    assert vc.encode(odd.limit(0), books, settings=s).collect() == []
    back = vc.decode(vc.encode(odd, books, settings=s), books, settings=s).orderBy("id").select("vector").collect()
    assert back[0].vector == [1.0, 2.0] and back[1].vector == [(1 << 28) / 256, -(1 << 28) / 256]
    assert vc.decode(spark.createDataFrame([(None,)], "code string"), books, settings=s).first().vector is None


def test_sums_over_large_and_small_groups(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id")).cast("long").alias("label"), F.col("id").alias("error"))
    got = {r.label: (r.n, r.total) for r in vc.with_group_sums(rows, "label", "error", "total").groupBy("label", "total").agg(F.count("*").alias("n")).collect()}
    want = defaultdict(list)
    for i in range(3000):
        want[None if i % 3 == 0 else 7 if i % 3 == 1 else i].append(i)
    assert got == {k: (len(v), sum(v)) for k, v in want.items()}
