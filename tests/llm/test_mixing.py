import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stormlane.llm import mixing as mx

SCHEMA = "doc_id long, text string, source string, quality double, size string, cell int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, ratios=(3, 1, 2), share=1.5, most=2):
    """Shares by ratio; what is above a cap is shared out again until nothing is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    ratio = {s: ratios[k % len(ratios)] for k, s in enumerate(names)}
    capped, total = set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            return {s: float(most * sizes[s]) for s in names}
        left = total - sum(most * sizes[s] for s in capped)
        out = {s: left * ratio[s] / sum(ratio[x] for x in free) for s in free}
        over = {s for s in free if out[s] > most * sizes[s] + 1e-9}
        if not over:
            return out | {s: float(most * sizes[s]) for s in capped}
        capped |= over


def plain(rows, **options):
    size = [len(WORD.findall(t or "")) for _, t, _, _ in rows]
    sizes = Counter()
    for (_, _, s, _), n in zip(rows, size):
        sizes[s] += n
    aims, by_source, out = plain_targets(sizes, **options), defaultdict(list), []
    for (i, t, s, w), n in zip(rows, size):
        u = (int(hashlib.sha256(f"12:{'' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        by_source[s].append((-math.log(u) / w if w and 0 < w < math.inf else math.inf, i is None, i or 0, n, t or ""))
    for s, some in by_source.items():
        epochs = int(aims[s] // sizes[s]) if sizes[s] else 0
        left = math.floor(aims[s] - epochs * sizes[s] + 1e-9)
        for _, no_id, i, n, _ in sorted(some):
            out.append((None if no_id else i, n, sizes[s], round(aims[s], 4), epochs * n + min(n, left), s))
            left -= min(n, left)
    return sorted(out, key=str)


def rows_of():
    text = lambda n, k: " ".join(f"w{(n * j + k) % 13}" for j in range(n))
    rows = [(i, text(1 + i * 7 % 40, i), "abc"[min(2, i // 60)], [None, 0.5, 2.0, 4.0, -1.0, float("nan"), 0.0][i % 7]) for i in range(150)]
    rows += [(700, "the same words", "hot", 1.0)] * 300 + [(701 + i, text(9, i), "hot", 2.0) for i in range(40)]
    rows += [(None, "no id", "a", 1.0), (None, "no id", "a", 1.0), (900, None, "a", 1.0), (901, "", "empty", None), (902, " \n\t", "empty", 1.0), (903, "in no source", None, 1.0), (904, "é 中文 x 😂", "Z", 1.0), (905, "word " * 30_000, "b", 1.0)]
    return rows


@pytest.mark.parametrize("options", [{}, {"share": 2.5}, {"share": 0.4, "ratios": (1,)}, {"share": 1.9, "ratios": (5, 1)}])
def test_rows_equal_brute_force(spark, options):
    rows = rows_of()
    docs = spark.createDataFrame([(*r, None, 1) for r in rows], SCHEMA)
    found = mx.mix(docs, F.col("quality"), **options)
    got = [(r.id, r.size, r.source_size, round(r.target, 4), r.taken, r.source) for r in found.collect()]
    assert sorted(got, key=str) == plain(rows, **options)
    again = mx.mix(docs.repartition(9), F.col("quality"), **options)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, found.collect()), key=str)


def test_the_mix_has_the_words_of_the_plan(spark):
    rows = rows_of()
    docs = spark.createDataFrame([(*r, None, 1) for r in rows], SCHEMA)
    words = Counter()
    for r in mx.mixture(docs, F.col("quality")).collect():
        own = [t for i, t, s, _ in rows if (i, s) == (r.id, r.source)]
        assert any(t and t.startswith(r.text) for t in own)
        words[r.source] += len(WORD.findall(r.text))
    want = Counter()
    for r in mx.mix(docs, F.col("quality")).collect():
        want[r.source] += r.taken
    assert +words == +want


def test_weights_from_a_table_equal_those_of_a_column(spark):
    rows = [r for r in rows_of() if r[0] is None or r[0] < 150 and r[3] is not None]
    docs = spark.createDataFrame([(*r, None, 1) for r in rows], SCHEMA)
    weights = docs.where("doc_id is not null and quality <> 2.0").select(F.col("doc_id").alias("id"), F.col("quality").alias("weight"))
    by_table = mx.mix(docs, weights=weights, default_weight=2.0)
    by_column = mx.mix(docs, F.when(F.col("doc_id").isNull(), 2.0).otherwise(F.col("quality")))
    assert sorted(map(str, by_table.collect())) == sorted(map(str, by_column.collect()))
    assert mx.mix(docs, weights=weights.limit(0)).count() == len(rows)


def test_good_documents_come_first(spark):
    docs = spark.createDataFrame([(i, "a b c d", "s", 4.0 if i % 2 else 0.25, None, 1) for i in range(800)], SCHEMA)
    taken = mx.mix(docs, F.col("quality"), share=0.5).groupBy((F.col("id") % 2).alias("good")).agg(F.sum("taken").alias("n"))
    n = {r.good: r.n for r in taken.collect()}
    assert n[0] + n[1] == 1600 and n[1] > 3 * n[0]


def test_empty_table_and_no_python(spark):
    assert mx.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    plan = mx.op12_mixing_sources(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
