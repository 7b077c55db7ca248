import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormlane.llm import pu

DOCS, LABELS = "doc_id long, text string, score double, held_out string", "doc_id long, quality int, toxic int"
SF = "/root/testdata/sf0.01"


def rows_of(n, marker_every):
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(200)]
    docs = [(i, " ".join(rng.choice(words, 30)) + (" nasty" if i % marker_every == 0 else ""), None, None) for i in range(n)]
    return docs, [(i, 1, int(i % marker_every == 0)) for i in range(0, n, 2)]


def test_risk_minimiser_separates_and_keeps_to_the_prior():
    rng = np.random.default_rng(1)
    draw = lambda p: np.sort(np.flatnonzero(rng.random(30) < p)).astype(np.int64)
    high, low = np.r_[np.full(3, 0.9), np.full(27, 0.3)], np.r_[np.full(3, 0.02), np.full(27, 0.3)]
    positive = [draw(high) for _ in range(400)]
    truth = rng.random(2000) < 0.2
    unlabelled = [draw(high if t else low) for t in truth]
    model = pu.fit(positive, unlabelled, 0.2, pu.TOXICITY)
    weight = dict(zip(model.ids.tolist(), model.weights))
    predicted = np.array([model.bias + sum(weight.get(i, 0) for i in r.tolist()) > 0 for r in unlabelled])
    assert (predicted == truth).mean() > 0.97
    assert set(model.ids.tolist()) >= {0, 1, 2}


def test_no_positives_leaves_the_prior():
    model = pu.fit([], [np.array([1, 2])], 0.3, pu.TOXICITY)
    assert not model.weights.any() and 1 / (1 + np.exp(-model.bias)) == pytest.approx(0.3)


def test_markers_are_learnt_and_edge_rows_are_defined(spark):
    docs, labels = rows_of(1200, 5)
    docs += [(5000, None, 1.0, "x"), (5001, "", None, None), (None, "nasty", None, None), (5, "nasty " * 30000, None, None), (7, "fine", None, None), (7, "fine", None, None)]
    labels += [(None, 1, 1), (3, None, None), (9999, 0, 1), (10, 1, 0)]
    docs, labels = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    model = pu.toxicity_model(docs, labels)
    got = pu.score(docs, model, pu.TOXICITY).collect()
    assert len(got) == 1206 and all(0 <= r.score <= 1 for r in got)
    by_id = {r.id: r.score for r in got if r.id not in (5, 7)}
    assert all((by_id[i] >= 0.5) == (i % 5 == 0) for i in range(1200) if i not in (5, 7))
    assert by_id[None] >= 0.5 and by_id[5000] == by_id[5001] < 0.5
    kept = pu.keep_below(docs, model, pu.TOXICITY)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.id for r in got if r.score < 0.5 and r.id is not None)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    model = pu.toxicity_model(docs, labels)
    assert pu.score(docs, model, pu.TOXICITY).collect() == []
    some = spark.createDataFrame([(1, "a b", None, None)], DOCS)
    assert pu.score(some, pu.quality_model(some, labels), pu.QUALITY).count() == 1


@pytest.mark.parametrize(("query", "label", "mod", "rest", "least"), [(pu.op7_toxicity, "toxic", 5, 0, 0.85), (pu.op10_quality_classifier, "quality", 3, 1, 0.97)])
def test_held_out_accuracy(spark, query, label, mod, rest, least):
    got = query(spark, SF).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % mod == rest for i in got.doc_id]).all()
    assert ((got.score >= 0.5).astype(int) == got.predicted).all()
    held = got[got.held_out].merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert (held.predicted == held[label]).mean() >= least


def test_toxic_texts_are_found_and_clean_ones_left_alone(spark):
    """Most labels are 0, so the share of right answers says little: of the held-out rows, how many of each kind."""
    sf = "/root/testdata/sf0.1"
    got = pu.op7_toxicity(spark, sf).toPandas()
    held = got[got.held_out].merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    toxic, clean = held[held.toxic == 1], held[held.toxic == 0]
    assert len(toxic) > 50 and toxic.predicted.mean() >= 0.8 and clean.predicted.mean() <= 0.02


def plain_score(text, model, task):
    """The score of a text from the model's weights, word by word."""
    weight = dict(zip(model.ids.tolist(), model.weights.tolist()))
    if task is pu.TOXICITY:
        stripped = {w.strip(pu._EDGES) for w in (text or "").lower().split()} - {""}
        found = {pu._id("w", w) for w in stripped}
    else:
        found = set(pu.quality_features(text, pu.ending_features))
    return 1 / (1 + np.exp(-(model.bias + sum(weight.get(i, 0.0) for i in found))))


@pytest.mark.parametrize(("query", "fit", "task"), [(pu.op7_toxicity, pu.toxicity_model, pu.TOXICITY), (pu.op10_quality_classifier, pu.quality_model, pu.QUALITY)])
def test_query_scores_equal_plain_scores(spark, query, fit, task):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in query(spark, sf).collect():
        assert r.score == pytest.approx(plain_score(texts[r.doc_id], model, task), abs=1e-9) and r.predicted == (r.score >= 0.5)


def test_an_id_that_repeats_does_not_widen_the_sample(spark, monkeypatch):
    docs = spark.range(400).select(F.col("id"), F.concat(F.lit("some words "), F.col("id")).alias("text"))
    many = docs.unionAll(spark.range(10_000).select(F.lit(7).cast("long").alias("id"), F.concat(F.lit("again "), F.col("id")).alias("text")))
    labels = spark.range(400).select("id", (F.col("id") % 2).cast("int").alias("label"))
    sizes, fit = [], pu.fit
    monkeypatch.setattr(pu, "fit", lambda a, b, *rest: sizes.append((len(a), len(b))) or fit(a, b, *rest))
    task = pu.Task(pu.toxicity_features, pu.word_features, positives=150, unlabelled=300, steps=2)
    for _ in range(2):
        pu.train(many, labels, "label", lambda i: F.lit(True), task)
    assert sizes == [(150, 300)] * 2
    everything = pu.Task(pu.toxicity_features, pu.word_features, steps=2)
    pu.train(many, labels, "label", lambda i: F.lit(True), everything)
    assert sizes[-1] == (200, 400)
