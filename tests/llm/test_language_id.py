import math
import zlib

import numpy as np

from pyspark.sql import functions as F

from stormlane.llm import language_id as li

SCHEMA = "doc_id long, text string, lang string, score double, id string"


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 9):
        codes = li.codebook(n, 15).astype(int)
        apart = (15 - codes @ codes.T) // 2
        assert apart[~np.eye(n, dtype=bool)].min() >= (15 if n == 2 else 5)


def test_wrong_bits_are_corrected():
    codes = li.codebook(4, 15)
    model = li.Model(list("abcd"), codes, np.eye(15, dtype=np.float32) * 4, np.zeros(15), np.ones(15), li.Settings())
    for k in range(4):
        sent = codes[k].astype(np.float32).copy()
        sent[[1, 7]] *= -1
        best, score, close = li.decode(sent[None], model)
        assert best[0] == k and 0 <= score[0] <= 1 and not close[0]


def test_counts_do_not_depend_on_blocks(monkeypatch):
    text = "Ünïcode and plain text, 12 times. " * 30
    whole = li.ngram_counts(text, 12)
    monkeypatch.setattr(li, "_BLOCK", 50)
    assert np.allclose(li.ngram_counts(text, 12), whole)


def test_edge_rows(spark):
    good = [(i, f"the house and the garden {i} with water" if i % 2 else f"le jardin et la maison {i} avec eau", "en" if i % 2 else "fr", None, None) for i in range(400)]
    odd = [(1000, None, "en", 1.0, "x"), (1001, "", None, None, None), (1002, "123 !? 456", "fr", None, None), (None, "the garden", "en", None, None), (1004, "the house " * 40000, None, None, None), (1, good[1][1], "en", None, None)]
    docs = spark.createDataFrame(good + odd, SCHEMA)
    model = li.train(docs, ~li.is_fold(F.col("doc_id"), 4, 2))
    assert model.languages == ["en", "fr"]
    got = li.identify(docs, model).collect()
    assert len(got) == len(good) + len(odd)
    by_id = {r.id: r for r in got}
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert by_id[None].lang_pred == by_id[1004].lang_pred == "en"
    assert all(by_id[i].lang_pred == ("en" if i % 2 else "fr") for i in range(400))


def test_empty_and_unlabelled_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert li.identify(none, li.train(none, F.lit(True))).collect() == []
    bare = spark.createDataFrame([(1, "some words", None, None, None)], SCHEMA)
    assert [tuple(r) for r in li.identify(bare, li.train(bare, F.lit(True))).collect()] == [(1, "und", 0.0, True)]
    single = spark.createDataFrame([(1, "some words", "en", None, None)], SCHEMA)
    assert li.identify(single, li.train(single, F.lit(True))).first().lang_pred == "en"


def test_held_out_accuracy(spark):
    got = li.op3_language_id(spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out].merge(truth, on="doc_id")
    assert (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_codewords_grow_with_the_languages():
    for n in (4, 20, 60):
        bits = li.enough_bits(n, li.Settings())
        codes = li.codebook(n, bits).astype(int)
        apart = (bits - codes @ codes.T) // 2
        assert apart[~np.eye(n, dtype=bool)].min() >= 5 and (bits == 15) == (n == 4)


def plain_counts(text, hash_bits):
    """Square roots of hashed counts of 1- to 3-grams, gram by gram."""
    a, b, c = (int(x) for x in li._FACTORS)
    signs = [32 if ord(x) < 128 and not "a" <= x <= "z" else ord(x) for x in text.lower()]
    counts, mask = [0] * (1 << hash_bits), (1 << 32) - 1
    for at in range(len(signs)):
        gram = signs[at] * a & mask
        counts[gram >> 32 - hash_bits] += 1
        if at + 1 < len(signs):
            gram = (gram ^ (signs[at + 1] * b & mask)) * c & mask
            counts[gram >> 32 - hash_bits] += 1
        if at + 2 < len(signs):
            gram = (gram ^ (signs[at + 2] * a & mask)) * b & mask
            counts[gram >> 32 - hash_bits] += 1
    return [n**0.5 / sum(counts) ** 0.5 for n in counts]


def test_query_equals_plain_decoding(spark):
    """Every row of the small tables, scored bit by bit and codeword by codeword from the same model."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = li.train(docs, ~li.is_fold(F.col("doc_id"), 4, 2))
    got = {r.doc_id: r for r in li.op3_language_id(spark, sf).collect()}
    for r in docs.select("doc_id", "text").collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        counts = plain_counts(r.text, 12)
        used = [i for i, x in enumerate(counts) if x]
        outputs = [sum(counts[i] * float(model.weights[i, k]) for i in used) + float(model.bias[k]) for k in range(len(model.bias))]
        losses = [sum(w * math.log1p(math.exp(-o * int(c))) for w, o, c in zip(model.bit_weights, outputs, code)) for code in model.codes]
        odds = [math.exp(min(losses) - x) for x in losses]
        assert model.languages[losses.index(min(losses))] == got[r.doc_id].lang_pred
        assert abs(max(odds) / sum(odds) - got[r.doc_id].score) < 1e-4


def test_an_id_that_repeats_does_not_widen_the_sample(spark, monkeypatch):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id")).alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("fr").alias("lang"))
    many = docs.unionAll(spark.range(10_000).select(F.lit(8).cast("long"), F.concat(F.lit("again "), F.col("id")), F.lit("en")))
    sizes, fit = [], li.fit
    monkeypatch.setattr(li, "fit", lambda features, languages, settings: sizes.append((languages.count("en"), languages.count("fr"))) or fit(features, languages, settings))
    li.train(many, F.lit(True), settings=li.Settings(rows=100, steps=2))
    li.train(many, F.lit(True), settings=li.Settings(rows=4000, steps=2))
    assert sizes == [(50, 50), (150, 150)]
