"""Language identification by error-correcting output codes.

Each language has a codeword of bits. One binary classifier per bit, over hashed letter n-grams, says which side of the bit a
text is on; decoding sums the logistic loss of each codeword over all bits, weighted by how well a bit's classifier does on
its training rows, and takes the codeword with the smallest loss. Codewords differ in many bits, so some wrong bits are
corrected: with more languages the codewords get longer until any two differ in ``distance`` bits or more. Where the two best
codewords are close, the answer is flagged as ambiguous; of equally good ones the first by name is taken.

Bounds: at most ``rows`` labelled ids are sampled, in equal parts per language, those with the least hashes; their whole texts
count. Only ids whose hash is under a threshold, set by the language's counted ids so that about twice as many
pass as are wanted, are put in order. The model has ``bits`` classifiers or more over 2**``hash_bits`` features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormlane.llm.common import checkpointed, is_fold, map_arrow, sql_type, table

UNKNOWN = "und"
_BLOCK = 1 << 20
_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], dtype=np.uint32)


@dataclass(frozen=True)
class Settings:
    rows: int = 4000
    bits: int = 15
    distance: int = 5
    hash_bits: int = 12
    steps: int = 200
    rate: float = 0.05
    decay: float = 1e-5
    #: Probability by which the best language must lead the second.
    margin: float = 0.2


@dataclass(frozen=True)
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    bit_weights: np.ndarray
    settings: Settings


def codebook(n: int, bits: int, seed: int = 1) -> np.ndarray:
    """n codewords of +1 and -1 whose least mutual distance is the best of many seeded draws, each bit split as evenly as can be."""
    if n < 2:
        return np.ones((n, bits), dtype=np.int8)
    rng, best, most = np.random.default_rng(seed), None, (-1, 0.0)
    side = np.where(np.arange(n) < (n + 1) // 2, 1, -1).astype(np.int8)
    for _ in range(300):
        draw = np.stack([rng.permutation(side) for _ in range(bits)], axis=1)
        apart = (bits - draw.astype(int) @ draw.T.astype(int)) // 2 + np.eye(n, dtype=int) * bits
        found = (int(apart.min()), float(apart.mean()))
        if found > most:
            best, most = draw, found
    return best


def enough_bits(n: int, settings: Settings) -> int:
    """Bits of a codebook for n languages: as few as ``bits`` or, from there in steps of 8, as give ``distance``."""
    bits = settings.bits
    while n > 1:
        codes = codebook(n, bits).astype(int)
        if int((bits - codes @ codes.T + 2 * bits * np.eye(n, dtype=int)).min()) // 2 >= settings.distance:
            break
        bits += 8
    return bits


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def ngram_counts(text: str | None, hash_bits: int) -> np.ndarray:
    """Hashed counts of 1- to 3-grams of the lower-cased text, in which all ASCII but letters counts as a space, as square
    roots of unit length together."""
    size, shift = 1 << hash_bits, np.uint32(32 - hash_bits)
    counts, text = np.zeros(size, dtype=np.int64), (text or "").lower()
    for at in range(0, len(text), _BLOCK):
        signs = np.frombuffer(text[max(0, at - 2) : at + _BLOCK].encode("utf-32-le", "replace"), dtype=np.uint32)
        signs = np.where((signs < 128) & ((signs < 97) | (signs > 122)), np.uint32(32), signs)
        one = signs * _FACTORS[0]
        two = (one[:-1] ^ (signs[1:] * _FACTORS[1])) * _FACTORS[2]
        three = (two[:-1] ^ (signs[2:] * _FACTORS[0])) * _FACTORS[1]
        if at:  # those that lie in the block before are counted
            one, two = one[2:], two[1:]
        counts += np.bincount(np.concatenate([one, two, three]) >> shift, minlength=size)
    root = np.sqrt(counts, dtype=np.float32)
    return root / max(1e-9, float(np.sqrt(counts.sum())))


def fit(features: np.ndarray, languages: list[str], settings: Settings) -> Model:
    """Adam on the logistic loss of all bits at once; rows count so that each language weighs the same."""
    names = sorted(set(languages))
    bits = enough_bits(len(names), settings)
    codes = codebook(len(names), bits)
    weights, bias = np.zeros((1 << settings.hash_bits, bits), dtype=np.float32), np.zeros(bits, dtype=np.float32)
    if len(names) < 2:
        return Model(names, codes, weights, bias, np.ones(bits), settings)
    number = np.array([names.index(x) for x in languages])
    target = codes[number].astype(np.float32)
    share = (1 / np.bincount(number)[number] / len(names)).astype(np.float32)[:, None]
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(bias), np.zeros_like(bias)]
    for step in range(1, settings.steps + 1):
        margin = target * (features @ weights + bias)
        slope = -share * target / (1 + np.exp(np.clip(margin, -30, 30)))
        for k, (value, gradient) in enumerate(((weights, features.T @ slope + settings.decay * weights), (bias, slope.sum(axis=0)))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (gradient - m)
            v += 0.001 * (gradient**2 - v)
            value -= settings.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    right = (share * (target * (features @ weights + bias) > 0)).sum(axis=0)
    return Model(names, codes, weights, bias, np.clip(2 * right - 1, 0.05, 1.0), settings)


def decode(features: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row the number of the best language, its probability, and whether the second is close."""
    output = (features @ model.weights + model.bias).astype(np.float64)
    loss = np.stack([np.logaddexp(0, -output * code) @ model.bit_weights for code in model.codes], axis=1)
    odds = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
    odds /= odds.sum(axis=1, keepdims=True)
    best = odds.argmax(axis=1)
    first = odds[np.arange(len(odds)), best]
    second = np.partition(odds, -2, axis=1)[:, -2] if odds.shape[1] > 1 else np.zeros(len(odds))
    return best, first, first - second < model.settings.margin


def _features(rows: DataFrame, settings: Settings):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([ngram_counts(t.as_py(), settings.hash_bits).tobytes() for t in batch.column(1)], pa.binary())], ["lang", "features"])

    return map_arrow(rows, run, "lang string, features binary")


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings()) -> Model:
    """A model from the rows of ``docs`` that are ``usable`` and have an id, a language and a text with a letter. An id that
    repeats within a language counts once, with the least of its texts by hash, so the sample's bound holds for any table."""
    rows = docs.where(usable).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("id is not null and text is not null and lang is not null")
    counts = checkpointed(rows.select("id", "lang").distinct().groupBy("lang").agg(F.count("*").alias("n")))
    each = max(1, settings.rows // max(1, counts.count()))
    place = F.xxhash64("id").cast("double") / F.lit(2.0**64) + 0.5  # from 0 to 1, in the hashes' order
    some = rows.select("id", "lang").join(F.broadcast(counts), "lang").where(place <= F.lit(2.0 * each + 100) / F.col("n")).select("id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    sample = some.withColumn("place", F.row_number().over(order)).where(F.col("place") <= each).select("id", "lang")
    one = rows.join(F.broadcast(sample), ["id", "lang"], "left_semi").groupBy("id", "lang").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    found = _features(one.select("lang", "least.text"), settings).toArrow().to_pydict()
    features = np.frombuffer(b"".join(found["features"]), dtype=np.float32).reshape(-1, 1 << settings.hash_bits)
    kept = features.any(axis=1)
    return fit(features[kept], [x for x, k in zip(found["lang"], kept) if k], settings)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, ambiguous) per row of ``docs``.

    A null text, or one without a letter, is ``und`` with score 0, as is every text if the model has no language. Repeated
    rows and null ids are kept; other columns are left out; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [t if model.languages and has_letter(t) else None for t in batch.column(1).to_pylist()]
                known = [i for i, t in enumerate(texts) if t is not None]
                names, scores, flags = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
                if known:
                    best, first, close = decode(np.stack([ngram_counts(texts[i], model.settings.hash_bits) for i in known]), model)
                    for i, b, s, c in zip(known, best.tolist(), first.tolist(), close.tolist()):
                        names[i], scores[i], flags[i] = model.languages[b], s, c
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_())], ["id", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, f"id {sql_type(docs, id_col)}, lang_pred string, score double, ambiguous boolean")


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs, ~is_fold(F.col("doc_id"), 4, 2))
    return identify(docs, model).select(F.col("id").alias("doc_id"), is_fold(F.col("id"), 4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")


QUERIES = {"op3_language_id": op3_language_id}
ORACLE_SQL: dict[str, str] = {}
