"""Positive-unlabelled learning with the non-negative risk estimator, for toxicity and for quality.

Training sees trusted positives and unlabelled text. With class prior p, the risk on negatives is what the unlabelled rows
would cost as negatives less p times what the positives would; it cannot truly be negative, so where it falls below zero the
step undoes it instead (the non-negative estimator). A linear model with logistic loss is fitted in numpy on a bounded sample;
scoring is one pass over all rows.

Bounds: at most ``positives`` trusted and ``unlabelled`` other ids are sampled, by a hash of the id, so the sample does not
depend on how the rows are dealt; an id that repeats counts once. Their whole texts count. Features are chosen on the sample: at most ``features`` whose share
among the positives differs clearly from that among the unlabelled rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormlane.llm.common import is_fold, map_arrow, sql_type, table

#: Signs that are taken off both ends of a word.
_EDGES = ".,;:!?\"'()[]{}<>|#$%&*+=-_/\\~^`@0123456789"
_MEMO = 150_000


class _Memo(dict):
    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= 64:
            if len(self) >= _MEMO:
                self.clear()
            self[key] = value
        return value


def _id(kind: str, value: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}\t{value}".encode("utf-8", "replace")) >> 1


def word_features(word: str) -> tuple[int, ...]:
    """A word without its edges."""
    word = word.strip(_EDGES)
    return (_id("w", word),) if word else ()


def toxicity_features(text: str | None, known: Callable[[str], tuple[int, ...]]) -> set[int]:
    """Which words a lower-cased text has; how often does not matter, so long texts are not diluted."""
    return set(chain.from_iterable(map(known, set((text or "").lower().split()))))


def _bin(name: str, share: float) -> int:
    return _id("s", f"{name}:{min(9, int(share * 10))}")


_COUNTED = {"upper": bytes(range(65, 91)), "digit": b"0123456789", "mark": b"#$%&*@^~<>{}[]=+\\_", "bar": b"|", "shout": b"!", "stop": b".,;:?"}


def quality_features(text: str | None, known: Callable[[str], tuple[int, ...]]) -> set[int]:
    """Shape of a text: shares of sign classes, of repeated words and lines, of bare signs; and the endings of its words."""
    text = text or ""
    raw, words, lines = text.encode("utf-8", "replace"), text.split(), text.split("\n")
    out = set(chain.from_iterable(map(known, set(words))))
    letters = max(1, len(raw))
    for name, signs in _COUNTED.items():
        share = (len(raw) - len(raw.translate(None, signs))) / letters
        out.add(_bin(name, share))
        out.add(_bin(f"{name} fine", min(1.0, share * 10)))
    n = max(1, len(words))
    again = sum(map(eq, words, words[1:])) / n
    out |= {_bin("repeat", again), _bin("repeat fine", min(1.0, again * 10)), _bin("word variety", len(set(words)) / n), _bin("line variety", len(set(lines)) / len(lines)), _bin("words", min(1.0, len(words).bit_length() / 20)), _bin("word length", min(1.0, len(text) / n / 20)), _bin("upper words", sum(map(str.isupper, words)) / n)}
    return out


def ending_features(word: str) -> tuple[int, ...]:
    """What stands behind the last letter of a word, or the word itself if it has none."""
    tail = word[len(word.rstrip("!#$%&*|.,;:?@^~+=_-")) :]
    return (_id("e", tail[-4:]),) if tail else ()


@dataclass(frozen=True)
class Task:
    """What to learn: the features, and the bounds of the sample and of the model."""

    features_of: Callable
    per_word: Callable
    positives: int = 3000
    unlabelled: int = 6000
    features: int = 4000
    least_rows: int = 5
    least_z: float = 4.5
    steps: int = 600
    rate: float = 0.1
    decay: float = 1e-4
    #: The prior is kept within these, so a degenerate sample can't make the risk meaningless.
    prior_range: tuple[float, float] = field(default=(0.005, 0.995))


TOXICITY = Task(toxicity_features, word_features)
#: Unlabelled text is mostly good, so the few bad rows need a larger sample; its features are few.
QUALITY = Task(quality_features, ending_features, positives=10_000, unlabelled=20_000, least_z=2.0)


@dataclass(frozen=True)
class Model:
    ids: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float


def _matrix(rows: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column numbers of the chosen features, row by row, and how many each row has."""
    kept = [np.searchsorted(ids, r[np.isin(r, ids, assume_unique=True)]) for r in rows]
    return np.concatenate(kept).astype(np.int64), np.array([len(k) for k in kept])


def choose_features(positive: list[np.ndarray], unlabelled: list[np.ndarray], task: Task) -> np.ndarray:
    """Features whose shares differ by ``least_z`` standard errors, most telling first up to the bound; sorted by id."""
    flat = lambda rows: np.unique(np.concatenate(rows), return_counts=True) if rows else (np.empty(0, np.int64), np.empty(0, int))
    (a, na), (b, nb) = flat(positive), flat(unlabelled)
    ids = np.union1d(a, b)
    in_p, in_u = np.zeros(len(ids)), np.zeros(len(ids))
    in_p[np.searchsorted(ids, a)], in_u[np.searchsorted(ids, b)] = na, nb
    p, u = max(1, len(positive)), max(1, len(unlabelled))
    share = (in_p + in_u) / (p + u)
    z = np.abs(in_p / p - in_u / u) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / p + 1 / u))
    good = np.flatnonzero((in_p + in_u >= task.least_rows) & (z >= task.least_z))
    return np.sort(ids[good[np.argsort(-z[good], kind="stable")][: task.features]])


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, task: Task) -> Model:
    """Minimises prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) by Adam over all sampled rows."""
    prior = float(np.clip(prior, *task.prior_range))
    ids = choose_features(positive, unlabelled, task)
    n_p, n = len(positive), len(positive) + len(unlabelled)
    w, bias = np.zeros(len(ids)), float(np.log(prior / (1 - prior)))
    if not n_p or n_p == n:
        return Model(ids, w, bias, prior)
    columns, sizes = _matrix(positive + unlabelled, ids)
    owner = np.repeat(np.arange(n), sizes)
    m, v = np.zeros(len(ids) + 1), np.zeros(len(ids) + 1)
    for step in range(1, task.steps + 1):
        logit = bias + np.bincount(owner, weights=w[columns], minlength=n)
        s = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        as_positive, as_negative = s - 1, s  # slopes of the losses log(1+e^-x) and log(1+e^x)
        negative_risk = np.logaddexp(0, logit[n_p:]).mean() - prior * np.logaddexp(0, logit[:n_p]).mean()
        slope = np.zeros(n)
        sign = 1.0 if negative_risk >= 0 else -1.0
        slope[:n_p] = ((prior * as_positive[:n_p] if sign > 0 else 0) - sign * prior * as_negative[:n_p]) / n_p
        slope[n_p:] = sign * as_negative[n_p:] / (n - n_p)
        gradient = np.concatenate([np.bincount(columns, weights=slope[owner], minlength=len(ids)) + task.decay * w, [slope.sum()]])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = task.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(ids, w, float(bias), prior)


def _feature_rows(docs: DataFrame, task: Task) -> DataFrame:
    """(id, sorted feature ids) of each row of (id, text)."""

    def run(batches):
        known = _Memo(task.per_word).__getitem__
        for batch in batches:
            rows = [sorted(task.features_of(t.as_py(), known)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int64()))], ["features"])

    return map_arrow(docs.select("id", "text"), run, "features array<bigint>")


def _sampled(docs: DataFrame, ids: DataFrame, task: Task) -> list[np.ndarray]:
    """Features of one row of each of the given ids, of which there are as many as the sample's bound at most; of an id's texts
    the least by its hash."""
    one = docs.join(F.broadcast(ids), "id", "left_semi").groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    found = _feature_rows(one.select("id", "least.text"), task).toArrow().column("features").combine_chunks()
    return [np.asarray(x, dtype=np.int64) for x in np.split(found.values.to_numpy(), found.offsets.to_numpy()[1:-1])] if len(found) else []


def train(docs: DataFrame, labels: DataFrame, label: str, usable: Callable[[Column], Column], task: Task, prior: float | None = None) -> Model:
    """A model of ``label``, from docs (id, text) and labels (id and the 0/1 column ``label``) whose ids are ``usable``.

    Null ids, null labels and labels without a document teach nothing; an id with several labels counts as its largest. The
    prior, unless given, is the share of ones among the usable labels. That is an unbiased estimate only where labels were
    given without regard to what they say; where ones were labelled more eagerly than zeros it is too high, and scores with it.
    Without positives the model is the prior alone. The hashes of the distinct words of at most ``positives`` and
    ``unlabelled`` texts go to the driver, eight bytes each.
    """
    known = labels.where(F.col("id").isNotNull() & F.col(label).isNotNull() & usable(F.col("id"))).groupBy("id").agg(F.max(label).alias("label"))
    known = known.join(docs.where("text is not null").select("id").distinct(), "id", "left_semi")
    if prior is None:
        prior = known.agg(F.avg(F.col("label").cast("double"))).first()[0] or 0.0
    few = lambda df, n: df.select("id").distinct().orderBy(F.xxhash64(F.lit(label), "id"), "id").limit(n)
    trusted = few(known.where("label = 1"), task.positives)
    others = few(docs.where(F.col("id").isNotNull() & F.col("text").isNotNull() & usable(F.col("id"))), task.unlabelled)
    some = docs.where("text is not null")
    return fit(_sampled(some, trusted, task), _sampled(some, others, task), prior, task)


def scores_in(batch_texts, model: Model, task: Task, known) -> np.ndarray:
    weight = dict(zip(model.ids.tolist(), model.weights.tolist()))
    get = weight.get
    logits = np.array([model.bias + sum(get(i, 0.0) for i in sorted(task.features_of(t.as_py(), known))) for t in batch_texts], dtype=np.float64)
    return 1 / (1 + np.exp(-np.clip(logits, -40, 40)))


def _chosen_only(model: Model, task: Task):
    """Features per word, of those the model has."""
    chosen = set(model.ids.tolist())
    return _Memo(lambda word: tuple(i for i in task.per_word(word) if i in chosen)).__getitem__


def score(docs: DataFrame, model: Model, task: Task, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row of ``docs``. Null and empty texts get the score of a text without words; repeated rows and null ids
    are kept; other columns are left out; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = _chosen_only(shared.value, task)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores_in(batch.column(1), shared.value, task, known))], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, f"id {sql_type(docs, id_col)}, score double")


def keep_below(docs: DataFrame, model: Model, task: Task, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with all their columns as they are.

    Texts without words, nulls included, stay whatever the model says of them. Repeated rows are judged alike; an empty table
    gives no rows; columns of any other name are carried along.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        known = _chosen_only(shared.value, task)
        for batch in batches:
            wordless = np.array([not (t.as_py() or "").strip() for t in batch.column(at)], dtype=bool)
            yield batch.filter(pa.array(wordless | (scores_in(batch.column(at), shared.value, task, known) < threshold)))

    return map_arrow(docs, run, docs.schema)


def _train_on(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, task: Task) -> Model:
    known = labels.select(F.col("doc_id").alias("id"), F.col(label))
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    return train(rows, known, label, lambda i: ~is_fold(i, folds, held_out), task)


def toxicity_model(docs: DataFrame, labels: DataFrame, task: Task = TOXICITY) -> Model:
    """Learnt from the labels whose crc32(id) mod 5 is not 0."""
    return _train_on(docs, labels, "toxic", 5, 0, task)


def quality_model(docs: DataFrame, labels: DataFrame, task: Task = QUALITY) -> Model:
    """Learnt from the labels whose crc32(id) mod 3 is not 1."""
    return _train_on(docs, labels, "quality", 3, 1, task)


def _scored(docs: DataFrame, model: Model, task: Task, folds: int, held_out: int) -> DataFrame:
    return score(docs, model, task).select(F.col("id").alias("doc_id"), is_fold(F.col("id"), folds, held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return _scored(docs, toxicity_model(docs, table(spark, sf_dir, "labels")), TOXICITY, 5, 0)


def op10_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return _scored(docs, quality_model(docs, table(spark, sf_dir, "labels")), QUALITY, 3, 1)


QUERIES = {"op7_toxicity": op7_toxicity, "op10_quality_classifier": op10_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
