"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are 0 .. K-1. P(grade <= k) = sigmoid(threshold_k - x . w): one weight vector over hashed
text features is shared, and the ordered thresholds cut its score into grades. A text's expected
grade and the probability of a grade of at least ``select_grade`` come from the same score.

Features of a word: its core (lower case, outer punctuation off), the core's first 4 and 5
characters, its shape (letter case, digits, punctuation), and whether it repeats the word before.
They are counted over the whole text and divided by the root of its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import SPACES, chunks, raw, words

#: Hashed features; labelled rows that the model is fitted on (those of least hash of their id).
SIZE, FIT_ROWS = 1 << 18, 6_000
#: Documents a feature must be in to count, the penalty, most steps of the fit, and the features' scale.
LEAST_DOCS, PENALTY, STEPS, SCALE = 20, 2e-4, 100, 2.0
#: Grades: 0 toxic, 1 of low quality, 2 good. Documents go unless P(grade >= 2) is at least a half.
GRADES, SELECT_GRADE, LEAST_PROBABILITY = 3, 2, 0.5
MEMORY_WORDS = 100_000
OUTER = ".,;:!?\"'()[]*#$%&|"
RUNS = re.compile(r"(.)\1+")
KINDS = 4


def _hash(x: str) -> int:
    return xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) % SIZE


REPEAT = _hash("repeat")


def word_features(word: str) -> tuple[int, int, int, int]:
    core = word.lower().strip(OUTER)
    shape = RUNS.sub(r"\1", "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in word))
    return _hash("w" + core), _hash("p" + core[:4]), _hash("q" + core[:5]), _hash("s" + shape)


@lru_cache(maxsize=MEMORY_WORDS)
def known_features(word: bytes) -> tuple[int, int, int, int]:
    return word_features(word.decode())


def _repeats(which: np.ndarray, first: np.ndarray) -> np.ndarray:
    """1 for each word that equals the one before it in its text."""
    same = np.zeros(len(which), np.int64)
    same[1:] = which[1:] == which[:-1]
    heads = first[first < len(which)]
    same[heads] = 0
    return same


def _coded(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    data, at = raw(batch.column(column))
    _, _, first, found = words(data, at, SPACES)
    coded = found.dictionary_encode() if len(found) else pa.array([], pa.binary()).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), first, coded.dictionary.to_pylist()


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade = k) in column k."""
        below = _sigmoid(self.thresholds[None, :] - score[:, None])
        return np.diff(np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], 1), axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(rows: np.ndarray, features: np.ndarray, values: np.ndarray, grades: np.ndarray, n_grades: int = GRADES, size: int = SIZE, penalty: float = PENALTY, steps: int = STEPS) -> OrdinalModel:
    """Penalised maximum likelihood by L-BFGS over the weights and the thresholds' first value and log gaps."""
    n = len(grades)
    used, features = np.unique(features, return_inverse=True)
    k = len(used)
    at = np.arange(n)

    def cuts_of(x: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate([x[k : k + 1], np.exp(np.clip(x[k + 1 :], -10, 10))]))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        cuts = cuts_of(x)
        score = np.bincount(rows, values * x[features], n)
        below = np.concatenate([np.zeros((n, 1)), _sigmoid(cuts[None, :] - score[:, None]), np.ones((n, 1))], 1)
        slope = below * (1 - below)
        p = np.clip(below[at, grades + 1] - below[at, grades], 1e-12, 1)
        by_score = (slope[at, grades + 1] - slope[at, grades]) / p / n
        by_cut = np.array([(np.where(grades == c, -slope[:, c + 1], 0) + np.where(grades == c + 1, slope[:, c + 1], 0)) @ (1 / p) / n for c in range(len(cuts))])
        tail = np.cumsum(by_cut[::-1])[::-1]  # what a gap moves: all thresholds after it
        tail[1:] *= np.diff(cuts)
        g = np.concatenate([np.bincount(features, values * by_score[rows], k) + penalty * x[:k], tail])
        return float(-np.log(p).mean() + penalty / 2 * x[:k] @ x[:k]), g

    shares = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / max(1, n), 1e-3, 1 - 1e-3)
    first = np.log(shares / (1 - shares))
    x = np.concatenate([np.zeros(k), first[:1], np.log(np.maximum(np.diff(first), 0.05))])
    now, g = loss(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, held = g.copy(), []
        for s, t in reversed(pairs):
            held.append((s @ d) / (s @ t))
            d -= held[-1] * t
        if pairs:
            s, t = pairs[-1]
            d *= (s @ t) / (t @ t)
        else:
            d /= max(1.0, float(np.abs(d).max()))
        for (s, t), a in zip(pairs, reversed(held), strict=True):
            d += (a - (t @ d) / (s @ t)) * s
        pace = 1.0
        while pace > 1e-8:
            to, g_to = loss(x - pace * d)
            if to <= now - 1e-4 * pace * (g @ d):
                break
            pace /= 2
        else:
            break
        s, t = -pace * d, g_to - g
        if s @ t > 1e-12:
            pairs = [*pairs[-7:], (s, t)]
        done = now - to < 1e-7 * max(1.0, abs(now))
        x, now, g = x + s, to, g_to
        if done:
            break
    weights = np.zeros(size, np.float32)
    weights[used] = x[:k]
    return OrdinalModel(weights, cuts_of(x))


def graded(labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """label_id, grade of at most ``rows`` labelled documents: those with the least hash of their id.

    Repeated labels of a document count as the worst of them; rows without an id or a quality don't
    count, a null toxic is 0.
    """
    worst = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("label_id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    grade = F.when(F.col("t") > 0, 0).when(F.col("q") <= 0, 1).otherwise(2)
    return worst.select("label_id", grade.alias("grade")).orderBy(F.xxhash64("label_id"), "label_id").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, n_grades: int = GRADES) -> OrdinalModel:
    """A model fitted on the labelled documents. Without any, it takes all for the highest grade."""
    # at most `rows` rows of 12 bytes are broadcast, and as many documents' counts come to the driver
    some = docs.select("doc_id", "text").join(F.broadcast(graded(labels, rows)), F.col("doc_id").cast("bigint") == F.col("label_id"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            which, first, found = _coded(batch, 0)
            table = np.array([known_features(x) for x in found], np.int32).reshape(-1, KINDS)
            same = _repeats(which, first)
            ids, counts = [], []
            for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
                x, n = np.unique(np.append(table[which[a:b]].ravel(), np.full(same[a:b].sum(), REPEAT, np.int32)), return_counts=True)
                ids.append(x.astype(np.int32))
                counts.append(n.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.diff(first), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["grade", "n", "ids", "counts"])

    got = some.select("text", "grade").mapInArrow(counted, "grade int, n bigint, ids array<int>, counts array<int>").toArrow().combine_chunks()
    grades = got["grade"].to_numpy().astype(np.int64)
    if not len(grades) or len(np.unique(grades)) < 2:
        return OrdinalModel(np.zeros(SIZE, np.float32), np.linspace(-9.0, -8.0, n_grades - 1))
    sizes = got["ids"].combine_chunks().value_lengths().to_numpy()
    ids, counts = (got[k].combine_chunks().flatten().to_numpy() for k in ("ids", "counts"))
    owner = np.repeat(np.arange(len(grades)), sizes)
    keep = (np.bincount(ids, minlength=SIZE) >= min(LEAST_DOCS, max(2, len(grades) // 50)))[ids]
    values = SCALE * counts[keep] / np.sqrt(np.maximum(1, got["n"].to_numpy()))[owner[keep]]
    return fit_ordinal(owner[keep], ids[keep], values, grades, n_grades)


def scored(docs: DataFrame, model: OrdinalModel, select_grade: int = SELECT_GRADE) -> DataFrame:
    """``docs`` with expected_grade and tail_probability, P(grade >= select_grade); replaced if there.

    Texts without a word, null ones too, have a score of 0: what the thresholds alone say.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # SIZE floats
    plain = docs.drop("expected_grade", "tail_probability")
    renamed = plain.toDF(*[f"c{k}" for k in range(len(plain.columns))])
    at = plain.columns.index("text")
    schema = T.StructType([*renamed.schema.fields, T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in chunks(batches, f"c{at}"):
            which, first, found = _coded(batch, at)
            table = np.array([known_features(x) for x in found], np.int64).reshape(-1, KINDS)
            own = model.weights[table].sum(axis=1, dtype=np.float64)
            total = np.concatenate([[0.0], np.cumsum(own[which] + float(model.weights[REPEAT]) * _repeats(which, first))])
            score = SCALE * (total[first[1:]] - total[first[:-1]]) / np.sqrt(np.maximum(1, np.diff(first)))
            p = model.probabilities(score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p @ np.arange(p.shape[1])), pa.array(p[:, select_grade:].sum(axis=1))], names=schema.names)

    return renamed.mapInArrow(run, schema).toDF(*plain.columns, "expected_grade", "tail_probability")


def selected(least: float = LEAST_PROBABILITY) -> Column:
    return F.col("tail_probability") >= least


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier fitted on ``labels`` accepts, columns as they were."""
    names = docs.columns
    renamed = docs.toDF(*[n if n in ("doc_id", "text") else f"own{k}" for k, n in enumerate(names)])
    return scored(renamed, fit(docs, labels)).where(selected()).drop("expected_grade", "tail_probability").toDF(*names)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, expected_grade, tail_probability, keep."""
    return scored(docs.select("doc_id", "text"), fit(docs, labels)).select("doc_id", "expected_grade", "tail_probability", selected().alias("keep"))
