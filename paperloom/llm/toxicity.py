"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each counted once however often it occurs: its words (runs of letters, digits
and non-ASCII characters, lower case), the first 4 to 9 bytes of each (languages that build words
from stems), neighbouring pairs, and pairs with one or two words between. All are hashed to SIZE
slots. The fit keeps a learning rate for every coordinate and sets a coordinate to zero unless its
gradients outweigh L1, so that what is broadcast is the few slots that speak for or against.

The classifier is fitted on a bounded sample of labelled texts, ``TOXIC_ROWS`` toxic and
``CLEAN_ROWS`` others of least hash of their id, each different text once; the share of toxic
labels among all is put back into the intercept. Slots that fewer than ``LEAST_DOCS`` toxic texts
of the sample have don't count. Everything else covers all rows and whole texts.

Null and empty texts, and texts without a word, score what the intercept says. Labels that repeat
for a document count as toxic if one is; null labels and null ids don't count. Without toxic and
clean labels the score is the share of toxic ones (0 without any). Rows without an id are not held
out. Only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import chunks, list_array, mix, raw, spans_of, text_array, unused

#: Hash slots; labelled texts that the model is fitted on; toxic ones that must have a slot; slots at most.
SIZE, TOXIC_ROWS, CLEAN_ROWS, LEAST_DOCS, VOCABULARY = 1 << 24, 3_000, 5_000, 3, 1 << 18
#: FTRL: learning rate, its damping, penalties, and passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 1.0, 1.0, 3.0, 0.5, 4
#: A text is toxic from this score on.
LEAST_SCORE = 0.3
#: Bytes of a word's beginnings, places between the words of a pair, words worked on at a time.
STEMS, GAPS, BLOCK_WORDS = (4, 5, 6, 7, 8, 9), (1, 2, 3), 1 << 17
LETTERS = bytes(x if chr(x).isalnum() or x >= 128 else 32 for x in range(256))
PRIME = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of PRIME and of its inverse, wrapping."""
    up = np.full(n, PRIME)
    down = np.full(n, np.uint64(pow(int(PRIME), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _slots(codes: np.ndarray, kind: int) -> np.ndarray:
    return (mix(codes + np.uint64(kind * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - SIZE.bit_length() + 1)).astype(np.int32)


def slots_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, slot) of the features of a string array, block by block; a feature may come repeatedly."""
    data, at = raw(pc.utf8_lower(text_array(column)))
    plain = np.frombuffer(data.tobytes().translate(LETTERS), np.uint8)
    if not len(plain):
        return
    starts, ends = spans_of(plain != 32, at)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(starts, at)))
    ahead = max(GAPS)
    for first in range(0, len(starts), BLOCK_WORDS):
        last = min(len(starts), first + BLOCK_WORDS)
        reach = min(len(starts), last + ahead)  # pairs that begin in the block may end behind it
        s, e, own = starts[first:reach], ends[first:reach], owner[first:reach]
        low = s[0]
        part = plain[low : e[-1]].astype(np.uint64) + np.uint64(1)
        room = max(1 << 20, 1 << int(len(part)).bit_length())
        up, down = _powers(room)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up[: len(part)])])
        s, e = s - low, e - low
        base, back = total[s], down[s]
        codes = mix((total[e] - base) * back)
        n = last - first
        yield own[:n], _slots(codes[:n], 0)
        for k in STEMS:
            long = np.flatnonzero(e[:n] - s[:n] >= k)
            yield own[long], _slots((total[s[long] + k] - base[long]) * back[long], k)
        for gap in GAPS:
            m = min(n, len(s) - gap)
            if m > 0:
                same = np.flatnonzero(own[:m] == own[gap : gap + m])
                yield own[same], _slots(codes[same] * PRIME + codes[same + gap], 16 + gap)


@dataclass
class ToxicModel:
    """Sorted slots, their weights, and the intercept."""

    slots: np.ndarray
    weights: np.ndarray
    intercept: float

    def known(self) -> np.ndarray:
        held = np.zeros(SIZE, bool)
        held[self.slots] = True
        return held

    def scores(self, column: pa.Array, known: np.ndarray) -> np.ndarray:
        found = [np.zeros(0, np.int64)]
        for own, slots in slots_of(column):
            hit = np.flatnonzero(known[slots])
            found.append(np.unique(own[hit].astype(np.int64) << 32 | slots[hit]))
        found = np.unique(np.concatenate(found))
        weight = self.weights[np.searchsorted(self.slots, found & 0xFFFFFFFF)] if len(found) else np.zeros(0)
        return sigmoid(self.intercept + np.bincount(found >> 32, weight, len(column)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ftrl(texts: list[np.ndarray], toxic: np.ndarray, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights of ``size`` coordinates and the intercept, from each text's coordinates, in the order given.

    For a coordinate, z gathers gradients less what the weight has moved, n their squares; its weight
    is 0 while abs(z) <= l1, else (sign(z) l1 - z) / ((beta + sqrt(n)) / alpha + l2). The intercept
    is a coordinate without penalties.
    """
    z, n = np.zeros(size), np.zeros(size)
    z0 = n0 = 0.0
    for _ in range(passes):
        for own, y in zip(texts, toxic.tolist(), strict=True):
            zi, root = z[own], np.sqrt(n[own])
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + root) / alpha + l2))
            w0 = -z0 / ((beta + n0**0.5) / alpha)
            g = float(sigmoid(np.array(w.sum() + w0))) - y
            n[own] += g * g
            z[own] = zi + g - (np.sqrt(n[own]) - root) / alpha * w
            z0 += g - ((n0 + g * g) ** 0.5 - n0**0.5) / alpha * w0
            n0 += g * g
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2)), -z0 / ((beta + n0**0.5) / alpha)


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are not learned: crc32 of the id as text leaves 2 over 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned(labels: DataFrame) -> DataFrame:
    """label_id, toxic (0 or 1) of the documents whose labels may be learned."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    return known.groupBy(F.col("doc_id").cast("bigint").alias("label_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> ToxicModel:
    """A model fitted on the labels that may be learned. See the module for its bounds."""
    known = learned(labels)
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    n, t = sum(counts.values()), counts.get(1, 0)
    if t in (0, n):
        return ToxicModel(np.zeros(0, np.int64), np.zeros(0), 40.0 if t else -40.0)
    ranked = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("label_id"), "label_id").limit(rows) for y, rows in ((1, toxic_rows), (0, clean_rows))]
    # at most toxic_rows + clean_rows rows of 12 bytes are broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(ranked[0].unionByName(ranked[1])), F.col("doc_id").cast("bigint") == F.col("label_id"))
    sample = sample.select("text", "toxic", "label_id").where(F.col("text").isNotNull())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in chunks(batches):
            pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.unique(o.astype(np.int64) << 32 | s) for o, s in slots_of(batch.column(0)))]))
            held.append(np.unique(pairs & 0xFFFFFFFF, return_counts=True))
            if len(held) > 15:
                held = [_summed(held)]
        slots, times = _summed(held)
        for a in range(0, len(slots), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(slots[a : a + (1 << 16)].astype(np.int32)), pa.array(times[a : a + (1 << 16)])], names=["slot", "n"])

    often = sample.where("toxic = 1").select("text").mapInArrow(counted, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCS)
    vocabulary = np.sort(often.orderBy(F.desc("n"), "slot").limit(VOCABULARY).select("slot").toArrow().column(0).to_numpy().astype(np.int64))
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)  # VOCABULARY numbers at most

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = held.value, np.zeros(SIZE, bool)
        known[words] = True
        for batch in chunks(batches):
            pairs = [np.zeros(0, np.int64)]
            for own, slots in slots_of(batch.column(0)):
                hit = np.flatnonzero(known[slots])
                pairs.append(np.unique(own[hit].astype(np.int64) << 32 | slots[hit]))
            pairs = np.unique(np.concatenate(pairs))
            lists = list_array(np.searchsorted(words, pairs & 0xFFFFFFFF), np.bincount(pairs >> 32, minlength=batch.num_rows), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), lists], names=["toxic", "label_id", "same", "ids"])

    got = sample.select("text", "toxic", "label_id", F.xxhash64("text").alias("same")).mapInArrow(taken, "toxic int, label_id bigint, same bigint, ids array<int>").toArrow().combine_chunks()
    labels_of, ids, same = (got[k].to_numpy() for k in ("toxic", "label_id", "same"))
    order = np.argsort(mix(ids.astype(np.uint64)), kind="stable")
    order = order[np.sort(np.unique(same[order], return_index=True)[1])]  # each text once
    lists = got["ids"].combine_chunks()
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    y = labels_of[order].astype(np.float64)
    weights, intercept = fit_ftrl([flat[at[k] : at[k + 1]] for k in order.tolist()], y, len(vocabulary))
    if 0 < y.sum() < len(y):
        intercept += np.log(t / (n - t)) - np.log(y.sum() / (len(y) - y.sum()))
    used = np.flatnonzero(weights)
    return ToxicModel(vocabulary[used], weights[used], float(intercept))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    slots, where = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    return slots, np.bincount(where, np.concatenate([n for _, n in parts]), len(slots)).astype(np.int64)


def scored(docs: DataFrame, model: ToxicModel, name: str = "score") -> DataFrame:
    """``docs`` with the model's score of each whole text in a column ``name``, replaced if it is there."""
    plain = docs.drop(name)
    renamed = plain.toDF(*[f"c{k}" for k in range(len(plain.columns))])
    at = plain.columns.index("text")
    schema = T.StructType([*renamed.schema.fields, T.StructField(unused(renamed.columns, "score"), T.DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most VOCABULARY slots and weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        known = model.known()
        for batch in chunks(batches, f"c{at}"):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(batch.column(at), known))], names=schema.names)

    return renamed.mapInArrow(run, schema).toDF(*plain.columns, name)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from LEAST_SCORE on)."""
    score = F.col("score")
    return scored(docs.select("doc_id", "text"), fit(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (score >= LEAST_SCORE).cast("int").alias("predicted"))
