"""Hard negatives: rotated one-bit codes, intervals that can't be wrong, integer scores for what is left.

A vector's components become integers, ``floor(256 * x)``. Its code has LEVELS levels: turn what is
left of the vector by a fixed random rotation, keep the signs as bits, store the alignment of the
vector with the signs' unit vector, take that part off, and go on with the rest; the length of the
last rest is stored too. A query turned alike and rounded to QUERY_BITS bits a component meets the
bits by population counts of its bit planes; with the alignments that estimates the inner product,
and by Cauchy and Schwarz the rest and the rounding can't move it by more than their lengths. So the
interval is certain: only rows whose interval reaches into what is asked for are scored, exactly, in
integers. No candidate is lost.

Anchors are dealt into groups of bounded size by a hash; a group is broadcast and meets all rows
where they lie, first those of its label (positives), then the others (negatives). Each task hands
on its own first few for an anchor, so what is shuffled is top lists. There is no index and no limit
on candidates: results are exact.

Rows without a label or a vector, with a null, non-finite or empty vector, or a component that
passes 31 bits as an integer take no part. Rows meet rows of the same length. Rows with the
anchor's own id aren't other rows. Equal rows are one anchor, but count each as positives and
negatives; rows without an id are no anchors and come last among ties. An empty table gives no rows;
other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import checkpointed

#: Levels of a code, bits of a query's component, and the seed of the rotation.
LEVELS, QUERY_BITS, SEED = 5, 7, 20_250
#: Components of anchors in a group (8 MB at most are broadcast), and the pairs worked on at a time.
GROUP_COMPONENTS, PAIR_ROWS, PAIR_ANCHORS, FIRST_ROWS = 1 << 20, 1024, 1024, 128
#: What is asked for: positives of an anchor, negatives of a positive, and the band of scores in hundredths.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
MOST = float(1 << 31)


@lru_cache(maxsize=8)
def rotation(d: int) -> np.ndarray:
    """A fixed random rotation of d dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


@dataclass
class Codes:
    """Codes of n vectors: bits (levels, words, n), alignments (levels, n) and the last rest's length (n)."""

    bits: np.ndarray
    align: np.ndarray
    rest: np.ndarray

    def cut(self, at: slice | np.ndarray) -> "Codes":
        return Codes(self.bits[:, :, at], self.align[:, at], self.rest[at])


def _packed(on: np.ndarray) -> np.ndarray:
    """(words, n) of n rows of bits."""
    n, d = on.shape
    wide = np.zeros((n, -(-d // 64) * 64), np.uint8)
    wide[:, :d] = on
    return np.ascontiguousarray(np.packbits(wide, axis=1, bitorder="little").view("<u8").T)


def encode(vectors: np.ndarray, levels: int = LEVELS) -> Codes:
    turn, left = rotation(vectors.shape[1]), vectors.astype(np.float64)
    root = np.sqrt(vectors.shape[1])
    bits, align = [], []
    for _ in range(levels):
        left = left @ turn
        on = left >= 0
        along = np.abs(left).sum(axis=1) / root
        left = left - (along / root)[:, None] * np.where(on, 1.0, -1.0)
        bits.append(_packed(on))
        align.append(along)
    return Codes(np.array(bits), np.array(align), np.linalg.norm(left, axis=1))


class Queries:
    """Anchors turned for every level and rounded to bit planes."""

    def __init__(self, vectors: np.ndarray, levels: int = LEVELS, bits: int = QUERY_BITS) -> None:
        turn, at = rotation(vectors.shape[1]), vectors.astype(np.float64)
        self.norm = np.linalg.norm(at, axis=1)
        self.root, self.levels = np.sqrt(vectors.shape[1]), []
        for _ in range(levels):
            at = at @ turn
            low = at.min(axis=1)
            step = np.maximum((at.max(axis=1) - low) / ((1 << bits) - 1), 1e-30)
            unit = np.rint((at - low[:, None]) / step[:, None]).astype(np.int64)
            near = low[:, None] + step[:, None] * unit
            self.levels.append(([_packed((unit >> j) & 1) for j in range(bits)], low, step, near.sum(axis=1), np.linalg.norm(at - near, axis=1)))

    def interval(self, anchors: slice | np.ndarray, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of anchors and rows, and how far off each can be."""
        off = self.norm[anchors][:, None] * codes.rest[None, :]
        size = off.shape
        out = np.zeros(size)
        for (planes, low, step, total, error), bits, align in zip(self.levels, codes.bits, codes.align, strict=True):
            met = np.zeros(size, np.int32)
            for j, plane in enumerate(planes):
                for word in range(len(bits)):
                    met += np.bitwise_count(plane[word][anchors][:, None] & bits[word][None, :]).astype(np.int32) << j
            ones = np.bitwise_count(bits).sum(axis=0, dtype=np.int64)
            along = 2 * (low[anchors][:, None] * ones[None, :] + step[anchors][:, None] * met) - total[anchors][:, None]
            out += along * (align / self.root)[None, :]
            off += error[anchors][:, None] * align[None, :]
        reach = np.sqrt((codes.align**2).sum(axis=0) + codes.rest**2)
        return out, off + 1e-9 * self.norm[anchors][:, None] * reach[None, :] + 1e-6


def _firsts(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, none: np.ndarray, most: int) -> np.ndarray:
    """Which rows are the first ``most`` of their owner: higher scores, then smaller ids, no id last."""
    order = np.lexsort((ids, none, -score, owner))
    own = owner[order]
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
    return order[np.arange(len(own)) - first < most]


class Tops:
    """The first few rows of each owner so far, and the score that a row must reach to matter."""

    def __init__(self, owners: int, most: int, floor: np.ndarray) -> None:
        self.most, self.least = most, floor.copy()
        self.owner = np.zeros(0, np.int64)
        self.score, self.ids, self.none = (np.zeros(0, t) for t in (np.int64, np.int64, bool))

    def add(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        if not len(owner):
            return
        o, s, i, n = (np.concatenate(x) for x in ((self.owner, owner), (self.score, score), (self.ids, ids), (self.none, none)))
        keep = _firsts(o, s, i, n, self.most)
        self.owner, self.score, self.ids, self.none = o[keep], s[keep], i[keep], n[keep]
        full = np.flatnonzero(np.bincount(self.owner, minlength=len(self.least)) >= self.most)
        worst = np.full(len(self.least), np.iinfo(np.int64).max)
        np.minimum.at(worst, self.owner, self.score)
        self.least[full] = np.maximum(self.least[full], worst[full])


@dataclass
class Anchors:
    """A group of anchors of one length."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray


def coded(embeddings: DataFrame) -> DataFrame:
    """id, label, d, vector (int32 numbers as bytes) and its code of all rows that take part."""
    label = F.when(F.col("id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label").cast("bigint"))
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("id"), "label", F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.where("label IS NOT NULL AND x IS NOT NULL AND size(x) > 0").where(~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) * 256 >= MOST - 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes, values = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
            at = np.concatenate([[0], np.cumsum(sizes)])
            for d in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == d)
                vectors = np.floor(256 * values[at[own][:, None] + np.arange(d)[None, :]]).astype(np.int32)
                codes = encode(vectors)
                raw = [vectors.astype("<i4"), np.ascontiguousarray(codes.bits.transpose(2, 0, 1)), np.ascontiguousarray(codes.align.T), codes.rest[:, None]]
                packed = [pa.array([x.tobytes() for x in part], pa.binary()) for part in raw]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)), pa.array(np.full(len(own), d, np.int32)), *packed], names=["id", "label", "d", "vector", "bits", "align", "rest"])

    return rows.select("id", label.alias("label"), "x").mapInArrow(run, "id bigint, label bigint, d int, vector binary, bits binary, align binary, rest binary")


def _joined(column: pa.Array, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _rows(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Codes]:
    """ids, which are null, labels, vectors and codes of a batch."""
    ids, none = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
    bits = np.ascontiguousarray(_joined(batch.column(4), "<u8", LEVELS, -(-d // 64)).transpose(1, 2, 0))
    codes = Codes(bits, np.ascontiguousarray(_joined(batch.column(5), "<f8", LEVELS).T), _joined(batch.column(6), "<f8", 1)[:, 0])
    return ids, none, batch.column(1).to_numpy(), _joined(batch.column(3), "<i4", d), codes


def _steps(n: int, first: bool) -> Iterator[slice]:
    """Slices of n rows, the first ones short, so that there soon is something to compare with."""
    at = 0
    while at < n:
        size = FIRST_ROWS if first and at == 0 else PAIR_ROWS
        yield slice(at, min(n, at + size))
        at += size


def _exact(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = np.empty(len(left), np.int64)
    for k in range(0, len(left), 1 << 16):
        out[k : k + (1 << 16)] = np.einsum("ij,ij->i", a[left[k : k + (1 << 16)]].astype(np.int64), b[right[k : k + (1 << 16)]].astype(np.int64))
    return out


def positives(batches: Iterator[pa.RecordBatch], anchors: Anchors, most: int) -> Tops:
    """The first rows of each anchor's own label among the batches."""
    n, d = anchors.vectors.shape
    queries, tops = Queries(anchors.vectors), Tops(n, most, np.full(n, np.iinfo(np.int64).min))
    by_label = {x: np.flatnonzero(anchors.labels == x) for x in np.unique(anchors.labels).tolist()}
    begun: set[int] = set()
    for batch in batches:
        ids, none, labels, vectors, codes = _rows(batch, d)
        for label in np.unique(labels).tolist():
            rows = np.flatnonzero(labels == label)
            own = by_label.get(label, np.zeros(0, np.int64))
            if not len(own):
                continue
            for part in _steps(len(rows), label not in begun):
                at = rows[part]
                for a in range(0, len(own), PAIR_ANCHORS):
                    which = own[a : a + PAIR_ANCHORS]
                    near, off = queries.interval(which, codes.cut(at))
                    x, y = np.nonzero(near + off >= tops.least[which][:, None])
                    x, y = which[x], at[y]
                    other = none[y] | (ids[y] != anchors.ids[x])
                    x, y = x[other], y[other]
                    tops.add(x, _exact(anchors.vectors, vectors, x, y), ids[y], none[y])
            begun.add(label)
    return tops


def negatives(batches: Iterator[pa.RecordBatch], anchors: Anchors, owner: np.ndarray, low: np.ndarray, high: np.ndarray, most: int) -> Tops:
    """The first rows of other labels whose scores lie in an ask's band; ``owner`` is an ask's anchor."""
    d = anchors.vectors.shape[1]
    used = np.unique(owner)
    queries, tops = Queries(anchors.vectors[used]), Tops(len(owner), most, low)
    asks = [np.flatnonzero(owner == a) for a in used.tolist()]
    width = max(map(len, asks), default=0)
    table = np.full((len(used), width), -1)
    for k, x in enumerate(asks):
        table[k, : len(x)] = x
    begun = False
    for batch in batches:
        ids, none, labels, vectors, codes = _rows(batch, d)
        for part in _steps(len(ids), not begun):
            for a in range(0, len(used), PAIR_ANCHORS):
                rows = slice(a, min(len(used), a + PAIR_ANCHORS))
                near, off = queries.interval(rows, codes.cut(part))
                other = labels[part][None, :] != anchors.labels[used[rows]][:, None]
                upper, lower = np.where(other, near + off, -np.inf), near - off
                scores = np.full(upper.shape, np.iinfo(np.int64).min)
                want = np.zeros(upper.shape, bool)
                masks = []
                for k in range(width):
                    ask = table[rows, k]
                    mask = (upper >= tops.least[ask][:, None]) & (lower <= high[ask][:, None]) & (ask >= 0)[:, None]
                    masks.append(mask)
                    want |= mask
                x, y = np.nonzero(want)
                scores[x, y] = _exact(anchors.vectors, vectors, used[rows][x], y + part.start)
                for k, mask in enumerate(masks):
                    x, y = np.nonzero(mask)
                    ask, score = table[rows, k][x], scores[x, y]
                    fits = (score >= tops.least[ask]) & (score <= high[ask])
                    y = y[fits] + part.start
                    tops.add(ask[fits], score[fits], ids[y], none[y])
            begun = True
    return tops


def _top_rows(tops: Tops) -> pa.RecordBatch:
    ids = pa.array(tops.ids, pa.int64(), mask=tops.none)
    return pa.RecordBatch.from_arrays([pa.array(tops.owner), pa.array(tops.score), ids], names=["owner", "score", "id"])


TOP_ROWS = "owner bigint, score bigint, id bigint"


def _first_rows(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("owner").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mined(embeddings: DataFrame, every: int = 50, positives_of: int = POSITIVES, negatives_of: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose id ``every`` divides; their positives the first ``positives_of`` other rows
    of their label; a positive's negatives the first ``negatives_of`` rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``.
    """
    spark = embeddings.sparkSession
    rows = checkpointed(coded(embeddings))
    out = None
    chosen = rows.where(F.col("id") % every == 0).select("id", "label", "d", "vector").distinct()
    for d, n in sorted((r["d"], r["n"]) for r in chosen.groupBy("d").agg(F.count("*").alias("n")).collect()):  # a row for each length
        groups = -(-n * d // GROUP_COMPONENTS)
        same = rows.where(F.col("d") == d)
        for g in range(groups):
            own = chosen.where((F.col("d") == d) & (F.pmod(F.xxhash64("id", "vector"), F.lit(groups)) == g)).select("id", "label", "vector").toArrow().combine_chunks()  # about GROUP_COMPONENTS numbers
            if not own.num_rows:
                continue
            anchors = Anchors(own["id"].to_numpy(), own["label"].to_numpy(), _joined(own["vector"].combine_chunks(), "<i4", d))
            found = checkpointed(_group(spark, same, anchors, positives_of, negatives_of, low, high))
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    return out


def _group(spark, rows: DataFrame, anchors: Anchors, positives_of: int, negatives_of: int, low: int, high: int) -> DataFrame:
    held = spark.sparkContext.broadcast(anchors)
    found = rows.mapInArrow(lambda batches: iter([_top_rows(positives(batches, held.value, positives_of))]), TOP_ROWS)
    asks = _first_rows(found, positives_of).toArrow().combine_chunks()  # positives_of rows an anchor of the group
    owner, score, ids = asks["owner"].to_numpy(), asks["score"].to_numpy(), asks["id"].combine_chunks()
    least, most = -(-score * low // 100), score * high // 100
    told = spark.sparkContext.broadcast((owner, least, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _top_rows(negatives(batches, held.value, *told.value, negatives_of))

    asked = pa.table({"owner": pa.array(np.arange(len(owner))), "anchor_id": pa.array(anchors.ids[owner], pa.int64()), "positive_id": ids.cast(pa.int64()), "positive_score": pa.array(score)})
    best = _first_rows(rows.mapInArrow(run, TOP_ROWS), negatives_of).join(F.broadcast(spark.createDataFrame(asked)), "owner")
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
