"""Document fingerprints by winnowing.

All grams of GRAM code points are hashed by a rolling hash; in each window of WINDOW neighbouring
hashes the least is chosen, the rightmost of equals, and its position kept. Two texts that share
GRAM + WINDOW - 1 code points in a row share a chosen hash; matches shorter than GRAM are noise.
A text shorter than a gram is one gram, one with fewer grams than a window is one window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import Blocks, mix

GRAM, WINDOW = 20, 24
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Documents in a block of consecutive ids.
BLOCK_DOCS = 512


def gram_hashes(points: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """32-bit hashes of all grams, polynomial in BASE: a gram's comes from those of its halves."""
    gram = min(gram, len(points))
    if not gram:
        return np.zeros(0, np.uint64)
    powers, h, n = {1: BASE}, {1: points.astype(np.uint64) + np.uint64(1)}, 1
    with np.errstate(over="ignore"):
        while 2 * n <= gram:
            h[2 * n] = h[n][:-n] * powers[n] + h[n][n:]
            powers[2 * n] = powers[n] * powers[n]
            n *= 2
        made, size = h[n], n
        for k in sorted(h, reverse=True):
            if size + k <= gram:
                m = len(points) - size - k + 1
                made = made[:m] * powers[k] + h[k][size : size + m]
                size += k
    return mix(made) >> np.uint64(32)


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) chosen, in order of position."""
    hashes = gram_hashes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), gram)
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    # the least key is the least hash and of those the rightmost
    keys = (hashes << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    width, reach = min(window, n), 1
    least = keys
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: n - width + 1], least[width - reach : width - reach + n - width + 1])
    chosen = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return (chosen >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF))).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two sorted arrays of distinct hashes; of two empty ones 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def spelled(hashes: np.ndarray) -> str:
    """Eight hex digits a hash, in order of position."""
    return hashes.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``fingerprint`` (string) and ``positions`` (array<int>), replaced if there; null is empty."""
    plain = docs.drop("fingerprint", "positions")
    renamed = plain.toDF(*[f"c{k}" for k in range(len(plain.columns))])
    at = plain.columns.index("text")
    schema = T.StructType([*renamed.schema.fields, T.StructField("fingerprint", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [winnow(t or "", gram, window) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([spelled(h) for h, _ in made], pa.string()), pa.array([p for _, p in made], pa.list_(pa.int32()))], names=schema.names)

    return renamed.mapInArrow(run, schema).toDF(*plain.columns, "fingerprint", "positions")


def edited(text: str, following: str) -> str:
    """The last quarter of the text (rounded down) gives way to as many code points of the next."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


REPORT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<int>"


def fingerprint_report(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Per document: its fingerprint, its edited text's, and its likeness to that and to the next document's.

    The next document is that of the next doc_id (nulls first; rows of equal ids by their text's
    hash), after the last one the first. Blocks of consecutive ids, as many documents each wherever
    the ids lie, are each sorted in one task; a block's first document is sent to the block before it
    as well, as the next of its last. Rows of one id, or of none and one text, are in one block. Null
    texts are empty, repeated rows are documents of their own, one document alone is its own next,
    whole texts count however long, and an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = Blocks.of(docs, block_docs)

    @F.arrow_udf("bigint")
    def block(ids: pa.Array, ties: pa.Array) -> pa.Array:
        return pa.array(blocks.number(ids, ties.to_numpy(zero_copy_only=False)), pa.int64())

    tie = F.shiftrightunsigned(F.xxhash64("text"), 32)
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0).cast("bigint")).alias("id"), "tie", F.xxhash64("text").alias("more"))
    keyed = docs.withColumn("tie", tie).withColumn("key", order).withColumn("block", block("doc_id", "tie"))
    # at most MOST_BLOCKS + NULL_BLOCKS rows, of 60 bytes
    heads = keyed.groupBy("block").agg(F.min("key").alias("head"))
    heads = heads.selectExpr("block AS head_block", "head", "coalesce(lag(block) OVER (ORDER BY block), max(block) OVER ()) AS before")
    sent = keyed.join(F.broadcast(heads), (F.col("block") == F.col("head_block")) & (F.col("key") == F.col("head")), "left")
    copies = F.when(F.col("before").isNotNull(), F.array(F.struct(F.col("block").alias("b"), F.lit(0).alias("ahead")), F.struct(F.col("before").alias("b"), F.lit(1).alias("ahead"))))
    copies = F.coalesce(copies, F.array(F.struct(F.col("block").alias("b"), F.lit(0).alias("ahead"))))
    dealt = sent.select("doc_id", "text", "key", F.explode(copies).alias("to")).select("to.b", "to.ahead", "key", "doc_id", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(parts, "b").sortWithinPartitions("b", "ahead", "key").select("b", "ahead", "doc_id", "text")
    names = [x.split()[0] for x in REPORT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row whose next document is awaited
        rows: list[list] = []

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for b, ahead, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes, positions = winnow(text, gram, window)
                own = (b, doc_id, text, hashes, np.unique(hashes), positions)
                if last is not None and last[0] == b:
                    changed = edited(last[2], text)
                    marks, _ = winnow(changed, gram, window)
                    rows.append([last[1], len(last[2]), hashlib.sha256(changed.encode()).hexdigest(), spelled(last[3]), spelled(marks), likeness(last[4], np.unique(marks)), likeness(last[4], own[4]), last[5]])
                last = None if ahead else own
            if len(rows) >= 512:
                yield flushed()
                rows = []
        if rows:
            yield flushed()

    return ordered.mapInArrow(run, REPORT)
