"""SimHash fingerprints and their links by the generalised pigeonhole principle.

Fingerprints are linked where at most ``radius`` of their 64 bits differ. The bits are grouped
into partitions, correlated bits together, and each partition i gets a threshold t_i >= -1 with
sum(t_i) = radius - partitions + 1: two linked fingerprints then differ by at most t_i bits in at
least one partition i (-1: the partition isn't probed). Dynamic programming picks the thresholds
with the least estimated cost, from a bounded sample of fingerprints. Each distinct fingerprint is
indexed under its partition values and probes the values within the threshold; what meets is
verified on all bits. Equal fingerprints are one row from the start, and buckets with many
fingerprints are probed anew by one flipped bit, where all that meet are links: no pairs are made
within a large bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import TASK_ROWS, checkpointed, chunks, raw, skew_join

RADIUS = 2
#: Words a shingle has and the seed of its hash.
SHINGLE, SEED = 3, 42
#: Distinct fingerprints that the partitions and thresholds are planned on.
SAMPLE = 2_000
#: Fingerprints in a bucket up to which its pairs are compared; larger ones are probed bit by bit.
BUCKET = 64


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    ws = text.lower().split()  # of bytes: A-Z only, and white space is 0x20 and 0x09-0x0D
    if not ws:
        return np.zeros(0, np.uint64)
    joined = b" ".join(ws)
    if len(ws) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(lengths + 1) - 1
    firsts = (ends - lengths)[: len(ws) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(firsts, ends[size - 1 :].tolist(), strict=True)], np.uint64)


#: For each byte value eight counters of 8 bits, one for each bit, packed in an integer.
SPREAD = np.array([sum(((v >> b) & 1) << (8 * b) for b in range(8)) for v in range(256)], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have bit 0, 1, ... 63 set."""
    counts = np.zeros(64, np.int64)
    for first in range(0, len(hashes), 255):  # packed counters overflow at 256
        lanes = hashes[first : first + 255].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += SPREAD[lanes].sum(axis=0, dtype=np.uint64).astype("<u8").view(np.uint8).astype(np.int64)
    return counts


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    hashes = shingle_hashes(text, size, seed)
    set_bits = bit_counts(hashes) * 2 > len(hashes)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED, text: str = "text") -> DataFrame:
    """``docs`` with ``simhash`` (bigint; null and wordless texts: 0), replaced if there."""
    out = docs.drop("simhash")
    schema = T.StructType([*out.schema.fields, T.StructField("simhash", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            data, at = raw(batch.column(batch.schema.get_field_index(text)))
            held, cuts = data.tobytes(), at.tolist()
            made = np.array([fingerprint(held[a:b], size, seed) for a, b in zip(cuts, cuts[1:], strict=False)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made.view(np.int64))], names=schema.names)

    return out.mapInArrow(run, schema)


# --- the plan: partitions and thresholds -------------------------------------------------------


def bits_of(sample: np.ndarray) -> np.ndarray:
    return np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def grouped_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of nearly equal size: each starts at a free bit and takes in those it goes with most."""
    bits = bits_of(sample).astype(np.float64)
    centred = bits - bits.mean(axis=0) if len(bits) else np.zeros((1, 64))
    spread = np.sqrt((centred**2).sum(axis=0))
    goes_with = np.abs(centred.T @ centred) / np.maximum(np.outer(spread, spread), 1e-9)
    free, out = list(range(64)), []
    for k in range(parts):
        size = -(-len(free) // (parts - k))
        group = [free.pop(0)]
        while len(group) < size:
            best = max(free, key=lambda b: (goes_with[b, group].sum(), -b))
            free.remove(best)
            group.append(best)
        out.append(sorted(group))
    return out


def allocated(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with the given sum and the least sum of ``costs[i][t_i + 1]``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for had, (cost, ts) in best.items():
            for t in range(-1, len(row) - 1):
                if (now := cost + row[t + 1]) < step.get(had + t, (float("inf"),))[0]:
                    step[had + t] = (now, [*ts, t])
        best = step
    return best[total]


def planned(sample: np.ndarray, n: int, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """Partitions and their thresholds for n distinct fingerprints, the cheapest of those tried."""
    bits, best, n = bits_of(sample), None, max(1, n)  # of none all plans would cost the same, huge ones too
    pairs = max(1.0, len(sample) * (len(sample) - 1) / 2)
    for parts in range(1, radius + 2):
        groups = grouped_bits(sample, parts)
        costs = []
        for group in groups:
            own = bits[:, group].astype(np.float32)
            apart = own @ (1 - own).T
            apart = (apart + apart.T)[np.triu_indices(len(own), 1)]
            row = [0.0]
            for t in range(radius + 1):
                keys = n * (1 + sum(comb(len(group), k) for k in range(1, t + 1)))
                near = max((apart <= t).sum() / pairs, 0.5 ** len(group) * sum(comb(len(group), k) for k in range(t + 1)))
                row.append(10.0 * keys + near * n * (n - 1) / 2)  # a row shuffled weighs as much as ten comparisons
            costs.append(row)
        cost, ts = allocated(costs, radius - parts + 1)
        if best is None or cost < best[0]:
            best = cost, [(g, t) for g, t in zip(groups, ts, strict=True) if t >= 0]
    return best[1]


# --- links and components ----------------------------------------------------------------------


def masks(group: list[int], t: int) -> list[int]:
    """What is flipped in a partition's value by up to t bits, as signed 64-bit integers."""
    out = [sum(1 << b for b in flips) for k in range(t + 1) for flips in combinations(group, k)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def links(prints: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b), a < b, that join all distinct ``simhash`` within the radius into components.

    ``prints`` has distinct simhash values and is read several times. In buckets of up to
    ``bucket`` fingerprints each verified pair is a link; in larger ones each fingerprint is linked
    to the least of those that it meets, which leaves the components as they are.
    """
    if radius not in (1, 2):
        raise ValueError("a radius of 1 or 2 is supported")
    n = prints.count()
    taken = prints.orderBy(F.xxhash64("simhash"), "simhash").limit(sample).collect()
    plan = planned(np.array([r.simhash for r in taken], np.int64).view(np.uint64), n, radius)
    indexed = probing = None
    for k, (group, t) in enumerate(plan):
        value = F.col("simhash").bitwiseAND(F.lit(signed(sum(1 << b for b in group))))
        own = prints.select(F.lit(k).alias("part"), value.alias("value"), "simhash")
        indexed = own if indexed is None else indexed.union(own)
        if t:
            flips = F.explode(F.array(*[F.lit(m) for m in masks(group, t)]))
            own = own.select("part", "simhash", "value", flips.alias("flip")).select("part", F.col("value").bitwiseXOR(F.col("flip")).alias("value"), "simhash")
        probing = own if probing is None else probing.union(own)
    sizes = indexed.groupBy("part", "value").agg(F.count("*").alias("n"))
    hot = sizes.where(F.col("n") > bucket).select("part", "value")
    hot = checkpointed(hot)
    calm_index = indexed.join(hot, ["part", "value"], "left_anti")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    met = probing.withColumnRenamed("simhash", "a").join(
        calm_index.withColumnRenamed("simhash", "b"), ["part", "value"]).where((F.col("a") < F.col("b")) & near).select("a", "b")
    crowded = indexed.join(hot, ["part", "value"], "left_semi").select("simhash")
    crowded = crowded.union(probing.join(hot, ["part", "value"], "left_semi").select("simhash")).distinct()
    return met.union(flipped_links(crowded, radius)).distinct()


def flipped_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links by flipping single bits: fingerprints that meet at a value, each within one bit of it,
    are within two of each other, and any two within two bits meet at one between them."""
    if radius == 1:
        flips = F.array(*[F.lit(signed(1 << b)) for b in range(64)])
        moved = prints.select("simhash", F.explode(flips).alias("flip")).select("simhash", F.col("simhash").bitwiseXOR(F.col("flip")).alias("at"))
        return moved.join(prints.withColumnRenamed("simhash", "at"), "at", "left_semi").where("simhash < at").select(F.col("simhash").alias("a"), F.col("at").alias("b"))
    flips = F.array(F.lit(0), *[F.lit(signed(1 << b)) for b in range(64)])
    moved = prints.select("simhash", F.explode(flips).alias("flip")).select("simhash", F.col("simhash").bitwiseXOR(F.col("flip")).alias("at"))
    met = moved.groupBy("at").agg(F.min("simhash").alias("a"), F.max("simhash").alias("most")).where("a < most")
    return moved.join(met, "at").where("a < simhash").select("a", F.col("simhash").alias("b"))


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.selectExpr("count(*)", "sum(cast(xxhash64(a, b) AS decimal(38, 0)))").first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): root is its component's least node.

    Alternating large-star and small-star steps; a round's edges are checkpointed in the shared
    folder. Each step only keeps each node's link to a smaller one, so rows never outgrow the edges.
    """
    now = checkpointed(edges.where("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct())
    summary = _summary(now)
    now = now.coalesce(max(1, -(-summary[0] // TASK_ROWS)))
    for _ in range(most_rounds):
        size = summary[0]
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = checkpointed(skew_join(both.where("b > a"), least, ["a"], 2 * size).select(F.col("m").alias("a"), "b").where("a <> b"), size)
        lower = large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
        small = checkpointed(skew_join(large, lower, ["b"], size).select("m", "a", "b"), size)
        star = small.select(F.col("m").alias("a"), "b").union(small.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        now, before = checkpointed(star, size), summary
        summary = _summary(now)
        if summary == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))


def linked(docs: DataFrame, size: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the least doc_id that links reach. Rows with a null id count in no minimum; a
    component of such rows only has a null id. Null and wordless texts have fingerprint zero and
    link like any other; repeated rows stay.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    prints = checkpointed(fingerprints(slim, size, seed).select("doc_id", "simhash"))
    distinct = checkpointed(prints.groupBy("simhash").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(links(distinct.select("simhash"), radius))
    rooted = checkpointed(distinct.join(roots.withColumnRenamed("node", "simhash"), "simhash", "left").withColumn("root", F.coalesce("root", "simhash")))
    # the component's least id, kept with every fingerprint: components may be large, so first by root
    least = checkpointed(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes")))
    total = prints.count()
    named = checkpointed(skew_join(rooted, least, ["root"], total, "nodes").select("simhash", "component_id", "n"))
    return skew_join(prints, named, ["simhash"], total).select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")
