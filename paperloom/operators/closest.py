"""The closest pairs of fingerprints, exactly, by rings of bit blocks or by all pairs, whichever is cheaper.

The bits are cut into blocks. A block's ring t holds the pairs that differ in exactly t of its bits:
an equi-join, one side with each set of t bits flipped. If rings 0 .. t[i] of every block i were
looked through, each pair that wasn't met differs in more than t[i] bits of every block, so in at
least sum(t[i] + 1) bits: all pairs nearer than that are known. The search takes the cheapest next
rings, by the pairs that agree in a block, and stops as soon as the k-th best pair lies within what
is known. So a block that many fingerprints agree in is looked through last, or never.

Where all fingerprints are far from each other, rings reach more rows than there are pairs. As soon
as the rings that the k-th best pair still asks for cost more than comparing all pairs, those are
compared: in squares of two blocks of rows, each a task of bounded memory that returns its k best.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Bits of a block: about the logarithm of the fingerprints, within these.
LEAST_BITS, MOST_BITS = 8, 16
#: Rings looked through in one job cost at most so many times the cheapest of them.
SPREAD = 4
#: Pairs that are compared in a square for the price of a row that a ring shuffles.
CHEAP = 2
#: Rows of a block of the squares at most, and blocks at least where there are 1,000 rows for each.
SIDE, LEAST_SIDES = 32_768, 8
#: Pairs compared at once.
TILE = 1 << 20
#: Rows that one task of a ring's join has about, at most.
RING_ROWS = 500_000


def _rings(nodes: DataFrame, rings: list[tuple[int, int, int]], on: Column, rows: int) -> DataFrame:
    """Pairs (x the later, y) of ``nodes`` (with ``values``) that differ in exactly t bits of a block, for each (block, width, t)."""
    spark = nodes.sparkSession
    told = spark.createDataFrame(rings, "x_i int, width int, t int")
    flips = spark.range(1 << max(w for _, w, _ in rings)).withColumnRenamed("id", "flip")
    masks = F.broadcast(flips.join(F.broadcast(told), (F.bit_count("flip") == F.col("t")) & F.expr("flip < shiftleft(1L, width)")).select("x_i", "flip"))
    names = [c for c in nodes.columns if c != "values"]
    x = nodes.select(*[F.col(c).alias(f"x_{c}") for c in names], F.posexplode("values").alias("x_i", "own")).join(masks, "x_i").withColumn("x_v", F.col("own").bitwiseXOR(F.col("flip"))).drop("own", "flip")
    y = nodes.select(*[F.col(c).alias(f"y_{c}") for c in names], F.posexplode("values").alias("y_i", "y_v")).where(F.col("y_i").isin([i for i, *_ in rings]))
    parts = ceil(rows / RING_ROWS)
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        x, y = x.repartition(parts, "x_i", "x_v"), y.repartition(parts, "y_i", "y_v")
    return x.join(y, (F.col("x_i") == F.col("y_i")) & (F.col("x_v") == F.col("y_v")) & (F.col("y_seq") < F.col("x_seq")) & on)


def _best_of(best: np.ndarray, found: np.ndarray, k: int) -> np.ndarray:
    """The k first rows (distance, seq, cand) of both."""
    both = np.concatenate([best, found])
    return both[np.lexsort(both.T[::-1])[:k]]


def _square(rows: pa.Table, k: int, same: bool, most: int) -> np.ndarray:
    """The k first pairs (distance, seq, cand) of a square's rows, each of one side with each of the other."""
    rows = rows.combine_chunks()
    label = rows["label"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    seq, low, high = rows["seq"].to_numpy(), rows["low"].to_numpy(), rows["high"].to_numpy()
    words = pc.list_flatten(rows["words"]).to_numpy().view(np.uint64).reshape(len(seq), -1)
    a, b = np.flatnonzero(low), np.flatnonzero(high)
    own = np.array_equal(a, b)  # on the diagonal both sides are the same rows
    best = np.zeros((0, 3), np.int64)
    step = max(1, min(len(a), 1024))
    other = max(1, TILE // step)
    for i in range(0, len(a), step):
        x = a[i : i + step]
        for j in range(i // other * other if own else 0, len(b), other):
            y = b[j : j + other]
            far = np.zeros((len(x), len(y)), np.uint16)
            for w in range(words.shape[1]):
                far += np.bitwise_count(words[x, w][:, None] ^ words[y, w])
            out = (label[x][:, None] == label[y]) != same
            if own:  # each pair once; rows of one seq are no pair
                out |= (np.arange(j, j + len(y)) <= np.arange(i, i + len(x))[:, None]) | (seq[x][:, None] == seq[y])
            far[out] = np.iinfo(np.uint16).max
            if far.size and far.min() <= most:
                p, q = np.nonzero(far <= most)
                d = far[p, q]
                if len(d) > k:
                    near = np.partition(d, k - 1)[k - 1]
                    p, q, d = p[d <= near], q[d <= near], d[d <= near]
                one, two = seq[x[p]], seq[y[q]]
                best = _best_of(best, np.stack([d.astype(np.int64), np.maximum(one, two), np.minimum(one, two)], axis=1), k)
                if len(best) == k:
                    most = min(most, int(best[-1, 0]))
    return best


def all_pairs(nodes: DataFrame, n: int, k: int, words: Column, same: bool, most: int) -> list[tuple[int, int, int]]:
    """The k first of all pairs (distance, seq, cand) within ``most`` bits of ``nodes`` (seq, label), compared in squares.

    Rows are dealt over blocks by a hash; a square is two blocks, and a block is in as many squares as
    there are blocks.
    """
    sides = max(ceil(n / SIDE), min(LEAST_SIDES, n // 1000 + 1))
    block = F.pmod(F.xxhash64("seq"), F.lit(sides)).cast("int")
    cut = nodes.select("seq", "label", words.alias("words"), block.alias("block")).where("words IS NOT NULL")
    each = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    dealt = each.select("seq", "label", "words", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("low"), (F.col("block") >= F.col("other")).alias("high"))

    def run(rows: pa.Table) -> pa.Table:
        made = _square(rows, k, same, most)
        return pa.table({"distance": made[:, 0], "seq": made[:, 1], "cand": made[:, 2]})

    squares = dealt.repartition(sides * (sides + 1) // 2, "i", "j").groupBy("i", "j")
    found = squares.applyInArrow(run, "distance bigint, seq bigint, cand bigint")
    return [tuple(r) for r in found.orderBy("distance", "seq", "cand").limit(k).collect()]


def closest(nodes: DataFrame, k: int, bits: int, value: Callable[[Column, int, int], Column], distance: Callable[[Column, Column], Column], words: Column, same: bool, told: dict | None = None) -> list[tuple[int, int, int]]:
    """The k first pairs (distance, seq, cand) of ``nodes`` (seq, fp, label) of equal labels, or of different ones.

    ``value`` is the k-th of so many runs of a fingerprint's bits as a number, ``distance`` the bits
    in which two differ, ``words`` a fingerprint as an array of 64-bit words. k pairs reach the driver
    for each ring, no more. ``told`` gets the rows that were compared, the radius that was needed and
    whether all pairs were compared.
    """
    nodes = nodes.persist()
    try:
        n = nodes.count()
        if n < 2:
            return []
        blocks = ceil(bits / min(MOST_BITS, max(LEAST_BITS, round(log2(n)))))
        widths = [(i + 1) * bits // blocks - i * bits // blocks for i in range(blocks)]
        parted = nodes.withColumn("values", F.array(*[value(F.col("fp"), i, blocks) for i in range(blocks)]))
        agree = {r["i"]: r["s"] for r in parted.select(F.posexplode("values").alias("i", "v")).groupBy("i", "v").agg(F.count("*").alias("c")).groupBy("i").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("s")).collect()}
        cost = lambda i, t: comb(widths[i], t) * (n + agree.get(i, 0))
        alike = F.col("x_label").eqNullSafe(F.col("y_label"))
        done, best, compared, whole = [-1] * blocks, [], 0, False

        def asked(last: int | None) -> int:
            """What the rings cost that are needed to know all pairs within ``last``; at least the next one, if that isn't known."""
            then, total = list(done), 0
            while (sum(then) + blocks - 1 < last) if last is not None else then == done:
                some = [(cost(i, then[i] + 1), i) for i in range(blocks) if then[i] < widths[i]]
                if not some:
                    break
                price, i = min(some)
                total, then[i] = total + price, then[i] + 1
            return total

        while True:
            known = sum(done) + blocks - 1
            open_ = sorted((cost(i, done[i] + 1), i) for i in range(blocks) if done[i] < widths[i])
            last = best[k - 1][0] if len(best) >= k else None
            if not open_ or (last is not None and last <= known):
                break
            if asked(last) > n * (n - 1) / 2 / CHEAP:
                whole = True
                compared += n * (n - 1) // 2
                best = all_pairs(nodes, n, k, words, same, bits if last is None else last)
                break
            some = [i for c, i in open_ if c <= SPREAD * open_[0][0]][: None if last is None else last - known]
            rings = _rings(parted, [(i, widths[i], done[i] + 1) for i in some], alike if same else ~alike, sum(cost(i, done[i] + 1) for i in some))
            seen = Observation()
            far = distance(F.col("x_fp"), F.col("y_fp")).cast("bigint")
            met = rings.observe(seen, F.count(F.lit(1)).alias("n")).select(far.alias("distance"), F.col("x_seq").alias("seq"), F.col("y_seq").alias("cand"))
            if last is not None:
                met = met.where(F.col("distance") <= last)
            # a pair comes once for each of the blocks at most
            found = met.orderBy("distance", "seq", "cand").limit(k * len(some)).collect()
            compared += seen.get["n"]
            best = sorted({*best, *(tuple(r) for r in found)})[:k]
            for i in some:
                done[i] += 1
        if told is not None:
            told |= {"compared": compared, "radius": bits if whole else sum(done) + blocks - 1, "rings": sum(done) + blocks, "whole": whole}
        return best
    finally:
        nodes.unpersist()
