"""Values carried along an order within a key, without a task that holds a whole key.

The order is cut into blocks that hold as many rows each (bounds from approximate percentiles). A
window sees one block of one key; what a block inherits comes from one row for each block of the
key, aggregated before it is shuffled. So a key that holds all rows is spread over all blocks.
Orders are unique within a key; rows without an order are in the first block and before all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a block as planned, and blocks at most.
BLOCK_ROWS, MOST_BLOCKS = 1_000_000, 256
BLOCK = "__block"


def blocks_for(rows: int) -> int:
    return min(MOST_BLOCKS, rows // BLOCK_ROWS + 1)


def _bounds(rows: DataFrame, order: str, blocks: int | None) -> list:
    if blocks is None:
        blocks = blocks_for(rows.count())
    if blocks < 2:
        return []
    found = rows.agg(F.percentile_approx(order, [k / blocks for k in range(1, blocks)], F.lit(10_000))).first()[0] or []
    return sorted({*found})


def bounds_for(rows: DataFrame, order: str, blocks: int | None = None) -> list:
    """Bounds for carries along ``rows`` or what is made of them, for callers that know cheaper rows with the same orders."""
    return _bounds(rows, order, blocks)


def block_of(order: Column, bounds: list) -> Column:
    """How many bounds an order has reached, by halving."""

    def part(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(order < F.lit(bounds[mid]), part(low, mid)).otherwise(part(mid + 1, high))

    return F.when(order.isNull(), 0).otherwise(part(0, len(bounds))) if bounds else F.lit(0)


def _headed(inner: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
    """``inner`` with its block's and keys' row of ``heads``, whose own keys get other names."""
    named = heads.withColumnsRenamed({k: f"__key_{k}" for k in [*keys, BLOCK]})
    on = F.col(BLOCK) == F.col(f"__key_{BLOCK}")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    return inner.join(named, on, "left")


def last_before(rows: DataFrame, keys: list[str], order: str, values: dict[str, Column], blocks: int | None = None, bounds: list | None = None) -> DataFrame:
    """``rows`` with, for each of ``values``, its last value that isn't null in earlier rows of the same keys."""
    bounds = _bounds(rows, order, blocks) if bounds is None else bounds
    before = W.partitionBy(*keys, *([BLOCK] if bounds else [])).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    if not bounds:
        return rows.withColumns({n: F.last(v, ignorenulls=True).over(before) for n, v in values.items()})
    cut = rows.withColumn(BLOCK, block_of(F.col(order), bounds))
    inner = cut.withColumns({f"__in_{n}": F.last(v, ignorenulls=True).over(before) for n, v in values.items()})
    tails = cut.groupBy(*keys, BLOCK).agg(*[F.max_by(v, F.when(v.isNotNull(), F.struct(order))).alias(n) for n, v in values.items()])
    blocks_before = W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    heads = tails.select(*keys, BLOCK, *[F.last(n, ignorenulls=True).over(blocks_before).alias(f"__head_{n}") for n in values])
    return _headed(inner, heads, keys).select(*rows.columns, *[F.coalesce(f"__in_{n}", f"__head_{n}").alias(n) for n in values])


def running_sum(rows: DataFrame, keys: list[str], order: str, value: Column, name: str, blocks: int | None = None, bounds: list | None = None) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over rows of the same keys up to the row itself."""
    bounds = _bounds(rows, order, blocks) if bounds is None else bounds
    if not bounds:
        return rows.withColumn(name, F.sum(value).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
    cut = rows.withColumn(BLOCK, block_of(F.col(order), bounds))
    inner = cut.withColumn("__in", F.sum(value).over(W.partitionBy(*keys, BLOCK).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
    sums = cut.groupBy(*keys, BLOCK).agg(F.sum(value).alias("__sum"))
    heads = sums.select(*keys, BLOCK, F.sum("__sum").over(W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)).alias("__head"))
    return _headed(inner, heads, keys).select(*rows.columns, (F.col("__in") + F.coalesce("__head", F.lit(0))).alias(name))


def left_spread(rows: DataFrame, found: DataFrame, key: str, target: str, tie: str) -> DataFrame:
    """``rows`` left joined with ``found`` where ``key`` is ``target``; ``tie`` deals out the rows without a key.

    Such rows meet nothing, but a plain left join has them all in one task.
    """
    rows = rows.withColumn("__key", F.struct(F.col(key).alias("key"), F.when(F.col(key).isNull(), F.xxhash64(tie)).alias("spread")))
    found = found.where(F.col(target).isNotNull()).withColumn("__target", F.struct(F.col(target).alias("key"), F.lit(None).cast("bigint").alias("spread")))
    return rows.join(found, F.col("__key") == F.col("__target"), "left").drop("__key", "__target")
