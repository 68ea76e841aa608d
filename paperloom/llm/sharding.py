"""Placement of rows on shards by a permutation-filled lookup table.

Each shard walks its own permutation of the slots of a prime-sized table; the shards take
turns, and each claims the first free slot on its walk. A row's key is hashed to a slot. All
shards get the same number of slots but for one, and when a shard joins or leaves, few rows
between the other shards move.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import unused

#: Slots; a prime, and over a hundred times the shards, so that shares differ by 1 % at most.
TABLE_SIZE = 65_537
SHARDS = 128


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(shard: str, size: int) -> tuple[int, int]:
    """Where a shard's walk begins and the step it takes; size is prime, so it visits every slot."""
    first = xxhash.xxh64_intdigest(shard.encode(), seed=1) % size
    return first, xxhash.xxh64_intdigest(shard.encode(), seed=2) % (size - 1) + 1


def fill(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The table: for each slot the index of the shard that claimed it."""
    if not is_prime(size) or not 0 < len(shards) <= size or len({*shards}) < len(shards):
        raise ValueError("the size must be a prime and no less than the number of distinct shards")
    walks = [preference(x, size) for x in shards]
    at, steps = [x for x, _ in walks], [x for _, x in walks]
    slots, left = [-1] * size, size
    while left:
        for k, step in enumerate(steps):
            slot = at[k]
            while slots[slot] >= 0:
                slot = (slot + step) % size
            slots[slot], at[k] = k, slot
            left -= 1
            if not left:
                break
    return slots


def placed(df: DataFrame, key: Column, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with columns ``shard_slot`` and ``shard`` (replaced if there).

    The lookup table has ``size`` rows whatever the input, and is broadcast. Rows of equal keys
    share a shard, a null key is hashed like any other; an empty table stays empty.
    """
    named = [(slot, shards[k]) for slot, k in enumerate(fill(shards, size))]
    lookup = df.sparkSession.createDataFrame(named, "shard_slot int, shard string")
    slot = F.pmod(F.xxhash64(key), F.lit(size)).cast("int")
    kept = [c for c in df.columns if c.lower() not in ("shard_slot", "shard")]
    slotted = df.select(*[F.col(f"`{c}`") for c in kept], slot.alias("shard_slot"))
    return slotted.join(F.broadcast(lookup), "shard_slot").select(*[f"`{c}`" for c in kept], "shard_slot", "shard")


def document_key() -> Column:
    """doc_id, or the text where that is null, so that rows without an id don't share a shard."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.col("text")))


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


def place_documents(docs: DataFrame, n: int = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """doc_id, n_bytes, shard_slot, shard for every row; null text has null n_bytes."""
    slim = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), document_key().alias("key"))
    return placed(slim, F.col("key"), shard_names(n), size).select("doc_id", "n_bytes", "shard_slot", "shard")


def write_shards(df: DataFrame, path: str, n: int = SHARDS, size: int = TABLE_SIZE, salts: int = 1) -> None:
    """Writes one folder a shard; ``salts`` tasks write each, so no task has a whole large shard."""
    key = unused(df.columns, "key")
    out = placed(df.withColumn(key, document_key()), F.col(key), shard_names(n), size)
    salt = F.pmod(F.xxhash64(key, F.lit("salt")), F.lit(salts))
    out.repartition(n * salts, "shard", salt).drop(key, "shard_slot").write.partitionBy("shard").parquet(path)
