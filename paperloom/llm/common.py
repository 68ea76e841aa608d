"""What the corpus operators share: table access, bounded Arrow chunks, word splitting."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of an Arrow function works on; bounds a worker's memory.
CHUNK_BYTES = 1 << 20
#: For steps that gain by meeting the same words or strings again.
LARGE_CHUNK = 4 << 20


#: Bytes as they are, but the six ASCII white-space characters as a space.
SPACES = bytes(32 if x in b" \t\n\r\x0b\x0c" else x for x in range(256))

#: Rows and bytes of an Arrow batch between Spark and its Python workers, where the session has the defaults.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", "8388608")}


def small_batches(spark: SparkSession) -> None:
    """Batches of whole texts hold 1,000 rows and 8 MB from now on in this session; own settings stay."""
    for key, (default, ours) in BATCH.items():
        if spark.conf.get(key, default) in (default, "64MB", f"{default}b"):
            spark.conf.set(key, ours)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    If neither is set, a folder under the warehouse. On a cluster that must not be a machine's own
    (``file:``), which other machines don't see; with a local master there is only one machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        one_machine = re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is not None
        if not one_machine and (warehouse.startswith("file:") or ":" not in warehouse):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"{warehouse}/.paperloom"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a folder that ``shared_path`` named."""
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(held, True)


#: Narrow rows (a few numbers) that one task works on at most.
TASK_ROWS = 100_000


def checkpointed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cuts the lineage through the shared folder, so that a lost executor loses nothing.

    With ``rows``, a bound of the rows where these are narrow, in as many partitions as they are
    worth: steps that are repeated on few rows don't make files for every shuffle partition.
    """
    shared_dir(df.sparkSession)
    return (df if rows is None else df.coalesce(max(1, -(-rows // TASK_ROWS)))).checkpoint(eager=True)


def unused(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column is called so (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Keys with over 1/HOT of all rows are hot; there are fewer than HOT of them.
HOT = 10_000


def skew_join(big: DataFrame, small: DataFrame, on: list[str], total: int, n: str = "n") -> DataFrame:
    """``big`` inner joined with ``small``, which has one row a key and in ``n`` the key's rows in ``big``.

    The hot keys' rows of ``small``, fewer than HOT, are broadcast, so that a hot key's rows stay
    where they are; all others are shuffled. Both tables are read twice: have them checkpointed.
    """
    share = max(1, total // HOT)
    often = F.broadcast(small.where(F.col(n) > share).drop(n))
    seldom = small.where(F.col(n) <= share).drop(n)
    return big.join(often, on).unionByName(big.join(often.select(*on), on, "left_anti").join(seldom, on))


#: Blocks of consecutive ids, at most, and those that rows without an id are dealt over.
MOST_BLOCKS, NULL_BLOCKS = 16_384, 64


@dataclass(frozen=True)
class Blocks:
    """Blocks of documents by id: as many documents each, whatever the ids are.

    ``bounds`` are the first ids of blocks 1, 2, ..., taken from ids that a hash chooses. Rows without
    an id come first, in the order of their tie, in blocks -NULL_BLOCKS to -1. Rows of one id are in
    one block.
    """

    bounds: np.ndarray
    nulls: bool

    @staticmethod
    def of(docs: DataFrame, block_docs: int) -> "Blocks":
        n, known = docs.agg(F.count("*"), F.count("doc_id")).first()
        blocks = min(MOST_BLOCKS, known // block_docs + 1)
        chosen = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, known // (8 * blocks)))) == 0
        ids = np.sort(docs.where(chosen & F.col("doc_id").isNotNull()).select("doc_id").distinct().toArrow().column(0).to_numpy())  # about 8 a block
        at = np.arange(1, blocks) * len(ids) // blocks
        return Blocks(np.unique(ids[at]) if len(ids) else np.zeros(0, np.int64), known < n)

    def number(self, ids: pa.Array, ties: np.ndarray) -> np.ndarray:
        """The block of each row; ties are unsigned 32-bit numbers."""
        out = np.searchsorted(self.bounds, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), side="right")
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), (ties.astype(np.int64) >> 26) - NULL_BLOCKS, out)

    def rank(self, block: Column) -> tuple[Column, int]:
        """Block numbers from 0 up, and how many there are."""
        low = NULL_BLOCKS if self.nulls else 0
        return block + F.lit(low), len(self.bounds) + 1 + low


def text_array(column: pa.Array) -> pa.Array:
    """Strings with null taken as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "") if column.null_count else column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the n+1 offsets into them, from 0."""
    column = text_array(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``most`` bytes of text, or a single row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        at = raw(batch.column(batch.schema.get_field_index(column)))[1]
        first = 0
        while first < n:
            last = int(np.searchsorted(at, at[first] + most, side="right")) - 1
            last = min(n, max(first + 1, last))
            yield batch.slice(first, last - first)
            first = last
    let_go()


def let_go() -> None:
    """Gives free memory back to the system at a task's end, as Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def spans_of(mask: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true in ``mask``; a run also ends at each of ``cuts``."""
    starts, ends = mask.copy(), mask.copy()
    starts[1:] &= ~mask[:-1]
    ends[:-1] &= ~mask[1:]
    inner = cuts[(cuts > 0) & (cuts < len(mask))]
    starts[inner] |= mask[inner]
    ends[inner - 1] |= mask[inner - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def words(data: np.ndarray, at: np.ndarray, byte_map: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Words of many texts at once.

    ``byte_map`` turns each byte into itself, its lower case or a space. Returns the words'
    starts and ends in ``data``, the first word of each text (n+1 entries) and the words.
    """
    plain = np.frombuffer(data.tobytes().translate(byte_map), np.uint8)
    mask = plain != 32
    if not len(plain):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64), pa.array([], pa.binary())
    starts, ends = spans_of(mask, at)
    ends_at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    kept = np.ascontiguousarray(plain[mask])
    array = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends_at), pa.py_buffer(kept)])
    return starts, ends, np.searchsorted(starts, at), array


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply) over unsigned integers, wrapping."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))
