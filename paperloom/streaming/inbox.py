"""Watched folder: every content is taken in once, by the first of its names; rejects are remembered."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperloom.functions import fields as C
from paperloom.functions import tables as V
from paperloom.operators.carry import last_before

LEDGER = "sha256 string, name string, outcome string, at timestamp"


def admit(batch: DataFrame, ledger: DataFrame, accept: Column | None = None) -> DataFrame:
    """name, content, at -> ledger rows of contents that are new: of equal ones the least name counts.

    A content is rejected if it is empty, or ``accept`` (of ``content``) isn't true.
    """
    ok = F.length("content") > 0 if accept is None else (F.length("content") > 0) & F.coalesce(accept, F.lit(False))
    hashed = batch.select("name", "at", F.sha2("content", 256).alias("sha256"), ok.alias("ok"))
    first = hashed.groupBy("sha256").agg(F.min(F.struct("name", "at", "ok")).alias("f"))
    new = first.join(ledger.select("sha256"), "sha256", "left_anti")
    return new.select("sha256", "f.name", F.when(F.col("f.ok"), "ingested").otherwise("rejected").alias("outcome"), F.col("f.at").alias("at"))


def stable(polls: DataFrame, blocks: int | None = None) -> DataFrame:
    """Files (poll, name, size, mtime) whose size and time are as at the poll before."""
    met = last_before(polls, ["name"], "poll", {"was": F.struct("poll", "size", "mtime")}, blocks)
    same = (F.col("was.size") == F.col("size")) & (F.col("was.mtime") == F.col("mtime")) & (F.col("was.poll") == F.col("poll") - 1)
    return met.withColumn("stable", F.coalesce(same, F.lit(False))).drop("was")


def ledger_at(spark: SparkSession, path: str, batch: DataFrame | None = None) -> DataFrame:
    """The ledger's rows; with a ``batch`` (sha256) only those of its digests' first two digits, which are folders."""
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(held):
        return spark.createDataFrame([], LEDGER)
    rows = spark.read.schema(f"{LEDGER}, part string").parquet(path)
    if batch is not None:
        parts = [r[0] for r in batch.select(F.substring("sha256", 1, 2)).distinct().collect()]  # 256 at most
        rows = rows.where(F.col("part").isin(parts))
    return rows.drop("part")


def settle(batch: DataFrame, ledger_path: str, accept: Column | None = None, log_path: str | None = None) -> None:
    """Adds what is new of a batch (name, content, at) to the ledger, in folders by digest.

    With ``log_path`` the event log gets a line for each: inbox_ingested, or inbox_rejected with the reason.
    """
    spark = batch.sparkSession
    new = admit(batch, ledger_at(spark, ledger_path, batch.select(F.sha2("content", 256).alias("sha256"))), accept)
    staged = f"{ledger_path.rstrip('/')}.new"
    if log_path:  # written once, so that ledger and log get the same rows whatever executor is lost
        new.write.mode("overwrite").parquet(staged)
        new = spark.read.schema(LEDGER).parquet(staged)
    new.withColumn("part", F.substring("sha256", 1, 2)).repartition("part").write.mode("append").partitionBy("part").parquet(ledger_path)
    if log_path:
        rejected = F.col("outcome") == "rejected"
        at = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts")
        new.select(at, F.when(rejected, "inbox_rejected").otherwise("inbox_ingested").alias("type"), "name", F.when(rejected, "empty or unreadable file").alias("error")).write.mode("append").json(log_path)
        drop_folder(spark, staged)


def compacted(spark: SparkSession, ledger_path: str, to: str) -> None:
    """Writes the ledger anew under ``to``, one file a folder."""
    ledger_at(spark, ledger_path).withColumn("part", F.substring("sha256", 1, 2)).repartition("part").write.partitionBy("part").parquet(to)


def _named(rows: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return rows.withColumn("name", name).where(C.is_eligible(F.col("name"), V.INBOX_EXTENSIONS))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """name, path, size, mtime of the folder's own eligible files, empty ones too. No content is read."""
    files = spark.read.format("binaryFile").load(folder)
    held = _named(files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")))
    # the scan leaves empty files out; the index has them, by encoded address
    index = _named(spark.createDataFrame([(unquote(x),) for x in files.inputFiles()], "path string"))
    empty = index.join(held.select("name"), "name", "left_anti").select("path", F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("timestamp").alias("mtime"), "name")
    return held.unionByName(empty).select("name", "path", "size", "mtime")


def contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """name, content, size, at of these files alone; those that are gone meanwhile are left out."""
    held = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p in paths if (x := held(p)).getFileSystem(conf).exists(x)]
    if not there:
        return spark.createDataFrame([], "name string, content binary, size bigint, at timestamp")
    globbed = [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in there]  # names, not patterns
    files = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(globbed)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("at"))


#: Files whose names pass the driver and whose contents are read at a time.
SLICE = 10_000
STATE = "name string, size bigint, mtime timestamp, done boolean"


def poll(spark: SparkSession, folder: str, ledger_path: str, polls_path: str, number: int, accept: Column | None = None, log_path: str | None = None) -> int:
    """One look at the folder: files whose size and time are as at the look before are taken in. Returns how many were read.

    What the looks know of each name (size, time, whether it is done) is a small table, the last two
    versions of which are kept. A file that still grows waits; one that is done isn't opened again
    until its size or time changes, after a restart neither. A file that changes between the listing
    and the reading waits as well. A look that is run again with its number does the same.
    """
    known = _last_look(spark, polls_path, number)
    before = known.select("name", F.col("size").alias("was_size"), F.col("mtime").alias("was_mtime"), F.col("done").alias("was_done"), F.lit(True).alias("met"))
    same = F.coalesce(F.col("met"), F.lit(False)) & (F.col("size") == F.col("was_size")) & F.col("mtime").eqNullSafe(F.col("was_mtime"))
    path = f"{polls_path}/poll={number}"
    looked = f"{path}.listing"
    listing(spark, folder).join(before, "name", "left").select("name", "path", "size", "mtime", same.alias("same"), (same & F.col("was_done")).alias("done")).write.mode("overwrite").parquet(looked)
    now = spark.read.parquet(looked)
    due = now.where("same AND NOT done").select("name", "path", "size", "mtime")
    read = 0
    taken = f"{path}.taken"
    drop_folder(spark, taken)
    for part in _slices(due.toLocalIterator(prefetchPartitions=False), SLICE):
        told = F.broadcast(spark.createDataFrame([(r.name, r.size, r.mtime) for r in part], "name string, told_size bigint, told_mtime timestamp"))
        full = contents(spark, [r.path for r in part if r.size])
        batch = full.join(told, "name").where((F.col("size") == F.col("told_size")) & (F.col("at") == F.col("told_mtime"))).select("name", "at", "content")
        empty = told.where("told_size = 0").select("name", F.col("told_mtime").alias("at"), F.lit(b"").alias("content"))
        batch = batch.unionByName(empty)
        settle(batch, ledger_path, accept, log_path)
        batch.select("name").write.mode("append").parquet(taken)
        read += len(part)
    done = now
    if read:
        done = now.join(spark.read.schema("name string").parquet(taken).distinct().withColumn("ok", F.lit(True)), "name", "left").withColumn("done", F.col("done") | F.coalesce("ok", F.lit(False)))
    done.select("name", "size", "mtime", "done").write.mode("overwrite").parquet(path)
    for old in [looked, taken, *(f"{polls_path}/poll={n}" for n in _looks(spark, polls_path) if n < number - 1)]:
        drop_folder(spark, old)
    return read


def _slices(rows: Iterator, most: int) -> Iterator[list]:
    while part := list(islice(rows, most)):
        yield part


def _fs(spark: SparkSession, path: str) -> tuple:
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), held


def drop_folder(spark: SparkSession, path: str) -> None:
    fs, held = _fs(spark, path)
    fs.delete(held, True)


def _looks(spark: SparkSession, polls_path: str) -> list[int]:
    """Numbers of the looks that were written whole."""
    fs, held = _fs(spark, polls_path)
    if not fs.exists(held):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(held)]
    found = [n for n in names if re.fullmatch(r"poll=\d+", n)]
    return sorted(int(n[5:]) for n in found if fs.exists(_fs(spark, f"{polls_path}/{n}/_SUCCESS")[1]))


def _last_look(spark: SparkSession, polls_path: str, number: int) -> DataFrame:
    earlier = [n for n in _looks(spark, polls_path) if n < number]
    if not earlier:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(f"{polls_path}/poll={earlier[-1]}")


def file_steps(looks: DataFrame) -> DataFrame:
    """poll, name, step of files (poll, name, size, mtime): what a look does with each.

    "wait" for a file that is new or changed since the look before (or wasn't there), "read" at the
    next look at which it is the same, "skip" from then on.
    """
    w = W.partitionBy("name").orderBy("poll")
    same = (F.lag("poll").over(w) == F.col("poll") - 1) & F.lag("size").over(w).eqNullSafe(F.col("size")) & F.lag("mtime").over(w).eqNullSafe(F.col("mtime"))
    again = looks.withColumn("fresh", ~F.coalesce(same, F.lit(False)))
    run = again.withColumn("run", F.sum(F.col("fresh").cast("int")).over(w))
    nth = F.row_number().over(W.partitionBy("name", "run").orderBy("poll"))
    return run.select("poll", "name", F.when(nth == 1, "wait").when(nth == 2, "read").otherwise("skip").alias("step"))


def live_steps(looks: DataFrame) -> DataFrame:
    """Streaming twin of ``file_steps`` for listings that arrive as a stream (poll, name, size, mtime in microseconds).

    A name's state is its last look and whether the file is done, four numbers; looks that come
    again are passed over.
    """
    import pandas as pd

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        got, steps = pd.concat(list(parts)).sort_values("poll", kind="stable"), []
        was = state.get if state.exists else None
        for poll, size, mtime in zip(got.poll.tolist(), got["size"].tolist(), got.mtime.tolist(), strict=True):
            if was is not None and poll <= was[0]:
                continue
            same = was is not None and poll == was[0] + 1 and (size, mtime) == (was[1], was[2])
            steps.append((key[0], poll, "wait" if not same else "skip" if was[3] else "read"))
            was = (poll, size, mtime, same)
        state.update(was)
        yield pd.DataFrame(steps, columns=["name", "poll", "step"])

    held = "poll bigint, size bigint, mtime bigint, done boolean"
    return looks.groupBy("name").applyInPandasWithState(step, "name string, poll bigint, step string", held, "append", GroupStateTimeout.NoTimeout)


def watch(spark: SparkSession, folder: str, ledger_path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Streams the folder into the ledger table; a batch that is run again adds nothing twice.

    Files are taken to be whole when they appear (moved in); ``watch_growing`` waits until they are.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = _named(spark.readStream.format("binaryFile").schema(schema).load(folder))
    some = files.select("name", F.col("modificationTime").alias("at"), "content")
    out = some.writeStream.foreachBatch(lambda batch, epoch: settle(batch, ledger_path)).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def watch_growing(spark: SparkSession, folder: str, ledger_path: str, polls_path: str, checkpoint: str, every: str = "2 seconds", accept: Column | None = None, log_path: str | None = None) -> StreamingQuery:
    """Looks at the folder ``every`` so often and takes in files that have stopped to grow, each once."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()

    def look(batch: DataFrame, epoch: int) -> None:
        poll(batch.sparkSession, folder, ledger_path, polls_path, epoch, accept, log_path)

    out = ticks.writeStream.foreachBatch(look).option("checkpointLocation", checkpoint)
    return out.trigger(processingTime=every).start()


def live_hours(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Streaming twin of the hourly timeline: processed documents and corrections for each hour of ``ts``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w")).agg(
        F.count_if(F.col("type").isin("extracted", "unrecognized")).alias("docs"), F.sum(F.when(F.col("type") == "confirmed", F.col("fields_corrected")).otherwise(0)).alias("corrections"),
    ).select(F.col("w.start").alias("hour"), "docs", "corrections")
