"""The event log as mergeable hours: reports add up hours instead of reading events.

A cell is (hour, measure, value, n). Cells of one key add up, so any split of the log into batches
gives the same: counts and sums have a null value, "latency" has a row for each value (exact
percentiles need no more), "category" by name, and "clock" the latest time in microseconds, of which
the larger counts. Each batch writes cells of its own under its number, so a batch that runs again
writes the same once more; ``compacted`` turns batches into one base. A report takes whole hours
from the store, and from the log only the part of an hour at the edge of its window, by a literal
bound on ts. Events without a time count nowhere; late events go to their own hour.
"""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.functions import fields as C
from paperloom.functions import tables as V
from paperloom.operators.carry import running_sum
from paperloom.operators.telemetry import CONFIRMED, PROCESSED
from paperloom.streaming.inbox import _fs, drop_folder

CELL = "hour timestamp_ntz, measure string, name string, value double, n bigint"


def cells(events: DataFrame) -> DataFrame:
    """The cells of events (ts, type, latency_s, fields_total, fields_corrected, manual_type_change, corrected_key)."""
    done, confirmed = F.col("type").isin(*PROCESSED), F.col("type") == CONFIRMED

    def cell(measure: str, n: Column, when: Column, name: Column | None = None, value: Column | None = None) -> Column:
        kept = F.struct(F.lit(measure).alias("measure"), (F.lit(None) if name is None else name).cast("string").alias("name"), (F.lit(None) if value is None else value).cast("double").alias("value"), n.cast("bigint").alias("n"))
        return F.when(when, kept)

    one = F.lit(1)
    manual = confirmed & F.coalesce("manual_type_change", F.lit(False))
    found = F.array(
        cell("clock", F.unix_micros(F.col("ts").cast("timestamp")), F.lit(True)), cell("docs", one, done), cell("fields", F.coalesce("fields_total", F.lit(0)), done),
        cell("latency", one, done & F.col("latency_s").isNotNull(), value=F.col("latency_s")), cell("confirms", one, confirmed), cell("corrected", F.coalesce("fields_corrected", F.lit(0)), confirmed),
        cell("manual", one, manual), cell("category", one, confirmed & F.col("corrected_key").isNotNull(), name=C.correction_category(F.col("corrected_key"))), cell("category", one, manual, name=F.lit("doc_type")))
    rows = events.where("ts IS NOT NULL").select(F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("hour"), F.explode(F.array_compact(found)).alias("c"))
    return merged(rows.select("hour", "c.*"))


def merged(parts: DataFrame) -> DataFrame:
    n = F.when(F.col("measure") == "clock", F.max("n")).otherwise(F.sum("n"))
    return parts.groupBy("hour", "measure", "name", "value").agg(n.alias("n"))


def keep_batch(events: DataFrame, path: str, number: int) -> None:
    """Stores a batch under its number; one that is run again replaces itself."""
    cells(events).write.mode("overwrite").parquet(f"{path}/batch={number}")


def keep_hours(events: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Streams an event log into the store."""
    out = events.writeStream.foreachBatch(lambda batch, epoch: keep_batch(batch, path, epoch)).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def _whole(spark: SparkSession, path: str, kind: str) -> list[int]:
    fs, held = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(held)] if fs.exists(held) else []
    return sorted(int(n.split("=")[1]) for n in names if re.fullmatch(rf"{kind}=\d+", n) and fs.exists(_fs(spark, f"{path}/{n}/_SUCCESS")[1]))


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The store's cells: the last base and the batches behind it."""
    bases = _whole(spark, path, "base")
    parts = [f"{path}/base={bases[-1]}"] if bases else []
    parts += [f"{path}/batch={n}" for n in _whole(spark, path, "batch") if not bases or n > bases[-1]]
    return merged(spark.read.schema(CELL).parquet(*parts)) if parts else spark.createDataFrame([], CELL)


def compacted(spark: SparkSession, path: str) -> None:
    """Makes one base of all batches; a reader sees the old parts or the new base. Old parts go afterwards."""
    batches, bases = _whole(spark, path, "batch"), _whole(spark, path, "base")
    if batches and (not bases or batches[-1] > bases[-1]):
        stored(spark, path).write.mode("overwrite").parquet(f"{path}/base={batches[-1]}")
        for old in [*(f"batch={n}" for n in batches), *(f"base={n}" for n in bases)]:
            drop_folder(spark, f"{path}/{old}")


def in_window(held: DataFrame, events: DataFrame, hours: int) -> DataFrame:
    """Cells of the last ``hours`` hours before the store's clock: whole hours of the store, and the edge from the log."""
    last = held.where("measure = 'clock'").agg(F.max("n")).first()[0]
    if last is None:
        return held.where(F.lit(False))
    since = held.sparkSession.range(1).select(F.timestamp_micros(F.lit(last)).cast("timestamp_ntz").alias("t")).first()["t"] - timedelta(hours=hours)
    edge = since.replace(minute=0, second=0, microsecond=0)
    if edge == since:
        return held.where(F.col("hour") >= F.lit(edge).cast("timestamp_ntz"))
    told = lambda t: F.expr(f"TIMESTAMP_NTZ '{t:%Y-%m-%d %H:%M:%S.%f}'")
    after = edge + timedelta(hours=1)
    part = cells(events.where((F.col("ts") >= told(since)) & (F.col("ts") < told(after))))
    return held.where(F.col("hour") >= told(after)).unionByName(part)


def totals(window: DataFrame) -> DataFrame:
    """As ``telemetry.totals``, of the cells of a window."""
    of = lambda m: F.coalesce(F.sum(F.when(F.col("measure") == m, F.col("n"))), F.lit(0)).cast("bigint")
    agg = window.agg(of("docs").alias("docs_processed"), of("fields").alias("fields_extracted"), of("corrected").alias("fields_corrected"), of("confirms").alias("confirms"), of("manual").alias("manual_type_changes"))
    rate = F.coalesce(F.try_divide("fields_corrected", "fields_extracted"), F.lit(0.0))
    first = F.coalesce(F.try_divide(F.col("confirms") - F.col("manual_type_changes"), F.col("confirms")), F.lit(0.0))
    return agg.select("*", rate.alias("correction_rate"), first.alias("first_try_type_acc"))


def latency(window: DataFrame, blocks: int | None = None) -> DataFrame:
    """As ``telemetry.latency``: the values' running count finds the ranks, block by block."""
    values = window.where("measure = 'latency'").groupBy("value").agg(F.sum("n").alias("n"))
    counted = running_sum(values, [], "value", F.col("n"), "upto", blocks)
    total = values.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))  # one row
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("value")))
    all_, zero = F.col("total"), F.lit(0.0)
    # nearest rank: whole numbers, as 0.95 has no exact double
    found = total.crossJoin(counted).groupBy("total").agg(at(F.floor((all_ + 1) / 2)).alias("a"), at(F.floor(all_ / 2) + 1).alias("b"), at(F.ceil(all_ * 95 / 100)).alias("p"))
    return total.join(found, "total", "left").select(F.coalesce((F.col("a") + F.col("b")) / 2, zero).alias("median_latency_s"), F.coalesce("p", zero).alias("p95_latency_s"), all_.cast("bigint").alias("n"))


def categories(window: DataFrame) -> DataFrame:
    """As ``telemetry.corrections_by_category``."""
    dim = window.sparkSession.createDataFrame([(c,) for c in V.CATEGORIES], "category string")
    counted = window.where("measure = 'category'").groupBy(F.col("name").alias("category")).agg(F.sum("n").alias("n"))
    return F.broadcast(dim).join(counted, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("corrections"))


def hourly(held: DataFrame, hours: int = 24) -> DataFrame:
    """As ``telemetry.hourly``, of the store's cells: the hour at the edge isn't one of the last ``hours``."""
    of = lambda m: F.coalesce(F.sum(F.when(F.col("measure") == m, F.col("n"))), F.lit(0))
    last = held.where("measure = 'clock'").agg(F.max("n").alias("n"))
    top = F.date_trunc("HOUR", F.timestamp_micros("n")).cast("timestamp_ntz")
    axis = last.where("n IS NOT NULL").select(F.explode(F.sequence(F.lit(hours - 1), F.lit(0), F.lit(-1))).alias("back"), top.alias("top"))
    axis = axis.select((F.col("top") - F.make_dt_interval(F.lit(0), F.col("back"))).alias("hour_start"))
    counted = held.groupBy("hour").agg(of("docs").alias("docs"), of("corrected").alias("corrections"))
    joined = F.broadcast(axis).join(counted, F.col("hour_start") == F.col("hour"), "left")
    return joined.select(F.date_format("hour_start", "yyyy-MM-dd HH:00").alias("hour"), F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("corrections", F.lit(0)).alias("corrections"))
