"""The event log's reports: hourly buckets, totals, latency, corrections, recent runs."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paperloom.functions import fields as C
from paperloom.functions import tables as V

PROCESSED, CONFIRMED = ("extracted", "unrecognized"), "confirmed"


def in_window(events: DataFrame, clock: DataFrame, hours: int) -> DataFrame:
    """Events of the last ``hours`` hours before ``now``; later ones pass, those without a time don't.

    The clock is read first, one value, so that the bound is a literal which reaches the scan.
    """
    row = clock.first()
    now = row["now"] if row is not None else None
    if now is None:
        return events.where(F.lit(False))
    since = F.expr(f"TIMESTAMP_NTZ '{now - timedelta(hours=hours):%Y-%m-%d %H:%M:%S.%f}'")
    return events.where(F.col("ts") >= since)


def hourly(events: DataFrame, clock: DataFrame, hours: int = 24) -> DataFrame:
    """One row for each of the last ``hours`` hours, the current one last: processed documents and corrections."""
    axis = clock.select(F.explode(F.sequence(F.lit(hours - 1), F.lit(0), F.lit(-1))).alias("back"), F.date_trunc("HOUR", "now").cast("timestamp_ntz").alias("top"))
    axis = axis.select((F.col("top") - F.make_dt_interval(F.lit(0), F.col("back"))).alias("hour_start"))
    counted = in_window(events, clock, hours).groupBy(F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("hour")).agg(
        F.count_if(F.col("type").isin(*PROCESSED)).alias("docs"),
        F.sum(F.when(F.col("type") == CONFIRMED, F.col("fields_corrected")).otherwise(0)).alias("corrections"),
    )
    joined = axis.join(counted, F.col("hour_start") == F.col("hour"), "left")
    return joined.select(F.date_format("hour_start", "yyyy-MM-dd HH:00").alias("hour"), F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("corrections", F.lit(0)).alias("corrections"))


def totals(events: DataFrame, clock: DataFrame, hours: int = 24) -> DataFrame:
    done, confirmed = F.col("type").isin(*PROCESSED), F.col("type") == CONFIRMED
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    agg = in_window(events, clock, hours).agg(
        F.count_if(done).alias("docs_processed"), zero(F.sum(F.when(done, F.col("fields_total")))).alias("fields_extracted"),
        zero(F.sum(F.when(confirmed, F.col("fields_corrected")))).alias("fields_corrected"), F.count_if(confirmed).alias("confirms"),
        F.count_if(confirmed & F.col("manual_type_change")).alias("manual_type_changes"),
    )
    rate = F.coalesce(F.try_divide("fields_corrected", "fields_extracted"), F.lit(0.0))
    first = F.coalesce(F.try_divide(F.col("confirms") - F.col("manual_type_changes"), F.col("confirms")), F.lit(0.0))
    return agg.select("*", rate.alias("correction_rate"), first.alias("first_try_type_acc"))


def latency(events: DataFrame, clock: DataFrame, hours: int = 24) -> DataFrame:
    """Median (mean of the two middle ones) and nearest-rank 95th percentile; 0 without a value."""
    some = in_window(events, clock, hours).where(F.col("type").isin(*PROCESSED))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p95 = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_s)")
    return some.agg(zero(F.percentile("latency_s", F.lit(0.5))).alias("median_latency_s"), zero(p95).alias("p95_latency_s"), F.count("latency_s").alias("n"))


def corrections_by_category(events: DataFrame, clock: DataFrame, hours: int = 24) -> DataFrame:
    """All four categories, with 0 where nothing was corrected."""
    confirms = in_window(events, clock, hours).where(F.col("type") == CONFIRMED)
    keyed = confirms.where("corrected_key IS NOT NULL").select(C.correction_category(F.col("corrected_key")).alias("category"))
    changed = confirms.where("manual_type_change").select(F.lit("doc_type").alias("category"))
    dim = events.sparkSession.createDataFrame([(c,) for c in V.CATEGORIES], "category string")
    counted = keyed.union(changed).groupBy("category").agg(F.count("*").alias("n"))
    return F.broadcast(dim).join(counted, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("corrections"))


def stage_summary(calls: DataFrame) -> DataFrame:
    """doc_id, call_count, stages: each call's stage, or "call n" where that is null or empty."""
    label = F.coalesce(F.nullif(F.col("stage"), F.lit("")), F.concat(F.lit("call "), (F.col("seq") + 1).cast("string")))
    listed = calls.groupBy("doc_id").agg(F.count("*").alias("call_count"), F.array_sort(F.collect_list(F.struct("seq", label.alias("stage")))).alias("x"))
    return listed.select("doc_id", "call_count", F.array_join(F.transform("x", lambda s: s["stage"]), ",").alias("stages"))


def recent_runs(events: DataFrame, calls: DataFrame, limit: int = 20) -> DataFrame:
    """The last processed events by order of entry, with their traces where there are any."""
    n = max(1, min(V.RUNS_LIMIT, limit))
    runs = events.where(F.col("type").isin(*PROCESSED)).orderBy(F.desc("seq")).limit(n)
    # at most RUNS_LIMIT rows are broadcast, to pick their traces before those are gathered
    some = calls.join(F.broadcast(runs.select(F.col("raw_ref").alias("doc_id")).distinct()), "doc_id", "left_semi")
    joined = runs.join(stage_summary(some), F.col("raw_ref") == F.col("doc_id"), "left")
    return joined.select("seq", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "type", "latency_s", "raw_ref", F.col("doc_id").isNotNull().alias("raw_available"), "call_count", F.coalesce("stages", F.lit("")).alias("stages"))


def recency(hours: DataFrame, top: int = 3) -> DataFrame:
    """Marks the last ``top`` buckets."""
    rank = F.row_number().over(W.orderBy(F.desc("hour")))  # a few dozen buckets
    return hours.select("hour", "docs", (rank <= top).alias("recent"))
