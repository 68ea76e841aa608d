"""Hours added up are as the log scanned, however it is split."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from paperloom.operators import telemetry
from paperloom.streaming import hours

EVENT = "seq bigint, ts timestamp_ntz, type string, latency_s double, fields_total bigint, fields_corrected bigint, manual_type_change boolean, corrected_key string"


def made(r, n, now):
    return [(k, r.choice([None, now]) if k < 2 else now - timedelta(seconds=r.randrange(200_000)), r.choice(["extracted", "unrecognized", "confirmed", "error", None]), r.choice([None, 1.0, 2.5, r.random() * 9]),
             r.choice([None, 3, 8]), r.choice([None, 0, 2]), r.choice([None, True, False]), r.choice([None, "ssn", "box1_wages", "payer"])) for k in range(n)]


def plain(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in df.collect())


@pytest.mark.parametrize("now", [datetime(2026, 7, 2, 13, 17, 5, 250), datetime(2026, 7, 2, 13)])
def test_any_split_is_as_the_whole_log(spark, tmp_path, now):
    r = random.Random(now.minute)
    rows = made(r, 700, now)
    rows[0] = (0, now, *rows[0][2:])
    log = spark.createDataFrame(rows, EVENT)
    clock = log.agg(F.max("ts").alias("now"))
    path, parts = str(tmp_path / "h"), [[] for _ in range(4)]
    for x in rows:
        r.choice(parts).append(x)  # late ones among them
    for n, part in enumerate(parts):
        hours.keep_batch(spark.createDataFrame(part, EVENT), path, n)
        if n == 1:
            hours.keep_batch(spark.createDataFrame(part, EVENT), path, n)  # runs again
            hours.compacted(spark, path)
    held = hours.stored(spark, path)
    for span in (24, 40):
        window = hours.in_window(held, log, span)
        assert plain(hours.totals(window)) == plain(telemetry.totals(log, clock, span))
        assert plain(hours.latency(window, 3)) == plain(telemetry.latency(log, clock, span))
        assert plain(hours.categories(window)) == plain(telemetry.corrections_by_category(log, clock, span))
    assert plain(hours.hourly(held)) == plain(telemetry.hourly(log, clock))


def test_a_stream_into_the_store(spark, tmp_path):
    rows = made(random.Random(3), 60, datetime(2026, 7, 2, 13, 17))[2:]
    for n in range(3):  # each file a batch or part of one; a stream that starts again goes on
        spark.createDataFrame(rows[n::3], EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        hours.keep_hours(spark.readStream.schema(EVENT).parquet(str(tmp_path / "log")), str(tmp_path / "h"), str(tmp_path / "mark")).awaitTermination()
    assert plain(hours.stored(spark, str(tmp_path / "h")).where("measure = 'docs'").select("hour", "n")) == plain(hours.cells(spark.createDataFrame(rows, EVENT)).where("measure = 'docs'").select("hour", "n"))


def test_an_empty_store(spark, tmp_path):
    none = spark.createDataFrame([], EVENT)
    held = hours.stored(spark, str(tmp_path / "none"))
    window = hours.in_window(held, none, 24)
    assert hours.totals(window).first()["docs_processed"] == 0 and tuple(hours.latency(window).first()) == (0.0, 0.0, 0) and hours.hourly(held).count() == 0
