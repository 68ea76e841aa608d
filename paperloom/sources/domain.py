"""The benchmark tables as the document-intake domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
CORRECTED_KEYS = ["box1_wages", "ssn", "payer", "partnership_ein"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "extracted").otherwise("pending")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("client_id"), status.alias("status"),
        F.col("o_orderpriority").alias("doc_type"), F.col("o_orderdate").alias("received_at"),
    )


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos")).agg(
        F.min("l_extendedprice").alias("value"), F.bool_or(F.col("l_returnflag") == "R").alias("corrected"), F.bool_or(F.col("l_discount") > 0.07).alias("low_confidence"),
    ).withColumn("key", F.concat(F.lit("line_"), F.col("pos").cast("string")))


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


def received(spark: SparkSession, sf_dir: str) -> DataFrame:
    """client_id, received_docs: sorted distinct types of the client's confirmed documents."""
    done = documents(spark, sf_dir).where("status = 'confirmed'")
    return done.groupBy("client_id").agg(F.array_sort(F.collect_set("doc_type")).alias("received_docs"))


def checklists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients with expected_docs and received_docs (empty if none)."""
    expected = F.array(*[F.lit(p) for p in PRIORITIES])
    joined = clients(spark, sf_dir).join(received(spark, sf_dir), F.col("id") == F.col("client_id"), "left").drop("client_id")
    return joined.select("seq", "id", "name", expected.alias("expected_docs"), F.coalesce("received_docs", F.array().cast("array<string>")).alias("received_docs"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for x in ("view", "extracted", "click", "extracted", "error", "error", "purchase", "confirmed", "signup", "unrecognized")])
    k = F.get_json_object("props", "$.k").cast("bigint")
    raw = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "ts", kind[F.col("event_type")].alias("type"), F.col("value").alias("latency_s"), F.col("user_id").alias("raw_ref"), k.alias("fields_total"))
    key = F.element_at(F.array(*[F.lit(x) for x in CORRECTED_KEYS]), (F.col("fields_total") % 4 + 1).cast("int"))
    return raw.withColumns({"fields_corrected": F.col("fields_total") % 4, "manual_type_change": F.col("fields_total") % 10 == 0}).withColumn("corrected_key", F.when(F.col("fields_corrected") > 0, key))


def trace_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.when(F.col("role") != "system", F.col("role")).alias("stage"), F.col("text").alias("response"))


def now_of(found: DataFrame) -> DataFrame:
    """One row: the clock, the latest event's time."""
    return found.agg(F.max("ts").alias("now"))
