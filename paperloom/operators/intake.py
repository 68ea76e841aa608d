"""New documents and what a run leaves behind: ids, fingerprints, failures, traces before statuses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import fields as C
from paperloom.functions import tables as V

#: Hex digits of a whole fingerprint; shorter ones are of an older kind.
PRINT_DIGITS = 64
#: Calls of a model until a failure counts.
TRIES = 4


def numbered(rows: DataFrame, first: int, order: list[str]) -> DataFrame:
    """``rows`` with ``number`` from ``first`` on, in ``order``; no task holds more than one range of them."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    dealt = dealt.checkpoint() if spark.sparkContext.getCheckpointDir() else dealt.persist()
    part = F.shiftright("at", 33)
    sizes = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.selectExpr("part", "sum(n) OVER (ORDER BY part) - n AS before")  # one row a partition
    joined = dealt.join(F.broadcast(before), part == F.col("part"))
    return joined.select(*rows.columns, (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.lit(first)).alias("number"))


def created_documents(payloads: DataFrame, last: int, at: Column) -> DataFrame:
    """Pending documents of payloads (seq, name, source, page_number, source_file, phash, duplicate_of), in order of seq.

    Ids go on from ``last``; the source is only kept for the watched folder.
    """
    end = F.lower(F.regexp_extract(F.coalesce("name", F.lit("")), r"(\.[^./]*)$", 1))
    new = numbered(payloads, last + 1, ["seq"])
    doc_id = F.concat(F.lit("doc_"), F.when(F.col("number") < 1000, F.lpad(F.col("number").cast("string"), 3, "0")).otherwise(F.col("number").cast("string")))
    path = F.concat(F.lit("uploads/"), F.col("id"), F.when(end.isin(V.UPLOAD_EXTENSIONS), end).otherwise(".png"))
    named = new.withColumn("id", doc_id)
    return named.select(
        "seq", "id", F.lit(None).cast("string").alias("client_id"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("doc_type"), path.alias("image_path"), at.alias("received_at"),
        F.nullif(F.col("name"), F.lit("")).alias("source_name"), "phash", "duplicate_of", F.when(F.col("source") == "folder", "folder").alias("source"), "page_number", "source_file")


def created_clients(names: DataFrame, ids: DataFrame, expected: Column) -> DataFrame:
    """Rows of new clients (seq, name) with their minted ids (seq, client_id); nothing is received yet."""
    return names.join(ids, "seq").select("seq", F.col("client_id").alias("id"), "name", expected.alias("expected_docs"), F.array().cast("array<string>").alias("received_docs"))


def upgraded_prints(docs: DataFrame, recomputed: Column) -> DataFrame:
    """Documents with whole fingerprints: missing and short ones give way to the recomputed; those without either go."""
    whole = F.when(F.length("phash") == PRINT_DIGITS, F.col("phash")).otherwise(F.when(F.length(recomputed) == PRINT_DIGITS, recomputed))
    return docs.withColumn("phash", whole).where("phash IS NOT NULL")


def asked(df: DataFrame, model_fn: Callable[[str, str], str], key: str, prompt: str, tries: int = TRIES, waits: float = 0.0) -> DataFrame:
    """``df`` with ``answer`` and ``error``: a call that fails ``tries`` times is an error of its row, not of the job."""
    import time

    @F.pandas_udf("answer string, error string")
    def call(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for keys, prompts in batches:
            out = []
            for k, p in zip(keys, prompts, strict=True):
                said, error = None, None
                for attempt in range(tries):
                    try:
                        said, error = model_fn(k, p), None
                        break
                    except Exception as e:  # whatever the model's client raises: it becomes the row's error
                        error = f"{type(e).__name__}: {e}"
                        if attempt + 1 < tries and waits:
                            time.sleep(waits)
                out.append((said, error))
            yield pd.DataFrame(out, columns=["answer", "error"])

    return df.withColumn("held", call(F.col(key), F.col(prompt))).select("*", "held.answer", "held.error").drop("held")


def settled(results: DataFrame) -> DataFrame:
    """id, status, doc_type, error: a failed call is an error, which is another thing than an unrecognised document."""
    failed = F.col("error").isNotNull()
    return results.select(
        "id", F.when(failed, "error").otherwise(F.col("status")).alias("status"), F.when(failed, V.UNRECOGNIZED).otherwise(F.col("doc_type")).alias("doc_type"), "error")


def write_run(traces: DataFrame, documents: DataFrame, events: DataFrame, path: str, batch: int) -> None:
    """Writes a batch's traces, then its documents, then its events: who sees a status finds its trace.

    For ``foreachBatch``: each batch has a folder of its own, so one that is run again replaces itself.
    """
    for name, rows in (("traces", traces), ("documents", documents), ("events", events)):
        rows.write.mode("overwrite").json(f"{path}/{name}/batch={batch}")


def disputed(reads: DataFrame) -> DataFrame:
    """Fields (doc_id, key, value) after a second read (other): the value stays, every field is marked for review.

    disputed: the second read is empty or says something else.
    """
    second = F.trim(F.coalesce("other", F.lit("")))
    agrees = (second != "") & C.fields_agree(F.col("key"), F.col("value"), second)
    return reads.select("doc_id", "key", "value", F.lit(True).alias("low_confidence"), (~F.coalesce(agrees, F.lit(False))).alias("disputed"))
