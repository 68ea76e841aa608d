"""Client checklists, the review queue, statistics of the state, and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import fields as C
from paperloom.functions import tables as V

TERMINAL = ["extracted", "unrecognized", "confirmed", "error"]
REVIEW = ["extracted", "unrecognized", "error"]


def missing(expected: Column, received: Column) -> Column:
    """Expected and not received; order and repeats of the expected stay."""
    return F.filter(expected, lambda t: ~F.array_contains(received, t))


def also_received(expected: Column, received: Column) -> Column:
    return missing(received, expected)


def missing_docs(lists: DataFrame) -> DataFrame:
    m = missing(F.col("expected_docs"), F.col("received_docs"))
    return lists.select(F.col("id").alias("client_id"), F.array_join(m, ",").alias("missing"), F.size(m).cast("bigint").alias("n_missing"))


def progress(lists: DataFrame) -> DataFrame:
    """have, total, complete; a list that expects nothing is complete."""
    have = F.size(F.filter("expected_docs", lambda t: F.array_contains(F.col("received_docs"), t)))
    return lists.select(F.col("id").alias("client_id"), have.cast("bigint").alias("have"), F.size("expected_docs").cast("bigint").alias("total"), (have == F.size("expected_docs")).alias("complete"))


def checklist_rows(lists: DataFrame) -> DataFrame:
    rows = lists.select(F.col("id").alias("client_id"), "received_docs", F.posexplode("expected_docs").alias("pos", "doc_type"))
    return rows.select("client_id", F.col("pos").cast("bigint").alias("pos"), "doc_type", F.array_contains("received_docs", F.col("doc_type")).alias("received"))


def client_doc_meta(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """Per (client, type) of confirmed documents: the last one's date and number of corrected fields."""
    last = docs.where("status = 'confirmed'").groupBy("client_id", "doc_type").agg(F.max_by(F.struct("id", "received_at"), "seq").alias("d"))
    fixed = fields.where("corrected").groupBy("doc_id").agg(F.count("*").alias("n"))
    joined = last.join(fixed, F.col("d.id") == F.col("doc_id"), "left")
    return joined.select("client_id", "doc_type", F.col("d.id").alias("doc_id"), F.date_format("d.received_at", "yyyy-MM-dd").alias("received"), F.coalesce("n", F.lit(0)).alias("corrected_fields"))


def delete_guard(clients: DataFrame, docs: DataFrame) -> DataFrame:
    """How many documents hold on to each client; only clients without any may go."""
    held = docs.groupBy("client_id").agg(F.count("*").alias("n"))
    joined = clients.join(held, F.col("id") == F.col("client_id"), "left")
    return joined.select("id", F.coalesce("n", F.lit(0)).alias("doc_count"), F.col("n").isNull().alias("deletable"))


def unchecked_after_delete(docs: DataFrame, deleted: DataFrame) -> DataFrame:
    """(client_id, doc_type) that lose their check mark: no other confirmed document of theirs is left."""
    gone = docs.join(deleted, "id", "left_semi").where("client_id IS NOT NULL").select("client_id", "doc_type").distinct()
    left = docs.join(deleted, "id", "left_anti").where("status = 'confirmed'").select("client_id", "doc_type")
    return gone.join(left, ["client_id", "doc_type"], "left_anti")


def received_after_confirm(lists: DataFrame, confirms: DataFrame) -> DataFrame:
    """Checklists after confirms (client_id, doc_type): types are added once, at the end, UNRECOGNIZED never."""
    added = confirms.where(F.col("doc_type") != V.UNRECOGNIZED).groupBy("client_id").agg(F.array_sort(F.collect_set("doc_type")).alias("new"))
    joined = lists.join(added, F.col("id") == F.col("client_id"), "left")
    return joined.select("id", F.array_union("received_docs", F.coalesce("new", F.array().cast("array<string>"))).alias("received_docs"))


def queue_counts(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status").isin(TERMINAL)).alias("done"))


def correction_stats(docs: DataFrame, fields: DataFrame) -> DataFrame:
    known = docs.where("status <> 'unrecognized'").select("id")
    agg = fields.join(known, F.col("doc_id") == F.col("id"), "left_semi").agg(F.count("*").alias("fields_extracted"), F.count_if("corrected").alias("fields_corrected"))
    return agg.select("*", F.coalesce(F.try_divide("fields_corrected", "fields_extracted"), F.lit(0.0)).alias("correction_rate"))


def low_confidence_per_doc(docs: DataFrame, fields: DataFrame) -> DataFrame:
    low = fields.groupBy("doc_id").agg(F.count_if("low_confidence").alias("n_low"), F.count("*").alias("n_fields"))
    joined = docs.join(low, F.col("id") == F.col("doc_id"), "left")
    return joined.select("id", F.coalesce("n_low", F.lit(0)).alias("n_low"), F.coalesce("n_fields", F.lit(0)).alias("n_fields"))


def review_queue(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("status").isin(REVIEW)).select("seq", "id", "client_id", "status", "doc_type")


def op_summary(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count_if(F.col("status").isin(REVIEW)).alias("needs_review"), F.date_format(F.max("received_at"), "yyyy-MM-dd").alias("last_intake"))


def confirm_block_reason(docs: DataFrame, chosen: Column, affirmed: Column) -> DataFrame:
    """What keeps a document from being confirmed: no type chosen, or the client not affirmed."""
    no_type = F.coalesce(chosen, F.lit(V.UNRECOGNIZED)) == V.UNRECOGNIZED
    return docs.select("id", F.when(no_type, "choose a type").when(~affirmed, "affirm the client").otherwise("").alias("block_reason"))


def export_confirmed(clients: DataFrame, docs: DataFrame, fields: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each field of each confirmed document, one for a document without fields."""
    done = docs.where("status = 'confirmed'").select(F.col("id").alias("doc_id"), "client_id", "doc_type", "received_at", "seq")
    named = done.join(clients.select(F.col("id").alias("client_id"), F.col("name").alias("client_name")), "client_id")
    rows = named.join(fields, "doc_id", "left").join(F.broadcast(labels), F.col("key") == F.col("field_key"), "left")  # a fixed table of labels
    none = F.col("key").isNull()
    flag = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), "true").otherwise("false")
    return rows.select(
        "client_id", "client_name", "doc_id", "doc_type", F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("received_at"),
        F.when(none, "document").otherwise(F.col("key")).alias("field_key"),
        F.when(none, "Document received").otherwise(F.coalesce("field_label", "key")).alias("field_label"),
        F.when(none, F.col("doc_type")).otherwise(F.col("value").cast("string")).alias("value"),
        flag("corrected").alias("corrected"), F.when(F.col("corrected"), F.col("original_value")).otherwise("").alias("original_value"), flag("low_confidence").alias("low_confidence"),
    )


def wrap_fields(fields: DataFrame, retried: Column) -> DataFrame:
    """Plain key and value rows with the stored flags: nothing corrected, low_confidence by format or retry."""
    return fields.select("*", F.lit(False).alias("corrected"), C.field_low_confidence(F.col("key"), F.col("value"), retried).alias("low_confidence"))


def nudges(lists: DataFrame, drafts: DataFrame) -> DataFrame:
    """A reminder for each client that still owes documents: the draft (id, draft) if it passes, else the template."""
    m = missing(F.col("expected_docs"), F.col("received_docs"))
    owing = lists.withColumn("missing", m).where(F.size("missing") > 0).join(drafts, "id", "left")
    ok = F.coalesce(C.nudge_ok(F.col("draft"), F.col("name"), F.col("missing")), F.lit(False))
    return owing.select("id", F.when(ok, F.col("draft")).otherwise(C.nudge_template(F.col("name"), F.col("missing"))).alias("note"), F.when(ok, "model").otherwise("template").alias("generated_by"))


def mailto(lists: DataFrame) -> DataFrame:
    """A mail link with the missing documents in its body, CRLF between lines."""
    m = missing(F.col("expected_docs"), F.col("received_docs"))
    body = F.concat(F.lit("Hi "), F.col("name"), F.lit(",\r\n\r\n"), F.array_join(F.transform(m, lambda t: F.concat(F.lit("- "), t)), "\r\n"))
    return lists.where(F.size(m) > 0).select("id", F.concat(F.lit("mailto:?subject="), C.encode_component(F.lit("Missing documents")), F.lit("&body="), C.encode_component(body)).alias("href"))
