"""Reports as the intake's own screens show them: rounded totals, listed corrections, runs, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.functions import fields as C
from paperloom.functions import tables as V
from paperloom.operators.telemetry import CONFIRMED, PROCESSED, in_window


def percent(x: Column, digits: int = 1) -> Column:
    """A share as text: 12.3%, or 12% without digits (halves up)."""
    if not digits:
        return F.concat(F.floor(x * 100 + 0.5).cast("string"), F.lit("%"))
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f%%", F.round(x * 100, digits)))


def report_totals(events: DataFrame, clock: DataFrame, hours: int = 24) -> DataFrame:
    """One row: counts, rates to four places and latencies to two; 0 where there is nothing to divide."""
    done, confirmed = F.col("type").isin(*PROCESSED), F.col("type") == CONFIRMED
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("bigint")
    latency = F.when(done, F.col("latency_s"))
    agg = in_window(events, clock, hours).agg(
        F.count_if(done).alias("docs_processed"), total("fields_total", done).alias("fields_extracted"), total("fields_low_confidence", done).alias("fields_low_confidence"),
        total("fields_corrected", confirmed).alias("fields_corrected"), F.count_if(confirmed).alias("confirms"), F.count_if(confirmed & F.col("manual_type_change")).alias("changes"),
        F.percentile(latency, F.lit(0.5)).alias("median"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY CASE WHEN type IN {PROCESSED} THEN latency_s END)").alias("p95"),
    )
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    return agg.select(
        "docs_processed", "fields_extracted", "fields_low_confidence", "fields_corrected", rate("fields_corrected", "fields_extracted").alias("correction_rate"),
        rate(F.col("confirms") - F.col("changes"), F.col("confirms")).alias("first_try_type_acc"),
        F.round(F.coalesce("median", F.lit(0.0)), 2).alias("median_latency_s"), F.round(F.coalesce("p95", F.lit(0.0)), 2).alias("p95_latency_s"))


def report_categories(events: DataFrame, clock: DataFrame, hours: int = 24) -> DataFrame:
    """All four categories; each of an event's ``corrected_keys`` counts."""
    confirms = in_window(events, clock, hours).where(F.col("type") == CONFIRMED)
    keyed = confirms.select(F.explode("corrected_keys").alias("key")).select(C.correction_category(F.col("key")).alias("category"))
    changed = confirms.where("manual_type_change").select(F.lit("doc_type").alias("category"))
    dim = events.sparkSession.createDataFrame([(c,) for c in V.CATEGORIES], "category string")
    counted = keyed.union(changed).groupBy("category").agg(F.count("*").alias("n"))
    return F.broadcast(dim).join(counted, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("corrections"))


def low_confidence_share(totals: DataFrame) -> DataFrame:
    """low_confidence of ``report_totals`` as text, to one place and as a whole number; "0%" without a field."""
    share = F.try_divide("fields_low_confidence", "fields_extracted")
    zero = lambda c: F.coalesce(c, F.lit("0%"))
    return totals.select(zero(percent(share)).alias("low"), zero(percent(share, 0)).alias("low_whole"))


def correction_stats(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """fields_extracted, fields_corrected, correction_rate to four places; unrecognised documents' fields don't count."""
    seen = fields.join(docs.where("status <> 'unrecognized'").select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    agg = seen.agg(F.count("*").alias("fields_extracted"), F.count_if("corrected").alias("fields_corrected"))
    return agg.select("*", F.round(F.coalesce(F.try_divide("fields_corrected", "fields_extracted"), F.lit(0.0)), 4).alias("correction_rate"))


def runs(events: DataFrame, traces: DataFrame, limit: int = 20, runtime: str = "ollama") -> DataFrame:
    """The last processed documents, newest (rank 1) first: eleven columns, with what their traces add.

    events: seq, type, doc_id, doc_type, model, latency_s, preprocessed, retried, raw_ref; traces:
    raw_ref, model_runtime, calls (an array of structs with seq and stage). Without a trace the
    runtime is ``runtime``, call_count null and stages empty.
    """
    n = max(1, min(V.RUNS_LIMIT, limit))
    last = events.where(F.col("type").isin(*PROCESSED)).orderBy(F.desc("seq")).limit(n)
    last = last.withColumn("rank", F.row_number().over(W.orderBy(F.desc("seq"))).cast("bigint"))  # at most RUNS_LIMIT rows
    label = lambda c, i: F.coalesce(F.nullif(c["stage"], F.lit("")), F.concat(F.lit("call "), F.coalesce(c["seq"], i + 1).cast("string")))
    found = traces.select("raw_ref", "model_runtime", F.size("calls").cast("bigint").alias("call_count"), F.transform("calls", label).alias("stages"))
    # at most RUNS_LIMIT rows are broadcast, to pick their traces
    found = found.join(F.broadcast(last.select("raw_ref").distinct()), "raw_ref", "left_semi").withColumn("raw_available", F.lit(True))
    joined = last.join(found, "raw_ref", "left")
    return joined.select(
        "rank", "doc_id", "doc_type", F.col("type").alias("status"), F.coalesce("model_runtime", F.lit(runtime)).alias("model_runtime"), F.col("model").alias("model_name"), "latency_s", "preprocessed",
        F.coalesce("retried", F.lit(False)).alias("retried"), "call_count", F.coalesce("stages", F.array().cast("array<string>")).alias("stages"), F.coalesce("raw_available", F.lit(False)).alias("raw_available"))


def duplicate_badges(docs: DataFrame) -> DataFrame:
    """id and the badge of documents (id, duplicate_of) that may be duplicates."""
    return docs.where("duplicate_of IS NOT NULL").select("id", F.concat(F.lit("Possible duplicate of "), F.col("duplicate_of").cast("string")).alias("badge"))


def assigned_batches(members: DataFrame, docs: DataFrame) -> DataFrame:
    """batch, assigned: whether any document of the batch (batch, id) has a client by now."""
    known = docs.where("client_id IS NOT NULL").select("id", F.lit(True).alias("has"))
    return members.join(known, "id", "left").groupBy("batch").agg(F.coalesce(F.bool_or("has"), F.lit(False)).alias("assigned"))


def by_name(files: DataFrame) -> DataFrame:
    """Files in the order of their names' bytes."""
    return files.orderBy("name")


def preview(names: DataFrame, most: int = 6) -> DataFrame:
    """One row: the first names (seq, name), "+k more" behind them, or that there is nothing to import."""
    first = names.orderBy("seq").limit(most).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "name"))), lambda x: x["name"]).alias("shown"))
    both = first.crossJoin(F.broadcast(names.agg(F.count("*").alias("n"))))  # two single rows
    more = F.when(F.col("n") > most, F.concat(F.lit(" +"), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise("")
    return both.select("n", F.when(F.col("n") == 0, "Every row is already a client.").otherwise(F.concat(F.array_join("shown", ", "), more)).alias("line"))


def chosen(files: DataFrame, names: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The files to evaluate: those named, in order of name, and of these the first ``limit``."""
    some = files.where(F.col("file").isin(names)) if names else files
    return some.orderBy("file").limit(limit) if limit else some


def reminder_prompt(name: Column, missing: Column) -> Column:
    """What a model is asked for a reminder: the client, the documents verbatim, and what it may not add."""
    listed = F.array_join(F.transform(missing, lambda m: F.concat(F.lit("- "), m)), "\n")
    return F.concat(
        F.lit("Write a short, professional reminder to the client "), name, F.lit(" of a tax preparation firm. Greet them by name and ask for exactly these documents, word for word, one a line:\n"), listed,
        F.lit(f"\nAdd no deadline, amount, fee or placeholder such as [Date]. At most {V.NUDGE_MAX_CHARS} characters. Return the note alone."))


def classify_prompt() -> str:
    types = ", ".join(f'"{t}"' for t in V.EXTRACT_TYPES + V.CLASSIFY_ONLY_TYPES)
    return f'Which tax document is this? Answer in JSON only: {{"doc_type": "<TYPE>", "handwritten": true}}. TYPE is one of {types}, or "{V.UNRECOGNIZED}" if it is not clearly one of them. handwritten says whether the entries, not the form, are written by hand.'


def extract_prompts(schema: DataFrame) -> DataFrame:
    """doc_type, prompt: the fields of a type in the order of its schema (doc_type, pos, key)."""
    shape = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "key"))), lambda x: F.concat(F.lit('"'), x["key"], F.lit('": "..."'))), ", ")
    asked = F.concat(F.lit("This is a "), F.col("doc_type"), F.lit(" form. Return its values as printed, in JSON only: {"), F.col("shape"), F.lit('}. A field that is not there is "".'))
    return schema.groupBy("doc_type").agg(shape.alias("shape")).select("doc_type", asked.alias("prompt"))


def field_prompt(doc_type: Column, what: Column, cropped: bool = False) -> Column:
    """The question for one field, of the whole page or of a crop of it."""
    seen = "This is a part of a " if cropped else "This is a "
    return F.concat(F.lit(seen), doc_type, F.lit(" form. Read only "), what, F.lit(', not its label. Answer in JSON only: {"value": "..."}, with the value as printed, or "" if it is not there.'))
