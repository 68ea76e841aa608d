"""The library's queries by name: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import fields as C
from paperloom.functions import tables as V
from paperloom.operators import checklist, dedup, evaluate, extraction, mutations, telemetry
from paperloom.plans import samples as S
from paperloom.sources import domain as D
from paperloom.streaming import inbox

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ROWS = list[tuple]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _log(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    events = D.events(spark, sf)
    return events, D.now_of(D.table(spark, sf, "events"))


def _array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _pick(values: list[str], n: Column) -> Column:
    """The n-th of the values, round and round."""
    return F.element_at(_array(values), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


# --- event log ---


@query
def timeline_hourly(spark, sf):
    return telemetry.hourly(*_log(spark, sf))


@query
def timeline_week(spark, sf):
    return telemetry.hourly(*_log(spark, sf), hours=168)


@query
def timeline_totals(spark, sf):
    return telemetry.totals(*_log(spark, sf))


@query
def timeline_latency(spark, sf):
    return telemetry.latency(*_log(spark, sf))


@query
def corrections_by_category(spark, sf):
    return telemetry.corrections_by_category(*_log(spark, sf))


@query
def first_try_accuracy(spark, sf):
    return telemetry.totals(*_log(spark, sf), hours=720).select("confirms", "manual_type_changes", "first_try_type_acc")


@query
def timeline_recency(spark, sf):
    return telemetry.recency(telemetry.hourly(*_log(spark, sf)))


@query
def recent_runs(spark, sf):
    return telemetry.recent_runs(D.events(spark, sf), D.trace_calls(spark, sf))


@query
def run_stage_summary(spark, sf):
    return telemetry.stage_summary(D.trace_calls(spark, sf))


@query
def trace_calls(spark, sf):
    return D.trace_calls(spark, sf).where("doc_id = 1").select("doc_id", "seq", "stage", F.substring("response", 1, 240).alias("head"))


@query
def trace_responses(spark, sf):
    return D.trace_calls(spark, sf).select("doc_id", "seq", "stage", "response", F.substring("response", 1, 240).alias("head"))


# --- state: queue, checklists, exports ---


@query
def all_clients(spark, sf):
    return D.clients(spark, sf)


@query
def document_by_id(spark, sf):
    return D.documents(spark, sf).where("id = 7").select("seq", "id", "client_id", "status", "doc_type")


@query
def documents_by_id(spark, sf):
    return D.documents(spark, sf).select("seq", "id", "client_id", "status", "doc_type")


@query
def queue_counts(spark, sf):
    return checklist.queue_counts(D.documents(spark, sf))


@query
def correction_stats(spark, sf):
    return checklist.correction_stats(D.documents(spark, sf), D.fields(spark, sf))


@query
def low_conf_per_doc(spark, sf):
    return checklist.low_confidence_per_doc(D.documents(spark, sf), D.fields(spark, sf))


@query
def client_missing_docs(spark, sf):
    return checklist.missing_docs(D.checklists(spark, sf))


@query
def client_also_received(spark, sf):
    lists = D.checklists(spark, sf).withColumn("expected_docs", _array(D.PRIORITIES[:2]))
    extra = checklist.also_received(F.col("expected_docs"), F.col("received_docs"))
    return lists.select(F.col("id").alias("client_id"), F.array_join(extra, ",").alias("also_received"))


@query
def checklist_progress(spark, sf):
    return checklist.progress(D.checklists(spark, sf))


@query
def checklist_rows(spark, sf):
    return checklist.checklist_rows(D.checklists(spark, sf))


@query
def client_doc_meta(spark, sf):
    return checklist.client_doc_meta(D.documents(spark, sf), D.fields(spark, sf))


@query
def client_delete_guard(spark, sf):
    return checklist.delete_guard(D.clients(spark, sf), D.documents(spark, sf))


def _discarded(spark, sf):
    return D.documents(spark, sf).where("id % 3 = 0 AND status = 'confirmed'").select("id")


@query
def uncheck_after_delete(spark, sf):
    return checklist.unchecked_after_delete(D.documents(spark, sf), _discarded(spark, sf))


@query
def received_after_confirm(spark, sf):
    confirms = D.documents(spark, sf).where("status = 'extracted'").select("client_id", "doc_type")
    out = checklist.received_after_confirm(D.checklists(spark, sf), confirms)
    return out.select("id", F.array_join("received_docs", ",").alias("received"))


@query
def received_after_discard(spark, sf):
    out = mutations.received_after_discard(D.checklists(spark, sf), D.documents(spark, sf), _discarded(spark, sf))
    return out.select("id", F.array_join("received_docs", ",").alias("received"))


def _exported(spark, sf):
    fields = D.fields(spark, sf).withColumn("original_value", F.lit("first read"))
    labels = spark.createDataFrame([("line_1", "First line"), ("line_2", "Second line")], "field_key string, field_label string")
    return checklist.export_confirmed(D.clients(spark, sf), D.documents(spark, sf), fields, labels)


@query
def export_confirmed_fields(spark, sf):
    return _exported(spark, sf)


@query
def export_fieldless(spark, sf):
    return _exported(spark, sf).where("field_key = 'document'").select("client_id", "doc_id", "value")


@query
def review_queue(spark, sf):
    return checklist.review_queue(D.documents(spark, sf))


@query
def op_summary(spark, sf):
    return checklist.op_summary(D.documents(spark, sf))


@query
def confirm_block_reason(spark, sf):
    chosen = F.when(F.col("id") % 4 != 0, F.when(F.col("id") % 4 == 1, V.UNRECOGNIZED).otherwise(F.col("doc_type")))
    return checklist.confirm_block_reason(D.documents(spark, sf), chosen, F.col("id") % 3 == 0)


@query
def nudge_notes(spark, sf):
    lists = D.checklists(spark, sf)
    m = F.array_join(checklist.missing(F.col("expected_docs"), F.col("received_docs")), ", ")
    draft = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Dear "), F.col("name"), F.lit(", please send "), m)).when(F.col("id") % 3 == 1, F.concat(F.lit("Hi [name], send "), m))
    return checklist.nudges(lists, lists.select("id", draft.alias("draft")))


@query
def nudge_mailto(spark, sf):
    return checklist.mailto(D.checklists(spark, sf))


# --- rules on fields ---


def _part(spark, sf):
    return D.table(spark, sf, "part").select("p_partkey")


@query
def normalize_doc_type(spark, sf):
    raw = _pick(S.DOC_TYPE_ANSWERS, F.col("p_partkey"))
    return _part(spark, sf).select("p_partkey", C.normalize_doc_type(raw).alias("doc_type"))


def _key_values(spark, sf):
    n = F.col("p_partkey")
    return _part(spark, sf).select("p_partkey", _pick(S.KEYS, n).alias("key"), _pick(S.VALUES, F.floor(n / len(S.KEYS)) + n).alias("value"))


@query
def field_format(spark, sf):
    return _key_values(spark, sf).select("p_partkey", "key", "value", C.field_format_ok(F.col("key"), F.col("value")).alias("ok"))


@query
def low_confidence(spark, sf):
    low = C.field_low_confidence(F.col("key"), F.col("value"), F.col("p_partkey") % 5 == 0)
    return _key_values(spark, sf).select("p_partkey", low.alias("low_confidence"))


@query
def parse_money(spark, sf):
    return _key_values(spark, sf).select("p_partkey", C.parse_money(F.col("value")).alias("amount"))


@query
def correction_category(spark, sf):
    kinds = C.correction_category(F.col("key")), C.is_money_key(F.col("key")), C.is_tin_key(F.col("key")), C.is_name_field(F.col("key"))
    return _key_values(spark, sf).select("p_partkey", *[k.alias(a) for k, a in zip(kinds, ("category", "money", "tin", "name"), strict=True)])


@query
def label_echo(spark, sf):
    return _key_values(spark, sf).select("p_partkey", C.looks_like_label(F.col("value")).alias("echo"))


@query
def norm_string(spark, sf):
    return _key_values(spark, sf).select("p_partkey", C.norm_string(F.col("value")).alias("norm"))


@query
def mask_tin(spark, sf):
    return _key_values(spark, sf).select("p_partkey", C.mask_tin(F.col("value")).alias("masked"), C.money_display(F.col("value")).alias("shown"))


@query
def slugify(spark, sf):
    return D.table(spark, sf, "customer").select("c_custkey", C.slugify(F.concat("c_name", F.lit(" & Sons, "), "c_mktsegment", F.lit("!"))).alias("slug"))


@query
def page_numbers(spark, sf):
    return _part(spark, sf).select("p_partkey", C.page_number(_pick(S.PAGES, F.col("p_partkey"))).alias("page"))


@query
def file_sizes(spark, sf):
    size = F.octet_length("text").cast("bigint") * F.lit(97) * (F.col("doc_id") % 13)
    return D.table(spark, sf, "documents").select("doc_id", C.file_size(size).alias("size"))


@query
def eligible_names(spark, sf):
    name = _pick(S.NAMES, F.col("p_partkey"))
    return _part(spark, sf).select("p_partkey", C.is_eligible(name, V.INBOX_EXTENSIONS).alias("inbox"), C.is_eligible(name, V.UPLOAD_EXTENSIONS).alias("upload"))


@query
def timestamps(spark, sf):
    text = _pick(S.TIMES, F.col("p_partkey"))
    return _part(spark, sf).select("p_partkey", F.date_format(C.parse_timestamp(text), "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query
def parse_model_json(spark, sf):
    o = C.parse_json(_pick(S.ANSWERS, F.col("p_partkey")))
    return _part(spark, sf).select("p_partkey", F.get_json_object(o, "$.doc_type").alias("doc_type"), o.isNotNull().alias("ok"))


@query
def seeds(spark, sf):
    return _part(spark, sf).select("p_partkey", F.substring(F.sha2(F.concat_ws(":", F.lit("7"), F.col("p_partkey").cast("string")), 256), 1, 16).alias("seed_hex"))


# --- duplicates ---


def _payloads(spark, sf):
    return D.table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.col("text").alias("content"))


def _prints(spark, sf):
    return dedup.fingerprints(D.table(spark, sf, "embeddings").select(F.col("vec_id").alias("seq"), "label", F.col("embedding").alias("vec")))


@query
def exact_duplicates(spark, sf):
    return dedup.exact_duplicates(_payloads(spark, sf))


@query
def near_duplicates(spark, sf):
    return dedup.ranked_candidates(_prints(spark, sf)).where("rank = 1").select("seq", F.col("cand").alias("duplicate_of"), "distance")


@query
def near_duplicates_banded(spark, sf):
    return dedup.candidate_pairs(_prints(spark, sf))


@query
def near_duplicates_confirmed(spark, sf):
    return dedup.near_duplicates(_prints(spark, sf), delta=0.2, cutoff=24)


@query
def dedup_calibration(spark, sf):
    return dedup.calibration(_prints(spark, sf))


@query
def closest_pairs(spark, sf):
    return dedup.closest_pairs(_prints(spark, sf))


@query
def dedup_floors(spark, sf):
    return dedup.floors(_prints(spark, sf))


@query
def closest_pairs_by_label(spark, sf):
    return dedup.closest_by_label(_prints(spark, sf))


@query
def dangling_refs(spark, sf):
    flags = dedup.exact_duplicates(_payloads(spark, sf)).select("seq", "duplicate_of")
    return dedup.cleared_references(flags, _payloads(spark, sf).where("seq % 5 = 0").select(F.col("seq").alias("id")))


@query
def resolved_duplicates(spark, sf):
    flags = dedup.exact_duplicates(_payloads(spark, sf)).select("seq", "duplicate_of")
    return mutations.resolve_duplicates(flags, _payloads(spark, sf).where("seq % 2 = 0").select(F.col("seq").alias("id")))


# --- evaluation ---


def _truth(spark, sf):
    """Labelled fields, and predictions by rule: wrong or missing now and then."""
    lines = D.fields(spark, sf)
    file = F.concat(F.when(F.col("doc_id") % 7 == 0, "hand_").otherwise("doc_"), F.col("doc_id").cast("string"))
    money = F.format_string("%.2f", "value")
    truth = lines.select(file.alias("file"), "key", money.alias("expected"))
    n = F.col("doc_id") + F.col("pos")
    read = F.when(n % 5 == 0, F.format_string("%.2f", F.col("value") + 1)).when(n % 11 == 0, "").otherwise(F.concat(F.lit("$"), money))
    predicted = lines.where((F.col("doc_id") + F.col("pos")) % 13 != 0).select(file.alias("file"), "key", read.alias("predicted"), "low_confidence")
    return truth, predicted


@query
def eval_field_scores(spark, sf):
    return evaluate.field_scores(*_truth(spark, sf)).select("file", "key", "verdict")


def _runs(spark, sf):
    n = F.col("id")
    file = F.concat(F.when(n % 7 == 0, "hand_").otherwise("doc_"), n.cast("string"))
    return D.documents(spark, sf).select(file.alias("file"), F.col("doc_type").alias("expected_type"), F.when(n % 9 == 0, V.UNRECOGNIZED).otherwise(F.col("doc_type")).alias("predicted_type"), (n % 100 / 4.0).cast("double").alias("latency_s"))


@query
def eval_summary(spark, sf):
    return evaluate.summary(evaluate.field_scores(*_truth(spark, sf)), _runs(spark, sf))


@query
def flag_coverage(spark, sf):
    return evaluate.flag_coverage(evaluate.field_scores(*_truth(spark, sf)))


@query
def ensemble_agreement(spark, sf):
    n = F.col("pos")
    reads = D.fields(spark, sf).select("doc_id", F.when(n % 2 == 0, "box1_wages").otherwise("payer").alias("key"), F.format_string("%.2f", "value").alias("a"), F.when(n == 3, "").otherwise(F.format_string("$%.1f", "value")).alias("b"))
    return evaluate.ensemble_agreement(reads)


# --- extraction over canned answers ---


def _w2(spark, sf):
    """Five fields of a form for each order, values by rule."""
    forms = D.documents(spark, sf).select("id", F.lit("W-2").alias("doc_type"))
    rows = forms.select("id", "doc_type", F.posexplode(_array(V.FIELD_SCHEMA["W-2"])).alias("pos", "key"))
    value = _pick(S.VALUES, F.col("id") * 3 + F.col("pos") * 7)
    return rows.select("id", "doc_type", "pos", "key", value.alias("value"), (F.col("id") % 10 == 0).alias("retried"))


def _answers(spark, sf):
    return _w2(spark, sf).select("id", "key", _pick(S.VALUES, F.col("id") + F.col("pos") * 5 + 1).alias("answer"))


@query
def full_low_confidence(spark, sf):
    return extraction.flags(_w2(spark, sf)).select("id", "key", "low_confidence")


@query
def reask_budget(spark, sf):
    return extraction.reask_plan(_w2(spark, sf)).select("id", "key", "call")


@query
def reask_applied(spark, sf):
    return extraction.reasked(_w2(spark, sf), _answers(spark, sf)).select("id", "key", "value")


@query
def region_pass(spark, sf):
    return extraction.region_pass(_w2(spark, sf), _answers(spark, sf), V.dim_region(spark)).select("id", "key", "value", "replaced")


@query
def extraction_pipeline(spark, sf):
    n = F.col("id")
    docs = D.documents(spark, sf).select(
        "id", _pick(S.ANSWERS, n).alias("class_raw1"), _pick(S.ANSWERS, n + 1).alias("class_raw2"), _pick(S.FIELD_ANSWERS, n).alias("fields_raw1"), _pick(S.FIELD_ANSWERS, n + 1).alias("fields_raw2"))
    return extraction.run_pipeline(docs, V.dim_field_schema(spark))


def _pages(spark, sf):
    n = F.col("id")
    return D.documents(spark, sf).select("id", F.lit("W-2").alias("doc_type"), (n % 3000 + 5).cast("int").alias("width"), (n % 1700 + 9).cast("int").alias("height"))


@query
def reading_views(spark, sf):
    return extraction.views(_pages(spark, sf)).groupBy("id").agg(F.count("*").alias("views"), F.sum("x1").alias("right_edges"), F.min("y0").alias("top"))


@query
def crop_boxes(spark, sf):
    return extraction.crop_boxes(_pages(spark, sf), V.dim_region(spark)).select("id", "field", "left", "top", "right", "bottom", F.col("scale").isNull().alias("too_small"))


@query
def pdf_pages(spark, sf):
    files = _part(spark, sf).select(
        _pick(S.NAMES, F.col("p_partkey")).alias("plain"), F.col("p_partkey").cast("string").alias("n"), F.when(F.col("p_partkey") % 2 == 0, "%PDF-1.7").otherwise("PNG").alias("head"),
        (F.col("p_partkey") % 25).cast("int").alias("n_pages"), (F.col("p_partkey") % 900 + 100).cast("double").alias("width_pt"), F.lit(800.0).alias("height_pt"))
    return extraction.render_plan(files.withColumn("name", F.concat("n", F.lit("_"), "plain"))).select("name", "page_number", "error")


# --- changes of state ---


def _fields(spark, sf):
    return D.fields(spark, sf).select("doc_id", "key", F.format_string("%.2f", "value").alias("value"), "corrected", F.when(F.col("corrected"), "old").alias("original_value"), "low_confidence")


def _confirms(spark, sf):
    """Two rounds of confirms: the second goes back on some, and adds a key."""
    lines = D.fields(spark, sf).where("doc_id % 2 = 0")
    money = F.format_string("%.2f", "value")
    one = lines.select(F.col("doc_id").alias("seq"), "doc_id", "key", F.when(F.col("pos") % 2 == 0, F.concat(money, F.lit("0"))).otherwise(money).alias("value"))
    two = lines.where("pos < 4").select((F.col("doc_id") + 1_000_000_000).alias("seq"), "doc_id", "key", F.when(F.col("pos") == 2, money).otherwise("new").alias("value"))
    extra = lines.where("pos = 1").select((F.col("doc_id") + 1_000_000_000).alias("seq"), "doc_id", F.lit("note").alias("key"), F.when(F.col("doc_id") % 4 == 0, "x").alias("value"))
    return one.union(two).union(extra)


@query
def confirmed_fields(spark, sf):
    return mutations.confirm_fields(_fields(spark, sf), _confirms(spark, sf))


@query
def confirm_events(spark, sf):
    return mutations.confirm_events(_fields(spark, sf), _confirms(spark, sf))


@query
def confirmed_documents(spark, sf):
    docs = D.documents(spark, sf).select("id", "status", "doc_type", "client_id")
    some = docs.where("id % 5 = 0").select(F.col("id").alias("seq"), "id", F.lit("W-2").alias("doc_type"), (F.col("client_id") + 1).alias("client_id"))
    return mutations.confirm_documents(docs, some.union(some.where("id % 10 = 0").select(F.col("seq") + 1_000_000_000, "id", F.lit("K-1"), "client_id")))


@query
def reopened_documents(spark, sf):
    docs = D.documents(spark, sf).select("id", "status")
    return mutations.reopen(docs, docs.where("id % 2 = 0").select("id"))


@query
def discarded_documents(spark, sf):
    return mutations.discard(D.documents(spark, sf).select("id", "status"), _discarded(spark, sf))


@query
def patched_clients(spark, sf):
    lists = D.checklists(spark, sf).select("id", "name", "expected_docs")
    patches = lists.where("id % 2 = 0").select(F.col("id").alias("seq"), "id", F.when(F.col("id") % 4 == 0, F.concat(F.col("name"), F.lit(" Ltd"))).alias("name"), F.when(F.col("id") % 6 == 0, _array(["b", "a", "b"])).alias("expected_docs"))
    return mutations.patch_clients(lists, patches).select("id", "name", F.array_join("expected_docs", ",").alias("expected"))


@query
def deleted_clients(spark, sf):
    clients = D.clients(spark, sf)
    return mutations.delete_clients(clients, D.documents(spark, sf), clients.where("id % 2 = 0").select("id")).select("id", "name")


def _named(spark, sf):
    """Names that meet: by market segment and a number."""
    n = F.col("c_custkey")
    return D.table(spark, sf, "customer").select(n.alias("seq"), F.concat("c_mktsegment", F.when(n % 7 == 0, " 2").when(n % 11 == 0, "!").otherwise("")).alias("name"))


@query
def client_id_mint(spark, sf):
    taken = spark.createDataFrame([("client_building",), ("client_building_3",), ("client_machinery_2",)], "id string")
    return mutations.mint_client_ids(_named(spark, sf), taken)


def _import(spark, sf):
    n = F.col("c_custkey")
    rows = D.table(spark, sf, "customer").select(n.alias("seq"), F.when(n % 10 == 0, "  ").when(n % 3 == 0, F.upper(F.concat(F.lit(" "), "c_name"))).otherwise(F.concat(F.lit("New "), F.floor(n / 2).cast("string"))).alias("name"))
    return mutations.import_plan(rows, D.table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_name").alias("name")))


@query
def csv_import_plan(spark, sf):
    return _import(spark, sf)


@query
def csv_import_counts(spark, sf):
    return mutations.import_counts(_import(spark, sf))


# --- watched folder, as batches ---


@query
def inbox_exactly_once(spark, sf):
    docs = D.table(spark, sf, "documents")
    name = F.format_string("%08d.png", "doc_id")
    batch = docs.where("doc_id % 3 <> 0").select(name.alias("name"), F.lit(None).cast("timestamp").alias("at"), F.col("text").cast("binary").alias("content"))
    ledger = docs.where("doc_id % 3 = 0").select(F.sha2("text", 256).alias("sha256")).distinct()
    return inbox.admit(batch, ledger).select("sha256", "name", "outcome")


@query
def inbox_stability(spark, sf):
    polls = D.table(spark, sf, "events").select(F.col("event_id").alias("poll"), (F.col("event_id") % 50).cast("string").alias("name"), F.col("user_id").alias("size"), F.lit(0).alias("mtime"))
    polls = polls.withColumns({"name": (F.floor(F.col("poll") / 4) % 50).cast("string"), "size": F.floor(F.col("size") / 75)})
    return inbox.stable(polls).select("poll", "name", "stable")
