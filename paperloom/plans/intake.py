"""Queries of reports, intake and evaluation over the benchmark tables, and SQL for another engine.

The SQL states its tables and rules in full, without the engine's own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import fields as C
from paperloom.functions import tables as V
from paperloom.operators import checklist, dedup, evaluate, intake, reports
from paperloom.plans.queries import _array, _log, _payloads, _pick, query
from paperloom.sources import domain as D

SQL: dict[str, str] = {}
KEYS = ["box1_wages", "ssn", "payer", "partnership_ein"]
TYPES = ["W-2", "K-1", "1098"]


def _events(spark, sf):
    """The log with listed corrections and what a run leaves in it."""
    events, clock = _log(spark, sf)
    n, k = F.col("seq"), F.col("fields_total")
    ref = F.concat(F.lit("raws/"), F.col("raw_ref").cast("string"), F.lit(".json"))
    return events.select(
        "seq", "ts", "type", "latency_s", F.concat(F.lit("doc_"), n.cast("string")).alias("doc_id"), _pick(TYPES, n).alias("doc_type"), F.concat(F.lit("m"), (n % 2).cast("string")).alias("model"), (n % 2 == 0).alias("preprocessed"),
        F.when(n % 5 != 0, n % 5 == 1).alias("retried"), ref.alias("raw_ref"), "fields_total", (k % 3).alias("fields_low_confidence"), "fields_corrected", "manual_type_change",
        F.slice(_array(KEYS), F.lit(1), (k % 4).cast("int")).alias("corrected_keys")), clock


def _traces(spark, sf):
    call = F.struct((F.col("turn") + 1).alias("seq"), F.when(F.col("role") != "system", F.col("role")).alias("stage"))
    found = D.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(call)).alias("calls"))
    return found.select(F.concat(F.lit("raws/"), F.col("conv_id").cast("string"), F.lit(".json")).alias("raw_ref"), F.concat(F.lit("rt"), (F.col("conv_id") % 2).cast("string")).alias("model_runtime"), "calls")


LOG = """log AS (SELECT event_id AS seq, ts, value AS latency_s, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  CASE event_type WHEN 'view' THEN 'extracted' WHEN 'click' THEN 'extracted' WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'confirmed' WHEN 'signup' THEN 'unrecognized' END AS type FROM events),
  recent AS (SELECT * FROM log WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL {hours} HOUR),
  done AS (SELECT * FROM recent WHERE type = 'extracted' OR type = 'unrecognized'), sure AS (SELECT * FROM recent WHERE type = 'confirmed'),
  lat AS (SELECT latency_s, row_number() OVER (ORDER BY latency_s) AS r, count(*) OVER () AS n FROM done WHERE latency_s IS NOT NULL)"""
TOTALS = f"""WITH {LOG}, a AS (SELECT count(*) AS docs_processed, CAST(coalesce(sum(k), 0) AS BIGINT) AS fields_extracted, CAST(coalesce(sum(k % 3), 0) AS BIGINT) AS fields_low_confidence FROM done),
  b AS (SELECT CAST(coalesce(sum(k % 4), 0) AS BIGINT) AS fields_corrected, count(*) AS n, count(*) FILTER (k % 10 = 0) AS changed FROM sure),
  m AS (SELECT coalesce(avg(latency_s), 0.0) AS median FROM lat WHERE r = (n + 1) // 2 OR r = (n + 2) // 2), p AS (SELECT coalesce(max(latency_s), 0.0) AS p95 FROM lat WHERE r = (n * 95 + 99) // 100)
  SELECT docs_processed, fields_extracted, fields_low_confidence, fields_corrected, round(CASE WHEN fields_extracted = 0 THEN 0.0 ELSE fields_corrected / CAST(fields_extracted AS DOUBLE) END, 4) AS correction_rate,
  round(CASE WHEN n = 0 THEN 0.0 ELSE (n - changed) / CAST(n AS DOUBLE) END, 4) AS first_try_type_acc, round(median, 2) AS median_latency_s, round(p95, 2) AS p95_latency_s FROM a, b, m, p"""


@query
def report_totals(spark, sf):
    return reports.report_totals(*_events(spark, sf))


@query
def report_totals_month(spark, sf):
    return reports.report_totals(*_events(spark, sf), hours=720)


SQL["report_totals"] = TOTALS.format(hours=24)
SQL["report_totals_month"] = TOTALS.format(hours=720)


@query
def report_categories(spark, sf):
    return reports.report_categories(*_events(spark, sf), hours=168)


SQL["report_categories"] = f"""WITH {LOG.format(hours=168)}, c AS (SELECT 'money' AS category FROM sure WHERE k % 4 >= 1 UNION ALL SELECT 'tin_ssn' FROM sure WHERE k % 4 >= 2 UNION ALL SELECT 'names' FROM sure WHERE k % 4 = 3 UNION ALL SELECT 'doc_type' FROM sure WHERE k % 10 = 0)
  SELECT d.category, count(c.category) AS corrections FROM (VALUES ('money'), ('tin_ssn'), ('names'), ('doc_type')) d(category) LEFT JOIN c ON c.category = d.category GROUP BY 1"""


@query
def low_confidence_share(spark, sf):
    return reports.low_confidence_share(reports.report_totals(*_events(spark, sf), hours=720))


SQL["low_confidence_share"] = f"WITH {LOG.format(hours=720)}, s AS (SELECT sum(k % 3) / CAST(sum(k) AS DOUBLE) AS x FROM done) SELECT printf('%.1f%%', round(x * 100, 1)) AS low, CAST(CAST(floor(x * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%' AS low_whole FROM s"


@query
def runs_surface(spark, sf):
    out = reports.runs(_events(spark, sf)[0], _traces(spark, sf), limit=100)
    return out.withColumn("stages", F.array_join("stages", ","))


SQL["runs_surface"] = f"""WITH {LOG.format(hours=1)}, last AS (SELECT *, row_number() OVER (ORDER BY seq DESC) AS rank FROM log WHERE type IN ('extracted', 'unrecognized') QUALIFY rank <= 100),
  t AS (SELECT conv_id, count(*) AS call_count, string_agg(CASE WHEN role = 'system' THEN 'call ' || (turn + 1) ELSE role END, ',' ORDER BY turn) AS stages FROM conversations GROUP BY 1)
  SELECT rank, 'doc_' || seq AS doc_id, CASE seq % 3 WHEN 0 THEN 'W-2' WHEN 1 THEN 'K-1' ELSE '1098' END AS doc_type, type AS status, CASE WHEN conv_id IS NULL THEN 'ollama' ELSE 'rt' || conv_id % 2 END AS model_runtime, 'm' || seq % 2 AS model_name, latency_s,
  seq % 2 = 0 AS preprocessed, seq % 5 = 1 AS retried, call_count, coalesce(stages, '') AS stages, conv_id IS NOT NULL AS raw_available FROM last LEFT JOIN t ON user_id = conv_id"""


@query
def correction_rate(spark, sf):
    docs = D.documents(spark, sf).withColumn("status", F.when(F.col("id") % 6 == 0, "unrecognized").otherwise(F.col("status")))
    return reports.correction_stats(docs, D.fields(spark, sf))


SQL["correction_rate"] = """WITH f AS (SELECT l_orderkey AS d, bool_or(l_returnflag = 'R') AS c FROM lineitem GROUP BY l_orderkey, l_linenumber), s AS (SELECT count(*) AS fields_extracted, count(*) FILTER (c) AS fields_corrected FROM f WHERE d IN (SELECT o_orderkey FROM orders) AND d % 6 <> 0)
  SELECT *, round(CASE WHEN fields_extracted = 0 THEN 0.0 ELSE fields_corrected / CAST(fields_extracted AS DOUBLE) END, 4) AS correction_rate FROM s"""


@query
def duplicate_badges(spark, sf):
    return reports.duplicate_badges(dedup.exact_duplicates(_payloads(spark, sf)).withColumnRenamed("seq", "id"))


SQL["duplicate_badges"] = """SELECT d.doc_id AS id, 'Possible duplicate of ' || max(e.doc_id) AS badge FROM documents d JOIN documents e ON sha256(d.text) = sha256(e.text) AND e.doc_id < d.doc_id GROUP BY 1"""


@query
def batch_assigned(spark, sf):
    docs = D.documents(spark, sf).select("id", F.when(F.col("id") % 50 == 3, F.col("client_id")).alias("client_id"))
    return reports.assigned_batches(docs.select(F.floor(F.col("id") / 20).alias("batch"), "id"), docs)


SQL["batch_assigned"] = "SELECT o_orderkey // 20 AS batch, count(*) FILTER (o_orderkey % 50 = 3 AND o_custkey IS NOT NULL) > 0 AS assigned FROM orders GROUP BY 1"


@query
def files_by_name(spark, sf):
    name = F.concat(F.reverse(F.col("doc_id").cast("string")), F.lit(".png"))
    return reports.by_name(D.table(spark, sf, "documents").select(name.alias("name"), F.octet_length("text").alias("size")))


SQL["files_by_name"] = "SELECT reverse(CAST(doc_id AS VARCHAR)) || '.png' AS name, CAST(strlen(text) AS INT) AS size FROM documents ORDER BY name"


@query
def import_preview(spark, sf):
    return reports.preview(D.table(spark, sf, "customer").where("c_custkey % 4 = 1").select(F.col("c_custkey").alias("seq"), F.col("c_name").alias("name")))


SQL["import_preview"] = "WITH c AS (SELECT c_name, row_number() OVER (ORDER BY c_custkey) AS r, count(*) OVER () AS n FROM customer WHERE c_custkey % 4 = 1) SELECT any_value(n) AS n, string_agg(c_name, ', ' ORDER BY r) || CASE WHEN any_value(n) > 6 THEN ' +' || (any_value(n) - 6) || ' more' ELSE '' END AS line FROM c WHERE r <= 6"


@query
def reminder_prompts(spark, sf):
    lists = D.checklists(spark, sf)
    lacking = checklist.missing(F.col("expected_docs"), F.col("received_docs"))
    return lists.where(F.size(lacking) > 0).select("id", reports.reminder_prompt(F.col("name"), lacking).alias("prompt"))


SQL["reminder_prompts"] = """WITH p AS (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS t), m AS (SELECT c_custkey, c_name, string_agg('- ' || t, chr(10) ORDER BY t) AS listed FROM customer, p
  WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderpriority = t) GROUP BY 1, 2)
  SELECT c_custkey AS id, 'Write a short, professional reminder to the client ' || c_name || ' of a tax preparation firm. Greet them by name and ask for exactly these documents, word for word, one a line:' || chr(10) || listed || chr(10)
  || 'Add no deadline, amount, fee or placeholder such as [Date]. At most 900 characters. Return the note alone.' AS prompt FROM m"""


@query
def field_prompts(spark, sf):
    """What a model is asked for each document and field, the forms by turns over the orders."""
    forms = D.documents(spark, sf).select("id", _pick(TYPES, F.col("id")).alias("doc_type"))
    asked = V.dim_field_schema(spark).join(F.broadcast(reports.extract_prompts(V.dim_field_schema(spark))), "doc_type")  # fixed tables
    rows = forms.join(F.broadcast(asked), "doc_type")
    return rows.select("id", "doc_type", "key", "prompt", reports.field_prompt(F.col("doc_type"), F.col("key")).alias("again"), reports.field_prompt(F.col("doc_type"), F.col("key"), True).alias("crop"))


SQL["field_prompts"] = """WITH s AS (SELECT * FROM (VALUES ('W-2', ['employee_name', 'ssn', 'employer', 'box1_wages', 'box2_fed_withheld']), ('K-1', ['partnership_name', 'partner_name', 'partnership_ein', 'ordinary_income']), ('1098', ['lender', 'borrower_name', 'box1_mortgage_interest'])) AS t(doc_type, keys)),
  d AS (SELECT o_orderkey AS id, (['W-2', 'K-1', '1098'])[CAST(o_orderkey % 3 AS INT) + 1] AS doc_type FROM orders), r AS (SELECT id, doc_type, keys, unnest(keys) AS key FROM d JOIN s USING (doc_type))
  SELECT id, doc_type, key, 'This is a ' || doc_type || ' form. Return its values as printed, in JSON only: {' || array_to_string(list_transform(keys, lambda k: '"' || k || '": "..."'), ', ') || '}. A field that is not there is "".' AS prompt,
  'This is a ' || doc_type || ' form. Read only ' || key || ', not its label. Answer in JSON only: {"value": "..."}, with the value as printed, or "" if it is not there.' AS again,
  'This is a part of a ' || doc_type || ' form. Read only ' || key || ', not its label. Answer in JSON only: {"value": "..."}, with the value as printed, or "" if it is not there.' AS crop FROM r"""


@query
def created_documents(spark, sf):
    docs = D.table(spark, sf, "documents").where("doc_id % 7 <> 3")
    n = F.col("doc_id")
    rows = docs.select(n.alias("seq"), F.when(n % 11 == 0, "").otherwise(F.concat(F.lit("scan_"), n.cast("string"), _pick([".PNG", ".pdf", ".jpeg", ""], n))).alias("name"), F.when(n % 3 == 0, "folder").otherwise("upload").alias("source"),
                       F.when(n % 4 == 1, n % 20 + 1).alias("page_number"), F.when(n % 4 == 1, F.lit("forms.pdf")).alias("source_file"), F.sha2("text", 256).alias("phash"), F.lit(None).cast("string").alias("duplicate_of"))
    made = intake.created_documents(rows, 990, F.lit("2024-01-31T00:00:00Z"))
    return made.select("seq", "id", "status", "image_path", "received_at", "source_name", "phash", "source", "page_number", "source_file")


SQL["created_documents"] = """WITH r AS (SELECT doc_id AS n, row_number() OVER (ORDER BY doc_id) + 990 AS k, sha256(text) AS phash, doc_id % 4 AS e FROM documents WHERE doc_id % 7 <> 3)
  SELECT n AS seq, printf('doc_%03d', k) AS id, 'pending' AS status, 'uploads/' || printf('doc_%03d', k) || CASE WHEN n % 11 = 0 THEN '.png' WHEN e = 2 THEN '.jpeg' ELSE '.png' END AS image_path, '2024-01-31T00:00:00Z' AS received_at,
  CASE WHEN n % 11 <> 0 THEN 'scan_' || n || (['.PNG', '.pdf', '.jpeg', ''])[e + 1] END AS source_name, phash, CASE WHEN n % 3 = 0 THEN 'folder' END AS source, CASE WHEN e = 1 THEN n % 20 + 1 END AS page_number, CASE WHEN e = 1 THEN 'forms.pdf' END AS source_file FROM r"""


@query
def upgraded_prints(spark, sf):
    n, sha = F.col("doc_id"), F.sha2("text", 256)
    docs = D.table(spark, sf, "documents").select(n.alias("id"), F.when(n % 3 == 0, sha).when(n % 3 == 1, F.substring(sha, 1, 16)).alias("phash"), F.when(n % 5 != 0, sha).alias("again"))
    return intake.upgraded_prints(docs, F.col("again")).select("id", "phash")


SQL["upgraded_prints"] = "SELECT doc_id AS id, sha256(text) AS phash FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 <> 0"


@query
def settled_runs(spark, sf):
    n = F.col("id")
    rows = D.documents(spark, sf).select("id", F.when(n % 4 == 0, "unrecognized").otherwise("extracted").alias("status"), F.when(n % 4 == 0, V.UNRECOGNIZED).otherwise("W-2").alias("doc_type"), F.when(n % 10 == 0, "TimeoutError: model").alias("error"))
    return intake.settled(rows)


SQL["settled_runs"] = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'error' WHEN o_orderkey % 4 = 0 THEN 'unrecognized' ELSE 'extracted' END AS status, CASE WHEN o_orderkey % 10 = 0 OR o_orderkey % 4 = 0 THEN 'UNRECOGNIZED' ELSE 'W-2' END AS doc_type, CASE WHEN o_orderkey % 10 = 0 THEN 'TimeoutError: model' END AS error FROM orders"


@query
def disputed_fields(spark, sf):
    n, money = F.col("pos"), F.format_string("%.2f", "value")
    reads = D.fields(spark, sf).select("doc_id", F.when(n % 2 == 0, "box1_wages").otherwise("payer").alias("key"), "pos", money.alias("value"), F.when(n == 3, " ").when(n == 4, F.concat(F.lit("$"), money)).when(n == 5, F.concat(money, F.lit("!"))).otherwise("7").alias("other"))
    return intake.disputed(reads.withColumn("doc_id", F.concat_ws("/", "doc_id", "pos")))


SQL["disputed_fields"] = """WITH f AS (SELECT l_orderkey AS d, l_linenumber AS p, printf('%.2f', min(l_extendedprice)) AS v FROM lineitem GROUP BY 1, 2)
  SELECT d || '/' || p AS doc_id, CASE WHEN p % 2 = 0 THEN 'box1_wages' ELSE 'payer' END AS key, v AS value, true AS low_confidence, NOT (p IN (4, 5) OR (p % 2 = 0 AND p <> 4 AND abs(CAST(v AS DOUBLE) - 7) <= 0.01)) AS disputed FROM f"""


# --- evaluation ---


def _scored(spark, sf):
    n = F.col("doc_id") + F.col("pos")
    file = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    scores = D.fields(spark, sf).select(file.alias("file"), F.when(n % 13 == 0, "missing").when(n % 5 == 0, "wrong").otherwise("correct").alias("verdict"), "low_confidence", (n % 3 == 0).alias("disputed"))
    i = F.col("id")
    runs = D.documents(spark, sf).select(
        F.concat(F.lit("doc_"), i.cast("string")).alias("file"), F.col("doc_type").alias("expected_type"), F.when(i % 9 == 0, V.UNRECOGNIZED).otherwise(F.col("doc_type")).alias("predicted_type"), (i % 100 / 4.0).cast("double").alias("latency_s"),
        (i % 17 == 0).alias("classify_only"), (i % 7 == 0).alias("hand"), (i % 14 == 0).alias("hand_ensemble"))
    return scores, runs


@query
def eval_report(spark, sf):
    return evaluate.report(*_scored(spark, sf))


SQL["eval_report"] = """WITH s AS (SELECT l_orderkey AS d, l_orderkey + l_linenumber AS n, bool_or(l_discount > 0.07) AS flagged FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey, l_linenumber),
  f AS (SELECT *, n % 13 <> 0 AND n % 5 <> 0 AS ok, n % 13 <> 0 AND n % 5 = 0 AS wrong, d % 7 = 0 AS hand, d % 14 = 0 AS twice, n % 3 = 0 AS disputed FROM s),
  a AS (SELECT count(*) AS field_total, count(*) FILTER (ok) AS field_correct, count(*) FILTER (wrong) AS silent_wrong, count(*) FILTER (wrong AND flagged) AS silent_wrong_flagged, count(*) FILTER (NOT ok) AS errors, count(*) FILTER (NOT ok AND flagged) AS errors_flagged,
  count(*) FILTER (hand) AS hand_field_total, count(*) FILTER (hand AND ok) AS hand_field_correct, count(*) FILTER (hand AND NOT flagged) AS unflagged, count(*) FILTER (twice AND NOT disputed) AS agreed, count(*) FILTER (twice AND NOT disputed AND ok) AS agreed_correct,
  count(*) FILTER (twice AND disputed) AS disputed, count(*) FILTER (twice AND disputed AND ok) AS disputed_correct FROM f),
  r AS (SELECT count(*) AS docs, count(*) FILTER (o_orderkey % 9 <> 0) AS types_correct, count(*) FILTER (o_orderkey % 17 = 0) AS classify_only_docs, round(quantile_cont(o_orderkey % 100 / 4.0, 0.5), 2) AS median_latency_s, round(quantile_cont(o_orderkey % 100 / 4.0, 0.5) FILTER (o_orderkey % 7 = 0), 2) AS hand_median_latency_s FROM orders)
  SELECT docs, types_correct, round(types_correct / CAST(docs AS DOUBLE), 4) AS doc_type_accuracy, field_total, field_correct, round(field_correct / CAST(field_total AS DOUBLE), 4) AS field_accuracy, classify_only_docs, silent_wrong, silent_wrong_flagged,
  round(silent_wrong_flagged / CAST(silent_wrong AS DOUBLE), 4) AS flag_coverage, errors, errors_flagged, round(errors_flagged / CAST(errors AS DOUBLE), 4) AS flag_coverage_all, CAST(median_latency_s AS DOUBLE) AS median_latency_s, hand_field_total, hand_field_correct,
  round(hand_field_correct / CAST(hand_field_total AS DOUBLE), 4) AS hand_field_accuracy, unflagged = 0 AS hand_all_flagged, CAST(hand_median_latency_s AS DOUBLE) AS hand_median_latency_s, agreed, agreed_correct, round(agreed_correct / CAST(agreed AS DOUBLE), 4) AS agreement_precision,
  disputed, disputed_correct, round(disputed_correct / CAST(disputed AS DOUBLE), 4) AS disputed_correct_rate FROM a, r"""


@query
def eval_chosen(spark, sf):
    files = D.documents(spark, sf).select(F.concat(F.lit("doc_"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("file"), "doc_type")
    return reports.chosen(files, limit=32)


SQL["eval_chosen"] = "SELECT printf('doc_%09d', o_orderkey) AS file, o_orderpriority AS doc_type FROM orders ORDER BY file LIMIT 32"


# --- 256-bit fingerprints ---


def _wide(spark, sf, copies: bool = False):
    """256 bits of a vector: each element against those one to four places on, round and round.

    With ``copies`` every third vector comes again under another seq, with one element changed.
    """
    vectors = D.table(spark, sf, "embeddings").select(F.col("vec_id").alias("seq"), "label", F.col("embedding").alias("v"))
    if copies:
        changed = F.transform("v", lambda x, i: F.when(i == F.pmod(F.col("seq"), F.lit(64)), F.lit(9.0).cast("float")).otherwise(x))
        vectors = vectors.union(vectors.where("seq % 3 = 0").select((F.col("seq") + 1_000_000).alias("seq"), "label", changed))
    bits = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.get("v", i % 64) > F.get("v", (i % 64 + F.floor(i / 64).cast("int") + 1) % 64))
    return dedup.wide_prints(vectors, C.wide_hash(bits)).select("seq", "label", "fp")


def _wide_sql(table: str) -> str:
    return f"""w AS (SELECT seq, label, list_transform(range(256), lambda i: e[i % 64 + 1] > e[(i % 64 + i // 64 + 1) % 64 + 1]) AS bits FROM {table}),
  p AS (SELECT a.seq, a.label AS la, b.seq AS cand, b.label AS lb, len(list_filter(list_zip(a.bits, b.bits), lambda x: x[1] <> x[2])) AS distance FROM w a JOIN w b ON b.seq < a.seq)"""


VECTORS = "v AS (SELECT vec_id AS seq, label, embedding AS e FROM embeddings)"
COPIES = f"{VECTORS}, c AS (FROM v UNION ALL SELECT seq + 1000000, label, list_transform(e, lambda x, i: CASE WHEN i - 1 = seq % 64 THEN CAST(9 AS FLOAT) ELSE x END) FROM v WHERE seq % 3 = 0)"


@query
def wide_print_digits(spark, sf):
    return _wide(spark, sf).select("seq", C.hash_digits(F.col("fp")).alias("phash"))


@query
def wide_near_duplicates(spark, sf):
    return dedup.wide_nearest(_wide(spark, sf, copies=True))


SQL["wide_near_duplicates"] = f"WITH {COPIES}, {_wide_sql('c')} SELECT seq, cand AS duplicate_of, distance FROM p WHERE distance <= 16 QUALIFY row_number() OVER (PARTITION BY seq ORDER BY distance, cand) = 1"


@query
def wide_floors(spark, sf):
    return dedup.calibrated(dedup.wide_floor(_wide(spark, sf)))


SQL["wide_floors"] = f"WITH {VECTORS}, {_wide_sql('v')}, f AS (SELECT la = lb AS same_label, min(distance) AS floor FROM p GROUP BY 1) SELECT same_label, floor, CASE WHEN same_label THEN floor <= 16 ELSE floor > 16 END AS passes FROM f"


@query
def derived_seeds(spark, sf):
    return D.table(spark, sf, "part").select("p_partkey", C.derive_seed(F.lit("7"), F.col("p_partkey").cast("string")).alias("seed"))


SQL["derived_seeds"] = "SELECT p_partkey, CAST(CAST('0x' || substring(sha256('7:' || p_partkey), 1, 16) AS UBIGINT) AS VARCHAR) AS seed FROM part"


@query
def duplicates_in_runs(spark, sf):
    """A content that every third document has: its rows are dealt over runs of seq."""
    docs = D.table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 3 == 0, "the same").otherwise(F.col("text")).alias("content"))
    return dedup.exact_duplicates(docs).select("seq", "duplicate_of")


SQL["duplicates_in_runs"] = "SELECT doc_id AS seq, lag(doc_id) OVER (PARTITION BY CASE WHEN doc_id % 3 = 0 THEN 'the same' ELSE text END ORDER BY doc_id) AS duplicate_of FROM documents"


# --- rules over whole tables ---


@query
def money_of_lines(spark, sf):
    n, x = F.col("l_linenumber"), F.col("l_extendedprice")
    shown = F.when(n % 4 == 0, F.concat(F.lit("$"), F.format_number(x, 2))).when(n % 4 == 1, F.concat(F.lit("- "), F.format_string("%.2f", x))).when(n % 4 == 2, F.concat(F.lit("("), F.format_string("%.2f", x), F.lit(")"))).otherwise(F.concat(F.format_string("%.2f", x), F.lit("e1")))
    return D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", C.parse_money(shown).alias("amount"), C.is_money_label(shown).alias("label"))


SQL["money_of_lines"] = """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN CAST(printf('%.2f', l_extendedprice) AS DOUBLE) WHEN 1 THEN CAST('-' || printf('%.2f', l_extendedprice) AS DOUBLE) WHEN 3 THEN CAST(printf('%.2f', l_extendedprice) || 'e1' AS DOUBLE) END AS amount,
  l_linenumber % 4 = 0 AS label FROM lineitem"""


@query
def formats_of_orders(spark, sf):
    n = F.col("o_orderkey")
    ssn = F.format_string("%03d-%02d-%04d", (n % 1000).cast("int"), (n % 100).cast("int"), (n % 10000).cast("int"))
    key = _pick(["ssn", "recipient_tin", "box1_wages", "payer"], n)
    value = F.when(n % 3 == 0, ssn).when(n % 3 == 1, F.translate(ssn, "-", "")).otherwise(F.col("o_orderpriority"))
    return D.table(spark, sf, "orders").select("o_orderkey", C.field_format_ok(key, value).alias("ok"), C.mask_tin(value).alias("masked"))


SQL["formats_of_orders"] = """WITH t AS (SELECT o_orderkey, o_orderkey % 4 AS k, o_orderkey % 3 AS v, o_orderpriority AS p FROM orders)
  SELECT o_orderkey, CASE WHEN k = 3 THEN true WHEN v < 2 THEN k < 2 OR (k = 2 AND v = 1) ELSE false END AS ok,
  CASE WHEN v < 2 THEN '•••-••-' || printf('%04d', o_orderkey % 10000) ELSE p END AS masked FROM t"""


@query
def answers_of_orders(spark, sf):
    asked = F.concat(_pick(["This is a ", "form: ", ""], F.col("o_orderkey")), _pick(TYPES + ["1099 Nec", "W 9", "property tax"], F.col("o_custkey")), F.lit(" for "), "o_orderpriority")
    return D.table(spark, sf, "orders").select("o_orderkey", C.normalize_doc_type(asked).alias("doc_type"))


SQL["answers_of_orders"] = "SELECT o_orderkey, (['W-2', 'K-1', '1098', '1099-NEC', 'W-9', 'property tax statement'])[CAST(o_custkey % 6 AS INT) + 1] AS doc_type FROM orders"

SQL["parse_model_json"] = r"""WITH a AS (SELECT p_partkey, trim((['{"doc_type": "W-2", "handwritten": true}', '```json' || chr(10) || '{"doc_type": "Form 1099-INT"}' || chr(10) || '```', 'Sure: {"doc_type": "K-1", "handwritten": "no"} done', 'no object', '{"doc_type": "W-9"}', '{"doc_type": ', '', '{"doc_type": null}',
  '{"doc_type": "1098", "handwritten": "yes"}', '[1, 2]', '{"other": 1}'])[CAST(p_partkey % 11 AS INT) + 1]) AS t FROM part), b AS (SELECT p_partkey, substring(t, instr(t, '{'), length(t) - instr(reverse(t), '}') + 2 - instr(t, '{')) AS x, instr(t, '{') > 0 AND instr(t, '}') > 0 AS held FROM a)
  SELECT p_partkey, CASE WHEN held AND json_valid(x) THEN json_extract_string(x, '$.doc_type') END AS doc_type, coalesce(held AND json_valid(x), false) AS ok FROM b"""
