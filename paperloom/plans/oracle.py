"""For each query the SQL, for another engine, that gives the same rows over the same tables."""

from __future__ import annotations

from paperloom.functions import tables as V
from paperloom.functions.fields import label_phrases
from paperloom.plans import changes, intake
from paperloom.plans import samples as S
from paperloom.sources import domain as D


def _s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs: list[str]) -> str:
    return "[" + ", ".join(_s(x) for x in xs) + "]"


def _pick(xs: list[str], n: str) -> str:
    return f"({_list(xs)})[CAST(({n}) % {len(xs)} AS INT) + 1]"


DOCS = """docs AS (SELECT o_orderkey AS seq, o_orderkey AS id, o_custkey AS client_id, o_orderpriority AS doc_type, o_orderdate AS received_at,
  CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'extracted' ELSE 'pending' END AS status FROM orders)"""
FIELDS = """fields AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, 'line_' || l_linenumber AS key, min(l_extendedprice) AS value,
  bool_or(l_returnflag = 'R') AS corrected, bool_or(l_discount > 0.07) AS low_confidence FROM lineitem GROUP BY 1, 2, 3)"""
LISTS = f"""{DOCS}, received AS (SELECT client_id, list_sort(list_distinct(list(doc_type))) AS received_docs FROM docs WHERE status = 'confirmed' GROUP BY 1),
  lists AS (SELECT c_custkey AS seq, c_custkey AS id, c_name AS name, {_list(D.PRIORITIES)} AS expected_docs, coalesce(received_docs, CAST([] AS VARCHAR[])) AS received_docs
  FROM customer LEFT JOIN received ON c_custkey = client_id)"""
EVENTS = f"""ev0 AS (SELECT event_id AS seq, ts, value AS latency_s, user_id AS raw_ref, CAST(json_extract_string(props, '$.k') AS BIGINT) AS fields_total,
  CASE event_type WHEN 'view' THEN 'extracted' WHEN 'click' THEN 'extracted' WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'confirmed' WHEN 'signup' THEN 'unrecognized' END AS type FROM events),
  ev AS (SELECT *, fields_total % 4 AS fields_corrected, fields_total % 10 = 0 AS manual_type_change,
  CASE WHEN fields_total % 4 > 0 THEN ({_list(D.CORRECTED_KEYS)})[CAST(fields_total % 4 AS INT) + 1] END AS corrected_key FROM ev0),
  clock AS (SELECT max(ts) AS now FROM events)"""


def _window(hours: int) -> str:
    return f"win AS (SELECT ev.* FROM ev, clock WHERE ev.ts >= clock.now - INTERVAL {hours} HOUR)"


def _hourly(hours: int) -> str:
    return f"""WITH {EVENTS}, {_window(hours)}, axis AS (SELECT date_trunc('hour', now) - to_hours(CAST(b AS INT)) AS h FROM clock, range({hours}) r(b)),
  agg AS (SELECT date_trunc('hour', ts) AS h, count(*) FILTER (type IN ('extracted', 'unrecognized')) AS docs, sum(CASE WHEN type = 'confirmed' THEN fields_corrected ELSE 0 END) AS corrections FROM win GROUP BY 1),
  hourly AS (SELECT strftime(axis.h, '%Y-%m-%d %H:00') AS hour, coalesce(docs, 0) AS docs, CAST(coalesce(corrections, 0) AS BIGINT) AS corrections FROM axis LEFT JOIN agg USING (h))"""


def _totals(hours: int) -> str:
    return f"""WITH {EVENTS}, {_window(hours)}, t AS (SELECT count(*) FILTER (type IN ('extracted', 'unrecognized')) AS docs_processed,
  CAST(coalesce(sum(fields_total) FILTER (type IN ('extracted', 'unrecognized')), 0) AS BIGINT) AS fields_extracted, CAST(coalesce(sum(fields_corrected) FILTER (type = 'confirmed'), 0) AS BIGINT) AS fields_corrected,
  count(*) FILTER (type = 'confirmed') AS confirms, count(*) FILTER (type = 'confirmed' AND manual_type_change) AS manual_type_changes FROM win),
  totals AS (SELECT *, CASE WHEN fields_extracted = 0 THEN 0.0 ELSE CAST(fields_corrected AS DOUBLE) / fields_extracted END AS correction_rate,
  CASE WHEN confirms = 0 THEN 0.0 ELSE CAST(confirms - manual_type_changes AS DOUBLE) / confirms END AS first_try_type_acc FROM t)"""


def _any(k: str, xs: list[str]) -> str:
    return "(" + " OR ".join(f"contains({k}, {_s(x)})" for x in xs) + ")"


def _money(v: str) -> str:
    bare = rf"regexp_replace(regexp_replace({v}, '[,$\s]', '', 'g'), '(\d)_(\d)', '\1\2', 'g')"
    return rf"CASE WHEN regexp_full_match({bare}, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN TRY_CAST({bare} AS DOUBLE) END"


def _tin(k: str) -> str:
    return f"(lower({k}) = 'ssn' OR contains(lower({k}), 'tin') OR contains(lower({k}), 'ein'))"


def _ok(k: str, v: str) -> str:
    t = f"trim(coalesce({v}, ''))"
    return rf"""CASE WHEN {t} = '' THEN false WHEN lower({k}) = 'ssn' THEN regexp_full_match({t}, '\d{{3}}-?\d{{2}}-?\d{{4}}')
  WHEN contains(lower({k}), 'tin') OR contains(lower({k}), 'ein') THEN length(regexp_replace({t}, '\D', '', 'g')) = 9
  WHEN {_any(f'lower({k})', V.MONEY_TOKENS)} THEN ({_money(t)}) IS NOT NULL ELSE true END"""


def _name(k: str) -> str:
    return f"(NOT {_any(f'lower({k})', V.MONEY_TOKENS)} AND NOT {_tin(k)})"


def _norm(v: str) -> str:
    return rf"lower(trim(regexp_replace(regexp_replace({v}, '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')))"


def _label(v: str) -> str:
    phrases = label_phrases()
    several = [p for p in phrases if " " in p]
    n = _norm(f"coalesce({v}, '')")
    return f"({n} = '' OR list_contains({_list(phrases)}, {n}) OR len(list_filter({_list(several)}, lambda p: contains({n}, p) OR contains(p, {n}))) > 0)"


def _doc_type(raw: str) -> str:
    t = f"lower(trim({raw}))"
    m = lambda p: f"regexp_matches({t}, {_s(p)})"
    h = lambda *xs: " AND ".join(f"contains({t}, {_s(x)})" for x in xs)
    rules = [(h("1099", w), f"1099-{w.upper()}") for w in ("nec", "int", "misc", "div")] + [(m(rf"1099[\s\-]?{x}\b"), f"1099-{x.upper()}") for x in "rgb"]
    rules += [
        (f"{m(r'1098[\s\-]?t\b')} OR {h('tuition')}", "1098-T"), (f"{m(r'1098[\s\-]?e\b')} OR {h('student loan')}", "1098-E"), (h("1098"), "1098"), (h("1095"), "1095-A"),
        (f"{m(r'\bw[\s\-]?2\b')} OR {h('wage and tax')}", "W-2"), (f"{m(r'\bw[\s\-]?9\b')} OR {h('request for taxpayer identification')}", "W-9"), (f"{m(r'\bk[\s\-]?1\b')} OR {h('schedule k')}", "K-1"),
        (h("property tax"), "property tax statement"), (_any(t, ["charitable", "donation receipt", "donation acknowledg"]), "charitable receipt"), (_any(t, ["brokerage", "consolidated 1099"]), "brokerage statement"), (h("engagement"), "engagement letter"),
    ]
    return "CASE " + " ".join(f"WHEN {a} THEN {_s(b)}" for a, b in rules) + f" ELSE '{V.UNRECOGNIZED}' END"


KV = f"kv AS (SELECT p_partkey, {_pick(S.KEYS, 'p_partkey')} AS key, {_pick(S.VALUES, f'p_partkey // {len(S.KEYS)} + p_partkey')} AS value FROM part)"
PRINTS = "prints AS (SELECT vec_id AS seq, label, embedding AS vec, CAST(list_sum([CASE WHEN embedding[i] > embedding[i + 1] THEN CAST(1 AS HUGEINT) << (i - 1) ELSE 0 END for i in range(1, 64)]) AS BIGINT) AS fp FROM embeddings)"
PAIRS = f"{PRINTS}, pairs AS (SELECT a.seq, b.seq AS cand, CAST(bit_count(xor(a.fp, b.fp)) AS BIGINT) AS distance FROM prints a, prints b WHERE b.seq < a.seq AND bit_count(xor(a.fp, b.fp)) <= {V.HAMMING_THRESHOLD})"
EXACT = "flags AS (SELECT doc_id AS seq, sha256(text) AS sha, lag(doc_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS duplicate_of FROM documents)"
FILE = "CASE WHEN {0} % 7 = 0 THEN 'hand_' ELSE 'doc_' END || {0}"
SCORES = f"""{FIELDS}, truth AS (SELECT {FILE.format('doc_id')} AS file, key, printf('%.2f', value) AS expected, value, doc_id, pos, low_confidence FROM fields),
  scores AS (SELECT file, key, CASE WHEN (doc_id + pos) % 13 = 0 THEN 'missing' WHEN (doc_id + pos) % 5 = 0 THEN 'wrong' WHEN (doc_id + pos) % 11 = 0 THEN 'missing' ELSE 'correct' END AS verdict,
  CASE WHEN (doc_id + pos) % 13 <> 0 THEN low_confidence END AS low_confidence FROM truth)"""
W2 = f"""{DOCS}, w2 AS (SELECT id, 'W-2' AS doc_type, pos, ({_list(V.FIELD_SCHEMA['W-2'])})[pos + 1] AS key, ({_list(S.VALUES)})[CAST((id * 3 + pos * 7) % {len(S.VALUES)} AS INT) + 1] AS value,
  id % 10 = 0 AS retried, ({_list(S.VALUES)})[CAST((id + pos * 5 + 1) % {len(S.VALUES)} AS INT) + 1] AS answer FROM docs, range(5) r(pos))"""
FULL_LOW = f"""(retried OR NOT ({_ok('key', 'value')}) OR {_label('value')} OR ({_any('lower(key)', V.MONEY_TOKENS)} AND coalesce(({_money('value')}) <= 0, false))
  OR (key = 'box2_fed_withheld' AND coalesce(({_money('value')}) >= max(CASE WHEN key = 'box1_wages' THEN {_money('value')} END) OVER (PARTITION BY id), false)))"""
CONFIRMS = f"""{FIELDS}, base AS (SELECT doc_id, key, -1 AS seq, printf('%.2f', value) AS value, corrected, CASE WHEN corrected THEN 'old' END AS original_value, low_confidence FROM fields),
  lines AS (SELECT *, printf('%.2f', value) AS money FROM fields WHERE doc_id % 2 = 0),
  confirms AS (SELECT doc_id AS seq, doc_id, key, CASE WHEN pos % 2 = 0 THEN money || '0' ELSE money END AS value FROM lines
  UNION ALL SELECT doc_id + 1000000000, doc_id, key, CASE WHEN pos = 2 THEN money ELSE 'new' END FROM lines WHERE pos < 4
  UNION ALL SELECT doc_id + 1000000000, doc_id, 'note', CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE '' END FROM lines WHERE pos = 1),
  steps AS (SELECT doc_id, key, seq, value FROM base UNION ALL SELECT doc_id, key, seq, value FROM confirms),
  met AS (SELECT *, CASE WHEN seq >= 0 THEN coalesce(lag(value) OVER (PARTITION BY doc_id, key ORDER BY seq), '') END AS before FROM steps)"""
IMPORT = """rows0 AS (SELECT c_custkey AS seq, CASE WHEN c_custkey % 10 = 0 THEN '  ' WHEN c_custkey % 3 = 0 THEN upper(' ' || c_name) ELSE 'New ' || (c_custkey // 2) END AS name FROM customer),
  plan AS (SELECT seq, name, CASE WHEN trim(name) = '' THEN 'blank' WHEN lower(trim(name)) IN (SELECT lower(trim(c_name)) FROM customer WHERE c_custkey % 2 = 0)
  OR row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY seq) > 1 THEN 'dupe' ELSE 'create' END AS action FROM rows0)"""
EXPORT = f"""{DOCS}, {FIELDS}, export AS (SELECT client_id, c_name AS client_name, docs.id AS doc_id, doc_type, strftime(received_at, '%Y-%m-%dT%H:%M:%SZ') AS received_at, coalesce(key, 'document') AS field_key,
  CASE WHEN key IS NULL THEN 'Document received' WHEN key = 'line_1' THEN 'First line' WHEN key = 'line_2' THEN 'Second line' ELSE key END AS field_label, fields.value AS amount,
  coalesce(corrected, false) AS fixed, coalesce(low_confidence, false) AS low, key IS NULL AS fieldless
  FROM docs JOIN customer ON client_id = c_custkey LEFT JOIN fields ON docs.id = doc_id WHERE status = 'confirmed')"""
NAMES = f"{_pick(S.NAMES, 'p_partkey')}"
EXT = "regexp_extract(lower({0}), '(\\.[^.]*)$', 1)"
MISSING = "list_filter(expected_docs, lambda t: NOT list_contains(received_docs, t))"
DISCARDED = "gone AS (SELECT id FROM docs WHERE id % 3 = 0 AND status = 'confirmed')"
UNCHECKED = f"{DISCARDED}, unchecked AS (SELECT DISTINCT client_id, doc_type FROM docs d WHERE id IN (SELECT id FROM gone) AND NOT EXISTS (SELECT 1 FROM docs o WHERE o.client_id = d.client_id AND o.doc_type = d.doc_type AND o.status = 'confirmed' AND o.id NOT IN (SELECT id FROM gone)))"

ORACLE_SQL: dict[str, str] = {
    "timeline_hourly": f"{_hourly(24)} SELECT * FROM hourly",
    "timeline_week": f"{_hourly(168)} SELECT * FROM hourly",
    "timeline_totals": f"{_totals(24)} SELECT * FROM totals",
    "timeline_latency": f"""WITH {EVENTS}, {_window(24)} SELECT coalesce(quantile_cont(latency_s, 0.5), 0.0) AS median_latency_s, coalesce((SELECT latency_s FROM (SELECT latency_s, row_number() OVER (ORDER BY latency_s) AS r, count(*) OVER () AS n
  FROM win WHERE type IN ('extracted', 'unrecognized') AND latency_s IS NOT NULL) WHERE r = (n * 95 + 99) // 100), 0.0) AS p95_latency_s, count(latency_s) AS n FROM win WHERE type IN ('extracted', 'unrecognized')""",
    "corrections_by_category": f"""WITH {EVENTS}, {_window(24)}, c AS (SELECT CASE corrected_key WHEN 'box1_wages' THEN 'money' WHEN 'ssn' THEN 'tin_ssn' WHEN 'payer' THEN 'names' ELSE 'tin_ssn' END AS category FROM win WHERE type = 'confirmed' AND corrected_key IS NOT NULL
  UNION ALL SELECT 'doc_type' FROM win WHERE type = 'confirmed' AND manual_type_change) SELECT d.category, count(c.category) AS corrections FROM (SELECT unnest({_list(V.CATEGORIES)}) AS category) d LEFT JOIN c USING (category) GROUP BY 1""",
    "first_try_accuracy": f"{_totals(720)} SELECT confirms, manual_type_changes, first_try_type_acc FROM totals",
    "timeline_recency": f"{_hourly(24)} SELECT hour, docs, row_number() OVER (ORDER BY hour DESC) <= 3 AS recent FROM hourly",
    "recent_runs": f"""WITH {EVENTS}, runs AS (SELECT * FROM ev WHERE type IN ('extracted', 'unrecognized') ORDER BY seq DESC LIMIT 20),
  st AS (SELECT conv_id, count(*) AS call_count, string_agg(CASE WHEN role <> 'system' THEN role ELSE 'call ' || (turn + 1) END, ',' ORDER BY turn) AS stages FROM conversations GROUP BY 1)
  SELECT seq, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, type, latency_s, raw_ref, conv_id IS NOT NULL AS raw_available, call_count, coalesce(stages, '') AS stages FROM runs LEFT JOIN st ON raw_ref = conv_id""",
    "run_stage_summary": "SELECT conv_id AS doc_id, count(*) AS call_count, string_agg(CASE WHEN role <> 'system' THEN role ELSE 'call ' || (turn + 1) END, ',' ORDER BY turn) AS stages FROM conversations GROUP BY 1",
    "trace_calls": "SELECT conv_id AS doc_id, turn AS seq, CASE WHEN role <> 'system' THEN role END AS stage, substring(text, 1, 240) AS head FROM conversations WHERE conv_id = 1",
    "all_clients": "SELECT c_custkey AS seq, c_custkey AS id, c_name AS name FROM customer",
    "document_by_id": f"WITH {DOCS} SELECT seq, id, client_id, status, doc_type FROM docs WHERE id = 7",
    "queue_counts": f"WITH {DOCS} SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status <> 'pending') AS done FROM docs",
    "correction_stats": f"WITH {DOCS}, {FIELDS}, t AS (SELECT count(*) AS e, count(*) FILTER (corrected) AS c FROM fields WHERE doc_id IN (SELECT id FROM docs)) SELECT e AS fields_extracted, c AS fields_corrected, CASE WHEN e = 0 THEN 0.0 ELSE CAST(c AS DOUBLE) / e END AS correction_rate FROM t",
    "low_conf_per_doc": f"WITH {DOCS}, {FIELDS} SELECT id, count(*) FILTER (low_confidence) AS n_low, count(doc_id) AS n_fields FROM docs LEFT JOIN fields ON id = doc_id GROUP BY 1",
    "client_missing_docs": f"WITH {LISTS} SELECT id AS client_id, array_to_string({MISSING}, ',') AS missing, len({MISSING}) AS n_missing FROM lists",
    "client_also_received": f"WITH {LISTS} SELECT id AS client_id, array_to_string(list_filter(received_docs, lambda t: NOT list_contains({_list(D.PRIORITIES[:2])}, t)), ',') AS also_received FROM lists",
    "checklist_progress": f"WITH {LISTS} SELECT id AS client_id, 5 - len({MISSING}) AS have, len(expected_docs) AS total, len({MISSING}) = 0 AS complete FROM lists",
    "checklist_rows": f"WITH {LISTS} SELECT id AS client_id, pos, expected_docs[pos + 1] AS doc_type, list_contains(received_docs, expected_docs[pos + 1]) AS received FROM lists, range(5) r(pos)",
    "client_doc_meta": f"""WITH {DOCS}, {FIELDS}, last AS (SELECT * FROM docs WHERE status = 'confirmed' QUALIFY row_number() OVER (PARTITION BY client_id, doc_type ORDER BY seq DESC) = 1)
  SELECT client_id, doc_type, id AS doc_id, strftime(received_at, '%Y-%m-%d') AS received, (SELECT count(*) FROM fields f WHERE f.doc_id = last.id AND corrected) AS corrected_fields FROM last""",
    "client_delete_guard": f"WITH {DOCS} SELECT c_custkey AS id, count(docs.id) AS doc_count, count(docs.id) = 0 AS deletable FROM customer LEFT JOIN docs ON c_custkey = client_id GROUP BY 1",
    "uncheck_after_delete": f"WITH {DOCS}, {UNCHECKED} SELECT * FROM unchecked",
    "received_after_confirm": f"""WITH {LISTS}, new AS (SELECT client_id AS cid, list_sort(list_distinct(list(doc_type))) AS n FROM docs WHERE status = 'extracted' GROUP BY 1)
  SELECT id, array_to_string(list_concat(received_docs, list_filter(coalesce(n, CAST([] AS VARCHAR[])), lambda t: NOT list_contains(received_docs, t))), ',') AS received FROM lists LEFT JOIN new ON id = cid""",
    "received_after_discard": f"""WITH {LISTS}, {UNCHECKED}, un AS (SELECT client_id AS cid, list(doc_type) AS u FROM unchecked GROUP BY 1)
  SELECT id, array_to_string(list_filter(received_docs, lambda t: NOT list_contains(coalesce(u, CAST([] AS VARCHAR[])), t)), ',') AS received FROM lists LEFT JOIN un ON id = cid""",
    "export_confirmed_fields": f"""WITH {EXPORT} SELECT client_id, client_name, doc_id, doc_type, received_at, field_key, field_label, CASE WHEN fieldless THEN doc_type ELSE CAST(amount AS VARCHAR) END AS value,
  CASE WHEN fixed THEN 'true' ELSE 'false' END AS corrected, CASE WHEN fixed THEN 'first read' ELSE '' END AS original_value, CASE WHEN low THEN 'true' ELSE 'false' END AS low_confidence FROM export""",
    "export_fieldless": f"WITH {EXPORT} SELECT client_id, doc_id, doc_type AS value FROM export WHERE fieldless",
    "review_queue": f"WITH {DOCS} SELECT seq, id, client_id, status, doc_type FROM docs WHERE status IN ('extracted', 'unrecognized', 'error')",
    "op_summary": f"WITH {DOCS} SELECT count(*) FILTER (status = 'extracted') AS needs_review, strftime(max(received_at), '%Y-%m-%d') AS last_intake FROM docs",
    "confirm_block_reason": f"WITH {DOCS} SELECT id, CASE WHEN id % 4 <= 1 THEN 'choose a type' WHEN id % 3 <> 0 THEN 'affirm the client' ELSE '' END AS block_reason FROM docs",
    "nudge_notes": f"""WITH {LISTS}, o AS (SELECT id, name, {MISSING} AS m FROM lists) SELECT id, CASE WHEN id % 3 = 0 AND length('Dear ' || name || ', please send ' || array_to_string(m, ', ')) <= 900 THEN 'Dear ' || name || ', please send ' || array_to_string(m, ', ')
  ELSE 'Hi ' || name || chr(44) || chr(10) || chr(10) || 'As we prepare your tax return, we''re still missing the following document' || CASE WHEN len(m) = 1 THEN '' ELSE 's' END || ':' || chr(10) || chr(10)
  || array_to_string(list_transform(m, lambda t: '- ' || t || chr(10)), '') || chr(10) || 'Could you send ' || CASE WHEN len(m) = 1 THEN 'this' ELSE 'these' END || ' over when you have a moment?' || chr(10) || chr(10) || 'Thank you.' END AS note,
  CASE WHEN id % 3 = 0 THEN 'model' ELSE 'template' END AS generated_by FROM o WHERE len(m) > 0""",
    "nudge_mailto": f"""WITH {LISTS}, o AS (SELECT id, 'Hi ' || name || ',' || chr(13) || chr(10) || chr(13) || chr(10) || array_to_string(list_transform({MISSING}, lambda t: '- ' || t), chr(13) || chr(10)) AS body FROM lists WHERE len({MISSING}) > 0)
  SELECT id, 'mailto:?subject=Missing%20documents&body=' || url_encode(body) AS href FROM o""",
    "normalize_doc_type": f"SELECT p_partkey, {_doc_type('raw')} AS doc_type FROM (SELECT p_partkey, {_pick(S.DOC_TYPE_ANSWERS, 'p_partkey')} AS raw FROM part)",
    "field_format": f"WITH {KV} SELECT p_partkey, key, value, {_ok('key', 'value')} AS ok FROM kv",
    "low_confidence": f"WITH {KV} SELECT p_partkey, (p_partkey % 5 = 0 OR NOT ({_ok('key', 'value')})) AS low_confidence FROM kv",
    "parse_money": f"WITH {KV} SELECT p_partkey, {_money('value')} AS amount FROM kv",
    "correction_category": f"WITH {KV} SELECT p_partkey, CASE WHEN {_any('lower(key)', V.CATEGORY_MONEY_TOKENS)} THEN 'money' WHEN {_tin('key')} THEN 'tin_ssn' ELSE 'names' END AS category, {_any('lower(key)', V.MONEY_TOKENS)} AS money, {_tin('key')} AS tin, {_name('key')} AS name FROM kv",
    "label_echo": f"WITH {KV} SELECT p_partkey, {_label('value')} AS echo FROM kv",
    "norm_string": f"WITH {KV} SELECT p_partkey, {_norm('value')} AS norm FROM kv",
    "mask_tin": rf"WITH {KV} SELECT p_partkey, CASE WHEN length(regexp_replace(value, '\D', '', 'g')) < 4 THEN CASE WHEN value = '' THEN '—' ELSE value END ELSE '•••-••-' || right(regexp_replace(value, '\D', '', 'g'), 4) END AS masked, CASE WHEN value = '' THEN '—' ELSE '$' || value END AS shown FROM kv",
    "slugify": "SELECT c_custkey, regexp_replace(regexp_replace(lower(c_name || ' & Sons, ' || c_mktsegment || '!'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM customer",
    "page_numbers": rf"SELECT p_partkey, CASE WHEN regexp_full_match(trim(v), '\+?\d+(\.0+)?') AND CAST(CAST(trim(v) AS DOUBLE) AS INT) >= 1 THEN CAST(CAST(trim(v) AS DOUBLE) AS INT) END AS page FROM (SELECT p_partkey, {_pick(S.PAGES, 'p_partkey')} AS v FROM part)",
    "file_sizes": "SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN CAST(floor(n / 1024.0 + 0.5) AS BIGINT) || ' KB' ELSE printf('%.1f', floor(n * 10 / 1048576.0 + 0.5) / 10) || ' MB' END AS size FROM (SELECT doc_id, strlen(text) * 97 * (doc_id % 13) AS n FROM documents)",
    "eligible_names": f"SELECT p_partkey, NOT starts_with(v, '.') AND list_contains({_list(V.INBOX_EXTENSIONS)}, {EXT.format('v')}) AS inbox, NOT starts_with(v, '.') AND list_contains({_list(V.UPLOAD_EXTENSIONS)}, {EXT.format('v')}) AS upload FROM (SELECT p_partkey, {NAMES} AS v FROM part)",
    "timestamps": f"SELECT p_partkey, strftime(try_strptime({_pick(S.TIMES, 'p_partkey')}, '%Y-%m-%dT%H:%M:%SZ'), '%Y-%m-%d %H:%M:%S') AS ts FROM part",
    "seeds": "SELECT p_partkey, substring(sha256('7:' || p_partkey), 1, 16) AS seed_hex FROM part",
    "exact_duplicates": f"WITH {EXACT} SELECT seq, sha, duplicate_of FROM flags",
    "near_duplicates": f"WITH {PAIRS} SELECT seq, cand AS duplicate_of, distance FROM pairs QUALIFY row_number() OVER (PARTITION BY seq ORDER BY distance, cand) = 1",
    "near_duplicates_banded": f"WITH {PAIRS} SELECT * FROM pairs",
    "near_duplicates_confirmed": f"""WITH {PAIRS} SELECT p.seq, cand AS duplicate_of, distance FROM pairs p JOIN prints a ON p.seq = a.seq JOIN prints b ON p.cand = b.seq
  WHERE len(list_filter(range(1, 65), lambda i: CAST(abs(a.vec[i] - b.vec[i]) AS FLOAT) > 0.2)) <= 24 QUALIFY row_number() OVER (PARTITION BY p.seq ORDER BY distance, cand) = 1""",
    "dedup_calibration": f"WITH {PAIRS} SELECT a.label = b.label AS same_label, min(distance) AS floor, max(distance) AS ceiling, count(*) AS pairs FROM pairs p JOIN prints a ON p.seq = a.seq JOIN prints b ON p.cand = b.seq GROUP BY 1",
    "closest_pairs": f"WITH {PAIRS} SELECT * FROM pairs ORDER BY distance, seq, cand LIMIT 6",
    "dangling_refs": f"WITH {EXACT} SELECT seq, CASE WHEN duplicate_of % 5 <> 0 THEN duplicate_of END AS duplicate_of FROM flags WHERE seq % 5 <> 0",
    "resolved_duplicates": f"WITH {EXACT} SELECT seq, CASE WHEN seq % 2 <> 0 THEN duplicate_of END AS duplicate_of FROM flags",
    "eval_field_scores": f"WITH {SCORES} SELECT file, key, verdict FROM scores",
    "eval_summary": f"""WITH {DOCS}, {SCORES}, f AS (SELECT count(*) AS fields, count(*) FILTER (verdict = 'correct') AS fields_correct, count(*) FILTER (verdict = 'wrong') AS silent_wrong, count(*) FILTER (verdict = 'missing') AS fields_missing,
  count(*) FILTER (verdict = 'wrong' AND low_confidence) AS silent_wrong_flagged, count(*) FILTER (verdict <> 'correct' AND low_confidence) AS errors_flagged FROM scores),
  d AS (SELECT count(*) AS docs, count(*) FILTER (id % 9 <> 0) AS types_correct, quantile_cont(CAST(id % 100 AS DOUBLE) / 4, 0.5) AS median_latency_s, count(*) FILTER (id % 7 = 0) AS hand_docs FROM docs)
  SELECT *, CAST(fields_correct AS DOUBLE) / fields AS field_accuracy, CAST(types_correct AS DOUBLE) / docs AS type_accuracy FROM f, d""",
    "flag_coverage": f"WITH {SCORES} SELECT verdict, coalesce(low_confidence, false) AS flagged, count(*) AS n FROM scores GROUP BY 1, 2",
    "ensemble_agreement": f"""WITH {FIELDS}, r AS (SELECT doc_id, pos <> 3 AND CASE WHEN pos % 2 = 0 THEN abs(CAST(printf('%.2f', value) AS DOUBLE) - CAST(printf('%.1f', value) AS DOUBLE)) <= 0.01
  ELSE {_norm("printf('%.2f', value)")} = {_norm("'$' || printf('%.1f', value)")} END AS agrees FROM fields) SELECT doc_id, count(*) FILTER (agrees) AS agreed, count(*) FILTER (NOT agrees) AS disputed FROM r GROUP BY 1""",
    "full_low_confidence": f"WITH {W2} SELECT id, key, {FULL_LOW} AS low_confidence FROM w2",
    "reask_budget": f"WITH {W2} SELECT id, key, row_number() OVER (PARTITION BY id ORDER BY pos) AS call FROM w2 WHERE NOT ({_ok('key', 'value')}) QUALIFY call <= 3",
    "reask_applied": f"""WITH {W2}, p AS (SELECT id, key FROM w2 WHERE NOT ({_ok('key', 'value')}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) <= 3)
  SELECT id, key, CASE WHEN (id, key) IN (SELECT (id, key) FROM p) AND {_ok('key', 'trim(answer)')} THEN trim(answer) ELSE value END AS value FROM w2""",
    "region_pass": f"""WITH {W2}, c AS (SELECT *, trim(answer) AS new, {_name('key')} AS is_name FROM w2), t AS (SELECT *, (is_name OR NOT ({_ok('key', 'value')})) AND new <> ''
  AND CASE WHEN is_name THEN NOT {_label('new')} AND length(new) >= 3 AND (value = '' OR {_norm('new')} <> {_norm('value')}) ELSE {_ok('key', 'new')} END AS take FROM c)
  SELECT id, key, CASE WHEN take THEN new ELSE value END AS value, take AND is_name AND value <> '' AS replaced FROM t""",
    "reading_views": f"""WITH {DOCS}, p AS (SELECT id, id % 3000 + 5 AS w, id % 1700 + 9 AS h FROM docs), v AS (SELECT id, w AS x1, 0 AS y0 FROM p
  UNION ALL SELECT id, unnest([w // 2 + 50, w, w // 2 + 50, w]), unnest([0, 0, h // 2 - 50, h // 2 - 50]) FROM p WHERE least(w, h) > 1400
  UNION ALL SELECT id, unnest(CASE WHEN h >= w THEN [w, w] ELSE [w // 2 + 50, w] END), unnest(CASE WHEN h >= w THEN [0, h // 2 - 50] ELSE [0, 0] END) FROM p WHERE least(w, h) <= 1400)
  SELECT id, count(*) AS views, CAST(sum(x1) AS BIGINT) AS right_edges, CAST(min(y0) AS INT) AS top FROM v GROUP BY 1""",
    "crop_boxes": f"""WITH {DOCS}, p AS (SELECT id, CAST(id % 3000 + 5 AS INT) AS w, CAST(id % 1700 + 9 AS INT) AS h FROM docs), r(field, x0, y0, x1, y1) AS (VALUES {', '.join(f"({_s(f)}, CAST({b[0]} AS DOUBLE), CAST({b[1]} AS DOUBLE), CAST({b[2]} AS DOUBLE), CAST({b[3]} AS DOUBLE))" for t, f, b, _ in V.REGIONS if t == 'W-2')}),
  b AS (SELECT id, field, CAST(least(greatest(floor(x0 * w), 0), w) AS INT) AS "left", CAST(least(greatest(floor(y0 * h), 0), h) AS INT) AS top, CAST(least(greatest(floor(x1 * w), 0), w) AS INT) AS "right", CAST(least(greatest(floor(y1 * h), 0), h) AS INT) AS bottom FROM p, r)
  SELECT *, "right" - "left" < 8 OR bottom - top < 8 AS too_small FROM b""",
    "pdf_pages": f"""WITH f AS (SELECT p_partkey || '_' || {NAMES} AS name, p_partkey % 2 = 0 AS magic, CAST(p_partkey % 25 AS INT) AS n FROM part), g AS (SELECT * FROM f WHERE magic OR {EXT.format('name')} = '.pdf')
  SELECT name, CASE WHEN n BETWEEN 1 AND 20 THEN CAST(page AS INT) END AS page_number, CASE WHEN n > 20 THEN 'more than 20 pages' WHEN n < 1 THEN 'no pages' END AS error FROM g, LATERAL (SELECT unnest(range(1, CASE WHEN n BETWEEN 1 AND 20 THEN n + 1 ELSE 2 END)) AS page)""",
    "confirmed_fields": f"""WITH {CONFIRMS}, agg AS (SELECT doc_id, key, arg_max(value, seq) AS value, coalesce(bool_or(value <> before), false) AS changed, arg_min(before, seq) FILTER (value <> before) AS first FROM met GROUP BY 1, 2)
  SELECT a.doc_id, a.key, a.value, changed OR coalesce(b.corrected, false) AS corrected, CASE WHEN b.corrected THEN b.original_value WHEN changed THEN first END AS original_value, coalesce(b.low_confidence, false) AND NOT changed AS low_confidence
  FROM agg a LEFT JOIN base b ON a.doc_id = b.doc_id AND a.key = b.key""",
    "confirm_events": f"WITH {CONFIRMS} SELECT seq, doc_id, count(*) FILTER (value <> before) AS fields_corrected FROM met WHERE seq >= 0 GROUP BY 1, 2",
    "confirmed_documents": f"""WITH {DOCS} SELECT id, CASE WHEN id % 5 = 0 THEN 'confirmed' ELSE status END AS status, CASE WHEN id % 10 = 0 THEN 'K-1' WHEN id % 5 = 0 THEN 'W-2' ELSE doc_type END AS doc_type,
  CASE WHEN id % 5 = 0 THEN client_id + 1 ELSE client_id END AS client_id FROM docs""",
    "reopened_documents": f"WITH {DOCS} SELECT id, CASE WHEN id % 2 = 0 AND status = 'confirmed' THEN 'extracted' ELSE status END AS status FROM docs",
    "discarded_documents": f"WITH {DOCS}, {DISCARDED} SELECT id, status FROM docs WHERE id NOT IN (SELECT id FROM gone)",
    "patched_clients": f"SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN c_name || ' Ltd' ELSE c_name END AS name, CASE WHEN c_custkey % 6 = 0 THEN 'b,a' ELSE {_s(','.join(D.PRIORITIES))} END AS expected FROM customer",
    "deleted_clients": "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 2 <> 0 OR c_custkey IN (SELECT o_custkey FROM orders)",
    "csv_import_plan": f"WITH {IMPORT} SELECT * FROM plan",
    "csv_import_counts": f"WITH {IMPORT} SELECT count(*) FILTER (action <> 'blank') AS found, count(*) FILTER (action = 'dupe') AS dupes, count(*) FILTER (action = 'blank') AS blanks, count(*) FILTER (action = 'create') AS to_create FROM plan",
    "inbox_exactly_once": """SELECT sha256(text) AS sha256, min(printf('%08d.png', doc_id)) AS name, CASE WHEN text = '' THEN 'rejected' ELSE 'ingested' END AS outcome FROM documents
  WHERE doc_id % 3 <> 0 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) GROUP BY text""",
    "inbox_stability": """WITH p AS (SELECT event_id AS poll, CAST((event_id // 4) % 50 AS VARCHAR) AS name, user_id // 75 AS size FROM events)
  SELECT poll, name, coalesce(lag(size) OVER w = size AND lag(poll) OVER w = poll - 1, false) AS stable FROM p WINDOW w AS (PARTITION BY name ORDER BY poll)""",
}
ORACLE_SQL |= intake.SQL | changes.SQL
#: The same reports, added up from stored hours.
ORACLE_SQL |= {f"stored_{a}": ORACLE_SQL[f"timeline_{b}"] for a, b in (("hours", "hourly"), ("totals", "totals"), ("latency", "latency"))}
