"""Queries of looks, replayed changes, closest pairs, hourly states and ids, and SQL for another engine.

The SQL states its tables and rules in full, without the engine's own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import tables as V
from paperloom.operators import checklist, dedup, extraction, replay
from paperloom.plans import queries
from paperloom.plans.queries import query
from paperloom.sources import domain as D
from paperloom.streaming import hours, inbox

SQL: dict[str, str] = {}


# --- watched folder ---


@query
def file_steps(spark, sf):
    """Ten files a look, some of them away; sizes and times from the event log."""
    n = F.col("event_id")
    found = D.table(spark, sf, "events").where("event_type <> 'error'")
    return inbox.file_steps(found.select(F.floor(n / 10).alias("poll"), F.concat(F.lit("f"), (n % 10).cast("string")).alias("name"), (F.col("user_id") % 2).alias("size"), F.floor(n / 700).alias("mtime")))


SQL["file_steps"] = """WITH l AS (SELECT event_id // 10 AS poll, 'f' || (event_id % 10) AS name, user_id % 2 AS size, event_id // 700 AS mtime FROM events WHERE event_type <> 'error'),
  s AS (SELECT *, CASE WHEN lag(poll) OVER w = poll - 1 AND lag(size) OVER w = size AND lag(mtime) OVER w = mtime THEN 0 ELSE 1 END AS fresh FROM l WINDOW w AS (PARTITION BY name ORDER BY poll)),
  r AS (SELECT *, sum(fresh) OVER (PARTITION BY name ORDER BY poll) AS run FROM s)
  SELECT poll, name, CASE row_number() OVER (PARTITION BY name, run ORDER BY poll) WHEN 1 THEN 'wait' WHEN 2 THEN 'read' ELSE 'skip' END AS step FROM r"""


# --- the log of changes ---


def _changed(spark, sf):
    """Documents with flags, and a log: a change for each line, by turns over the documents."""
    n = F.col("id")
    docs = D.documents(spark, sf).select("id", "status", "doc_type", "client_id", F.when(n % 5 == 0, n - 1).when(n % 7 == 0, n).alias("duplicate_of"))
    lines = D.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line")).agg(F.min("l_partkey").alias("part"))
    lines = lines.withColumn("mode", F.concat(F.lit("form "), (F.col("part") % 4).cast("string")))
    k = F.col("part") % 9
    action = F.when(k < 4, "confirm").when(k < 6, "reopen").when(k == 6, "resolve").when((k == 7) & (F.col("part") % 2 == 0), "discard").otherwise("confirm")
    doc_id = F.when((k == 8) & (F.col("part") % 4 == 0), -F.col("doc_id")).otherwise(F.col("doc_id"))  # some that aren't there
    return docs, lines.select((F.col("line") * 1_000_000_000_000 + F.col("doc_id")).alias("seq"), doc_id.alias("doc_id"), action.alias("action"), F.when(F.col("part") % 3 == 0, F.col("mode")).alias("doc_type"), F.when(F.col("part") % 5 == 0, F.col("part") % 100).alias("client_id"))


@query
def replayed_log(spark, sf):
    made = replay.replay(*_changed(spark, sf))
    events = made.events().select("seq", "type", F.col("doc_type").alias("type_after"), "manual_type_change")
    return made.results().join(events, "seq", "left")


@query
def replayed_documents(spark, sf):
    return replay.replay(*_changed(spark, sf)).documents()


@query
def replayed_checklists(spark, sf):
    made = replay.replay(*_changed(spark, sf)).received(D.checklists(spark, sf).select("id", "received_docs"))
    return made.select("id", F.array_join("received_docs", ",").alias("received"))


#: One change after another: a document's state is carried from each of its rows to the next.
CHANGED = """docs AS (SELECT o_orderkey AS id, o_custkey AS client_id, o_orderpriority AS doc_type, CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'extracted' ELSE 'pending' END AS status,
    CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey - 1 WHEN o_orderkey % 7 = 0 THEN o_orderkey END AS duplicate_of FROM orders),
  lines AS (SELECT l_orderkey AS doc_id, l_linenumber AS line, min(l_partkey) AS part, 'form ' || (min(l_partkey) % 4) AS mode FROM lineitem GROUP BY 1, 2),
  log AS (SELECT line * 1000000000000 + doc_id AS seq, CASE WHEN part % 9 = 8 AND part % 4 = 0 THEN -doc_id ELSE doc_id END AS doc_id, CASE WHEN part % 3 = 0 THEN mode END AS doc_type, CASE WHEN part % 5 = 0 THEN part % 100 END AS client_id,
    CASE WHEN part % 9 < 4 THEN 'confirm' WHEN part % 9 < 6 THEN 'reopen' WHEN part % 9 = 6 THEN 'resolve' WHEN part % 9 = 7 AND part % 2 = 0 THEN 'discard' ELSE 'confirm' END AS action FROM lines),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS n FROM log),
  away AS (SELECT doc_id AS target, min(seq) AS away_at FROM log JOIN docs ON doc_id = id WHERE action = 'discard' GROUP BY 1),
  state AS (SELECT id, 0 AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS action, CAST('' AS VARCHAR) AS outcome, false AS manual, false AS gone, status, doc_type, client_id, duplicate_of, away_at,
      CAST(NULL AS VARCHAR) AS was_status, CAST(NULL AS VARCHAR) AS was_type, CAST(NULL AS BIGINT) AS was_client FROM docs LEFT JOIN away ON duplicate_of = target
    UNION ALL
    SELECT s.id, l.n, l.seq, l.action,
      CASE WHEN gone THEN 'missing' WHEN l.action = 'reopen' AND status <> 'confirmed' THEN 'conflict' WHEN l.action = 'resolve' AND (duplicate_of IS NULL OR away_at < l.seq) THEN 'nothing' ELSE 'done' END,
      l.action = 'confirm' AND l.doc_type IS NOT NULL AND l.doc_type IS DISTINCT FROM s.doc_type, gone OR l.action = 'discard',
      CASE WHEN gone THEN status WHEN l.action = 'confirm' THEN 'confirmed' WHEN l.action = 'reopen' AND status = 'confirmed' THEN 'extracted' ELSE status END,
      CASE WHEN NOT gone AND l.action = 'confirm' THEN coalesce(l.doc_type, s.doc_type) ELSE s.doc_type END, CASE WHEN NOT gone AND l.action = 'confirm' THEN coalesce(l.client_id, s.client_id) ELSE s.client_id END,
      CASE WHEN l.action <> 'resolve' THEN duplicate_of END, away_at, status, s.doc_type, s.client_id
    FROM state s JOIN numbered l ON s.id = l.doc_id AND l.n = s.n + 1)"""

SQL["replayed_log"] = f"""WITH RECURSIVE {CHANGED}
  SELECT seq, id AS doc_id, action, outcome, CASE WHEN outcome = 'done' THEN CASE action WHEN 'confirm' THEN 'confirmed' WHEN 'reopen' THEN 'unconfirmed' WHEN 'discard' THEN 'deleted' ELSE 'dup_resolved' END END AS type,
    CASE WHEN outcome = 'done' AND action <> 'resolve' THEN doc_type END AS type_after, CASE WHEN outcome = 'done' AND action = 'confirm' THEN manual END AS manual_type_change FROM state WHERE n > 0
  UNION ALL SELECT seq, doc_id, action, 'missing', NULL, NULL, NULL FROM log WHERE doc_id NOT IN (SELECT id FROM docs)"""
SQL["replayed_documents"] = f"""WITH RECURSIVE {CHANGED}, last AS (SELECT * FROM state QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC) = 1)
  SELECT id, status, doc_type, client_id, CASE WHEN away_at IS NULL THEN duplicate_of END AS duplicate_of FROM last WHERE NOT gone"""
SQL["replayed_checklists"] = f"""WITH RECURSIVE {CHANGED},
  spells AS (SELECT id, client_id AS c, doc_type AS t, coalesce(seq, -1) AS since, coalesce(lead(seq) OVER (PARTITION BY id ORDER BY n), 9223372036854775807) AS until, status, gone FROM state QUALIFY status = 'confirmed' AND NOT gone),
  offs AS (SELECT was_client AS c, was_type AS t, max(seq) AS off_at FROM state s WHERE outcome = 'done' AND action IN ('reopen', 'discard') AND was_status = 'confirmed'
    AND NOT EXISTS (SELECT 1 FROM spells x WHERE x.c = s.was_client AND x.t = s.was_type AND x.id <> s.id AND x.since < s.seq AND x.until > s.seq) GROUP BY 1, 2),
  ons AS (SELECT client_id AS c, doc_type AS t, min(seq) AS on_at FROM state LEFT JOIN offs ON c = client_id AND t = doc_type WHERE outcome = 'done' AND action = 'confirm' AND (off_at IS NULL OR seq > off_at) GROUP BY 1, 2),
  had AS (SELECT client_id AS c, doc_type AS t, row_number() OVER (PARTITION BY client_id ORDER BY doc_type) AS pos FROM (SELECT DISTINCT client_id, doc_type FROM docs WHERE status = 'confirmed')),
  kept AS (SELECT c, t, pos AS place FROM had ANTI JOIN offs USING (c, t) UNION ALL SELECT c, t, 1000 + on_at FROM ons WHERE (c, t) NOT IN (SELECT (c, t) FROM had ANTI JOIN offs USING (c, t)))
  SELECT c_custkey AS id, coalesce(string_agg(t, ',' ORDER BY place), '') AS received FROM customer LEFT JOIN kept ON c_custkey = c GROUP BY 1"""


# --- closest pairs ---

PRINTS = """prints AS (SELECT vec_id AS seq, label, embedding AS vec, CAST(list_sum([CASE WHEN embedding[i] > embedding[i + 1] THEN CAST(1 AS HUGEINT) << (i - 1) ELSE 0 END for i in range(1, 64)]) AS BIGINT) AS fp FROM embeddings),
  p AS (SELECT a.label IS NOT DISTINCT FROM b.label AS same_label, a.seq, b.seq AS cand, CAST(bit_count(xor(a.fp, b.fp)) AS BIGINT) AS distance, a.vec AS va, b.vec AS vb FROM prints a JOIN prints b ON b.seq < a.seq),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY same_label ORDER BY distance, seq, cand) AS rank FROM p QUALIFY rank <= 6)"""
SQL["closest_pairs_by_label"] = f"WITH {PRINTS} SELECT same_label, rank, seq, cand, distance FROM ranked"
SQL["dedup_floors"] = f"WITH {PRINTS} SELECT same_label, min(distance) AS floor, count(*) AS pairs, CASE WHEN NOT same_label THEN 16 < min(distance) END AS threshold_below FROM p GROUP BY 1"


@query
def calibration_checks(spark, sf):
    """Variants: halved, rounded to two places, each eighth cell moved a little."""
    nudged = lambda v: F.transform(v, lambda x, i: x + F.when(i % 8 == 0, F.lit(0.03125)).otherwise(F.lit(0.0)))
    variants = [lambda v: F.transform(v, lambda x: (x / 2).cast("double")), lambda v: F.transform(v, lambda x: F.floor(x * 64) / 64), lambda v: F.transform(nudged(v), lambda x: x.cast("double"))]
    return dedup.calibration_checks(queries._prints(spark, sf), variants, delta=0.125)


SQL["calibration_checks"] = f"""WITH {PRINTS},
  made AS (SELECT fp, vec, unnest([list_transform(vec, lambda x: CAST(x / 2 AS DOUBLE)), list_transform(vec, lambda x: floor(CAST(x AS DOUBLE) * 64) / 64), list_transform(vec, lambda x, i: CAST(x AS DOUBLE) + CASE WHEN (i - 1) % 8 = 0 THEN 0.03125 ELSE 0 END)]) AS m FROM prints),
  c AS (SELECT max(bit_count(xor(fp, CAST(list_sum([CASE WHEN m[i] > m[i + 1] THEN CAST(1 AS HUGEINT) << (i - 1) ELSE 0 END for i in range(1, 64)]) AS BIGINT)))) AS band, max(len([1 for i in range(1, len(vec) + 1) if abs(CAST(vec[i] AS DOUBLE) - m[i]) > 0.125])) AS cells FROM made),
  v AS (SELECT 'copies_band' AS check, CAST(band AS BIGINT) AS value, band <= 16 AS passes FROM c UNION ALL SELECT 'copies_cells', CAST(cells AS BIGINT), cells <= 6 FROM c
    UNION ALL SELECT 'cross_floor', min(distance), min(distance) > 16 FROM p WHERE NOT same_label
    UNION ALL SELECT 'distinct_cells', CAST(min(n) AS BIGINT), min(n) > 6 FROM (SELECT len([1 for i in range(1, len(va) + 1) if abs(va[i] - vb[i]) > 0.125]) AS n FROM ranked WHERE same_label))
  SELECT * FROM v"""


# --- hours that add up ---


def _stored(spark, sf):
    """The log in seven batches, each turned into cells by itself."""
    events = D.events(spark, sf)
    parts = [hours.cells(events.where(F.col("seq") % 7 == k)) for k in range(7)]
    return hours.merged(reduce(DataFrame.unionByName, parts)), events


@query
def stored_hours(spark, sf):
    return hours.hourly(_stored(spark, sf)[0])


@query
def stored_totals(spark, sf):
    return hours.totals(hours.in_window(*_stored(spark, sf), 24))


@query
def stored_latency(spark, sf):
    return hours.latency(hours.in_window(*_stored(spark, sf), 24))


# --- queries of other modules ---

#: One name after another within a stem, with the list of what is used so far.
SQL["client_id_mint"] = r"""WITH RECURSIVE t AS (SELECT c_custkey AS seq, 'client_' || trim(regexp_replace(lower(c_mktsegment || CASE WHEN c_custkey % 7 = 0 THEN ' 2' WHEN c_custkey % 11 = 0 THEN '!' ELSE '' END), '[^a-z0-9]+', '_', 'g'), '_') AS base FROM customer),
  s AS (SELECT *, regexp_replace(base, '(_[0-9]+)+$', '') AS stem FROM t), o AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY seq) AS n, count(*) OVER (PARTITION BY stem) AS most FROM s),
  m AS (SELECT stem, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST('' AS VARCHAR) AS client_id, list_filter(['client_building', 'client_building_3', 'client_machinery_2'], lambda x: regexp_replace(x, '(_[0-9]+)+$', '') = stem) AS used FROM (SELECT DISTINCT stem FROM o)
    UNION ALL
    SELECT stem, n, seq, id, list_append(used, id) FROM (SELECT m.stem, o.n, o.seq, used, CASE WHEN NOT list_contains(used, base) THEN base ELSE base || '_' || list_filter(range(2, most + 5), lambda k: NOT list_contains(used, base || '_' || k))[1] END AS id FROM m JOIN o ON m.stem = o.stem AND o.n = m.n + 1))
  SELECT seq, client_id FROM m WHERE n > 0"""
SQL["documents_by_id"] = "SELECT o_orderkey AS seq, o_orderkey AS id, o_custkey AS client_id, CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'extracted' ELSE 'pending' END AS status, o_orderpriority AS doc_type FROM orders"
SQL["trace_responses"] = "SELECT conv_id AS doc_id, turn AS seq, CASE WHEN role <> 'system' THEN role END AS stage, text AS response, substring(text, 1, 240) AS head FROM conversations"
SQL["wide_print_digits"] = """WITH v AS (SELECT vec_id AS seq, embedding AS e FROM embeddings), w AS (SELECT seq, list_transform(range(256), lambda i: CASE WHEN e[i % 64 + 1] > e[(i % 64 + i // 64 + 1) % 64 + 1] THEN 1 ELSE 0 END) AS b FROM v)
  SELECT seq, array_to_string(list_transform(range(64), lambda k: substr('0123456789abcdef', CAST(8 * b[4 * k + 1] + 4 * b[4 * k + 2] + 2 * b[4 * k + 3] + b[4 * k + 4] + 1 AS BIGINT), 1)), '') AS phash FROM w"""


@query
def cascaded_types(spark, sf):
    """A small model that recognises two forms of three, and a large one that misses one of seven."""
    n = F.col("id")
    small = F.when(n % 3 == 0, V.UNRECOGNIZED).otherwise(F.col("doc_type"))
    large = F.when(n % 7 == 0, V.UNRECOGNIZED).otherwise(F.concat(F.col("doc_type"), F.lit(" (large)")))
    return D.documents(spark, sf).select("id", extraction.cascaded(small, large).alias("doc_type"))


SQL["cascaded_types"] = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority WHEN o_orderkey % 7 = 0 THEN 'UNRECOGNIZED' ELSE o_orderpriority || ' (large)' END AS doc_type FROM orders"


@query
def wrapped_fields(spark, sf):
    """Amounts as a model reads them, some without digits; answers of every fifth document came at the second try."""
    read = F.when(F.col("pos") == 3, "see form").otherwise(F.format_string("%.2f", "value"))
    fields = D.fields(spark, sf).select("doc_id", F.lit("box1_wages").alias("key"), "pos", read.alias("value"))
    return checklist.wrap_fields(fields, F.col("doc_id") % 5 == 0).select("doc_id", "pos", "value", "corrected", "low_confidence")


SQL["wrapped_fields"] = """SELECT l_orderkey AS doc_id, l_linenumber AS pos, CASE l_linenumber WHEN 3 THEN 'see form' ELSE printf('%.2f', min(l_extendedprice)) END AS value, false AS corrected, l_linenumber = 3 OR l_orderkey % 5 = 0 AS low_confidence FROM lineitem GROUP BY 1, 2"""
