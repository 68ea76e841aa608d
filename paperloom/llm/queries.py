"""The queries that apply each operator to its whole table, by name, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import decontaminate, negatives, pieces, quality, repeats, sharding, simhash, suffixes, tokenfiles, toxicity, turns, webtext, winnow
from paperloom.llm.common import small_batches, table

#: The vocabularies' places; parameters of the operators.
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_permutation_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place_documents(table(spark, sf_dir, "documents"))


def op2_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_report(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprint_report(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.suffix_report(table(spark, sf_dir, "documents"))


def op5_simhash_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.linked(table(spark, sf_dir, "documents"))


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_repeated_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.unit_report(table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webtext.extract(table(spark, sf_dir, "pages"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_report(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op10_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mined(table(spark, sf_dir, "embeddings"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return turns.repair_report(turns.damaged(table(spark, sf_dir, "conversations")))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_permutation_sharding,
        op2_merge_dropout,
        op3_winnowing,
        op4_suffix_dedup,
        op5_simhash_links,
        op6_ordinal_quality,
        op7_repeated_units,
        op8_main_text,
        op9_token_files,
        op10_benchmark_hits,
        op11_hard_negatives,
        op12_turn_repair,
        op13_toxicity,
    )
}
ORACLE_SQL: dict[str, str] = {
    # 50-byte strings as 100 hex digits, the least doc_id of each, runs of the places that lose theirs
    "op4_suffix_dedup": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  w AS (SELECT doc_id, k, substring(h, 2 * k + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS k FROM d WHERE length(h) >= 100)),
  gone AS (SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY s) AS least FROM w) WHERE least < doc_id),
  edge AS (SELECT doc_id, k, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) <= 50 THEN 0 ELSE 1 END AS opens FROM gone),
  run AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS b FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY k) AS r FROM edge) GROUP BY doc_id, r),
  part AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM run),
  kept AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS x FROM part JOIN d USING (doc_id) GROUP BY doc_id)
  SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(x, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    # all windows of documents joined with those of the items, by their words
    "op10_benchmark_hits": r"""WITH t AS (SELECT 'd' AS side, CAST(doc_id AS VARCHAR) AS id, doc_id, text FROM documents UNION ALL SELECT 'i', CAST(item_id AS VARCHAR), NULL, text FROM benchmark),
  w AS (SELECT side, id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM t),
  i AS (SELECT id, ws, least(len(ws), 10) AS n FROM w WHERE side = 'i' AND len(ws) > 0),
  iw AS (SELECT DISTINCT n, id, array_to_string(ws[k : k + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS k FROM i)),
  d AS (SELECT doc_id, ws FROM w WHERE side = 'd'),
  dw AS (SELECT doc_id, n, k, array_to_string(ws[k : k + n - 1], ' ') AS win FROM (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
  hit AS (SELECT doc_id, k, n, id FROM dw JOIN iw USING (n, win)),
  c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY 1),
  l AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, id FROM hit) GROUP BY 1)
  SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)""",
    # every anchor with every other row
    "op11_hard_negatives": """WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
  p AS (SELECT ar, anchor_id, br, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, id) <= 5)
  SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.ar, p.br ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (ar) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3""",
    # the checksum byte by byte; row by row the least (cost, letters) of each of the four states; the letters applied to the rows
    "op12_turn_repair": r"""WITH RECURSIVE
  crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM (SELECT unnest(range(256)) AS i)),
  c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
  k AS (SELECT c.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(key) + 1), lambda j: CAST(ascii(substr(key, j, 1)) AS BIGINT))), lambda h, b: xor(h >> 8, tab[(xor(h, b) & 255) + 1]))) % 20 AS kind FROM c, crc),
  d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind > 0),
  f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, substr(role, 1, 1) AS i FROM d),
  r AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN nth > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault, lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i AS pair FROM f),
  v AS (SELECT conv_id, CAST(0 AS BIGINT) AS n, {'c': CAST(0 AS BIGINT), 's': ''} AS z, {'c': CAST(99999999 AS BIGINT), 's': ''} AS y, {'c': CAST(2 AS BIGINT), 's': 'I'} AS u, {'c': CAST(4 AS BIGINT), 's': 'II'} AS a FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT conv_id, n, z, y, u, list_sort([a, {'c': u.c + 2, 's': u.s || 'I'}])[1] AS a FROM (
      SELECT conv_id, n, z, y, list_sort([u, {'c': z.c + 2, 's': z.s || 'I'}, {'c': y.c + 2, 's': y.s || 'I'}, {'c': a.c + 2, 's': a.s || 'I'}])[1] AS u, a FROM (
        SELECT conv_id, n, {'c': z.c + 3, 's': z.s || 'D'} AS z,
          list_sort([{'c': y.c + 3, 's': y.s || 'D'}, {'c': z.c + more + s, 's': z.s || 'K'}])[1] AS y,
          list_sort([{'c': u.c + 3, 's': u.s || 'D'}, {'c': z.c + more + su, 's': z.s || k}, {'c': y.c + more + su, 's': y.s || k}, {'c': a.c + more + su, 's': a.s || k}])[1] AS u,
          list_sort([{'c': a.c + 3, 's': a.s || 'D'}, {'c': u.c + more + sa, 's': u.s || l}])[1] AS a
        FROM (SELECT v.conv_id, r.n, z, y, u, a, CASE fault WHEN 0 THEN 0 WHEN 3 THEN 1 ELSE 9999999 END AS more, CASE i WHEN 's' THEN 0 ELSE 9999999 END AS s, CASE i WHEN 'u' THEN 0 ELSE 2 END AS su, CASE i WHEN 'a' THEN 0 ELSE 2 END AS sa, CASE i WHEN 'u' THEN 'K' ELSE 'R' END AS k, CASE i WHEN 'a' THEN 'K' ELSE 'R' END AS l
          FROM v JOIN r ON v.conv_id IS NOT DISTINCT FROM r.conv_id AND r.n = v.n + 1)))),
  e AS (SELECT conv_id, list_sort([z, a])[1] AS e FROM v QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
  x AS (SELECT conv_id, p, letter, sum(CASE letter WHEN 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY p) AS n FROM (SELECT conv_id, unnest(range(1, length(e.s) + 1)) AS p, unnest(string_split(e.s, '')) AS letter FROM e WHERE e.s <> '')),
  t AS (SELECT x.conv_id, p, letter, role, CASE letter WHEN 'I' THEN '' ELSE text END AS text, sum(CASE WHEN letter = 'D' OR letter = 'K' AND i = 's' THEN 0 ELSE 1 END) OVER (PARTITION BY x.conv_id ORDER BY p) AS nth FROM x LEFT JOIN r ON x.conv_id IS NOT DISTINCT FROM r.conv_id AND x.n = r.n),
  o AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN nth % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS made FROM t WHERE letter <> 'D' GROUP BY 1),
  g AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1)
  SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, e.e.c AS cost, e.e.s AS audit, sha256(coalesce(made, '')) AS repaired_sha256
  FROM e LEFT JOIN g ON e.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN o ON e.conv_id IS NOT DISTINCT FROM o.conv_id""",
}
