"""State changes as functions of tables: confirm, re-open, discard, resolve, and clients."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.functions import fields as C
from paperloom.operators.carry import blocks_for, last_before, running_sum
from paperloom.operators.checklist import unchecked_after_delete
from paperloom.operators.steps import settled

FIELD = "doc_id bigint, key string, value string, corrected boolean, original_value string, low_confidence boolean"


def confirm_fields(fields: DataFrame, confirms: DataFrame) -> DataFrame:
    """Fields (FIELD's columns) after confirms (seq, doc_id, key, value), applied in order of seq.

    A differing value makes a field corrected, keeps the first original and drops low_confidence; a
    new key starts from the empty value; going back to the original stays a correction. The fold is
    done with windows: per field only changes of value matter, and the first of them sets the original.
    """
    base = fields.select("doc_id", "key", F.lit(-1).cast("bigint").alias("seq"), "value", "corrected", "original_value", "low_confidence")
    said = confirms.select("doc_id", "key", "seq", F.coalesce("value", F.lit("")).alias("value"), F.lit(False).alias("corrected"), F.lit(None).cast("string").alias("original_value"), F.lit(None).cast("boolean").alias("low_confidence"))
    w = W.partitionBy("doc_id", "key").orderBy("seq")
    rows = base.unionByName(said)
    before = F.when(F.col("seq") >= 0, F.coalesce(F.lag("value").over(w), F.lit("")))
    rows = rows.withColumn("changed", (F.col("seq") >= 0) & (F.col("value") != before))
    # original: of an already corrected field its own, else the value before the first change
    had = F.when((F.col("seq") < 0) & F.col("corrected"), F.col("original_value"))
    rows = rows.withColumns({"had": had, "first": F.when(F.col("changed"), before)})
    agg = rows.groupBy("doc_id", "key").agg(
        F.max_by("value", "seq").alias("value"), F.bool_or("changed").alias("changed"), F.bool_or(F.col("corrected")).alias("was"),
        F.max("had").alias("had"), F.min_by("first", F.when(F.col("changed"), F.col("seq"))).alias("first"), F.bool_or(F.col("low_confidence")).alias("low"),
    )
    fixed = F.col("changed") | F.col("was")
    original = F.when(F.col("was"), F.col("had")).when(F.col("changed"), F.col("first"))
    return agg.select("doc_id", "key", "value", fixed.alias("corrected"), F.when(fixed, original).alias("original_value"), (F.coalesce("low", F.lit(False)) & ~F.col("changed")).alias("low_confidence"))


def confirm_events(fields: DataFrame, confirms: DataFrame, blocks: int | None = None) -> DataFrame:
    """seq, doc_id, fields_corrected: how many keys each confirm changed against the value it met."""
    base = fields.select("doc_id", "key", F.lit(-1).cast("bigint").alias("seq"), "value")
    rows = base.unionByName(confirms.select("doc_id", "key", "seq", F.coalesce("value", F.lit("")).alias("value")))
    met = last_before(rows, ["doc_id", "key"], "seq", {"was": F.struct("value")}, blocks)
    changed = F.col("value") != F.coalesce("was.value", F.lit(""))
    return met.where("seq >= 0").groupBy("seq", "doc_id").agg(F.count_if(changed).alias("fields_corrected"))


def confirm_documents(docs: DataFrame, confirms: DataFrame) -> DataFrame:
    """Documents after confirms (seq, id, doc_type, client_id): the last one's type and client count."""
    last = confirms.groupBy("id").agg(F.max_by(F.struct("doc_type", "client_id"), "seq").alias("c"))
    joined = docs.join(last, "id", "left")
    met = F.col("c").isNotNull()
    return joined.select(*[
        F.when(met, F.lit("confirmed")).otherwise(F.col("status")).alias("status") if n == "status"
        else F.when(met, F.col(f"c.{n}")).otherwise(F.col(n)).alias(n) if n in ("doc_type", "client_id") else F.col(n)
        for n in docs.columns
    ])


def reopen(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Confirmed documents among ``ids`` are extracted again; the others stay (a conflict)."""
    joined = docs.join(ids.select(F.col("id").alias("re_id")).distinct(), F.col("id") == F.col("re_id"), "left")
    back = F.col("re_id").isNotNull() & (F.col("status") == "confirmed")
    return joined.select(*[F.when(back, "extracted").otherwise(F.col("status")).alias("status") if n == "status" else F.col(n) for n in docs.columns])


def discard(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids, "id", "left_anti")


def received_after_discard(lists: DataFrame, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, received_docs: without the types of which no other confirmed document is left."""
    gone = unchecked_after_delete(docs, ids).groupBy("client_id").agg(F.collect_set("doc_type").alias("gone"))
    joined = lists.join(gone, F.col("id") == F.col("client_id"), "left")
    return joined.select("id", F.filter("received_docs", lambda t: F.coalesce(~F.array_contains(F.col("gone"), t), F.lit(True))).alias("received_docs"))


def resolve_duplicates(flags: DataFrame, kept: DataFrame) -> DataFrame:
    """Flags (seq, duplicate_of) with those of ``kept`` (id) cleared; clearing twice changes nothing."""
    joined = flags.join(kept.select(F.col("id").alias("k")).distinct(), F.col("seq") == F.col("k"), "left")
    return joined.select("seq", F.when(F.col("k").isNull(), F.col("duplicate_of")).alias("duplicate_of"))


def patch_clients(clients: DataFrame, patches: DataFrame) -> DataFrame:
    """Clients after patches (seq, id, name, expected_docs), the last of each; null leaves a value, lists lose repeats."""
    last = patches.groupBy("id").agg(F.max_by(F.struct(F.col("name").alias("n"), F.col("expected_docs").alias("e")), "seq").alias("p"))
    joined = clients.join(last, "id", "left")
    return joined.select(*[
        F.coalesce("p.n", "name").alias("name") if c == "name" else F.coalesce(F.array_distinct("p.e"), F.col("expected_docs")).alias("expected_docs") if c == "expected_docs" else F.col(c)
        for c in clients.columns
    ])


def delete_clients(clients: DataFrame, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Clients without those of ``ids`` that no document holds on to."""
    free = ids.join(docs.select(F.col("client_id").alias("id")), "id", "left_anti")
    return clients.join(free, "id", "left_anti")


def mint_client_ids(names: DataFrame, taken: DataFrame, blocks: int | None = None) -> DataFrame:
    """seq, client_id for new clients (seq, name): client_<slug>, or the first free client_<slug>_n from 2 on.

    As one by one in order of seq, with ``taken`` (id) before. The names of a base take its lowest
    free numbers (1 is the base itself) in their order: the k-th of them is k plus the taken numbers
    that have fewer free ones below. Both counts are running sums over blocks, so that no base lies
    in one task. Bases that are another base with a number behind it compete for that one id first
    (``_rivals``).
    """
    base = F.concat(F.lit("client_"), C.slugify(F.col("name")))
    if blocks is None:
        blocks = blocks_for(names.count() + taken.count())
    own = settled(running_sum(names.select("seq", base.alias("base")), ["base"], "seq", F.lit(1), "nth", blocks))
    bases = own.groupBy("base").agg(F.min("seq").alias("first"))
    old = taken.select(F.col("id").alias("base"), F.lit(1).cast("bigint").alias("n")).union(_numbered(taken.select("id"), "id").select("stem", "n")).distinct()
    old = settled(old.join(bases.select("base"), "base", "left_semi"))
    edges = _numbered(bases, "base").join(bases.select(F.col("base").alias("stem")), "stem", "left_semi").select(F.col("base").alias("child"), "stem", "n", "first", _depth("stem").alias("depth"))
    edges = settled(edges.join(old.where("n = 1").select(F.col("base").alias("child")), "child", "left_anti"))
    for depth in sorted(r[0] for r in edges.select("depth").distinct().collect()):  # as many as numbers stand in a row
        old = settled(_rivals(own, old, edges.where(F.col("depth") == depth), blocks))
    free = _taken_below(old, blocks).select("base", (2 * (F.col("n") - F.col("rank"))).alias("at"), F.lit(1).alias("skip"), F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("bigint").alias("nth"))
    asked = own.select("base", (2 * (F.col("nth") - 1) + 1).alias("at"), F.lit(0).alias("skip"), "seq", "nth")
    placed = running_sum(free.unionByName(asked), ["base"], "at", F.col("skip"), "skipped", blocks).where("seq IS NOT NULL")
    number = F.col("nth") + F.col("skipped")
    return placed.select("seq", F.when(number == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), number.cast("string"))).alias("client_id"))


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` whose ``name`` is a stem and a number as minting writes it (from 2 on), with ``stem`` and ``n``."""
    parts = r"^(.*)_([1-9][0-9]{0,17})$"
    cut = rows.where(F.col(name).rlike(parts)).withColumns({"stem": F.regexp_extract(name, parts, 1), "n": F.regexp_extract(name, parts, 2).cast("bigint")})
    return cut.where("n > 1")


def _depth(name: str) -> Column:
    return F.size(F.split(F.regexp_extract(name, r"((?:_[0-9]+)*)$", 1), "_"))


def _taken_below(old: DataFrame, blocks: int | None) -> DataFrame:
    """``old`` (base, n) with ``rank``: a number's place among its base's taken ones, from 1."""
    return running_sum(old, ["base"], "n", F.lit(1), "rank", blocks)


def _rivals(own: DataFrame, old: DataFrame, edges: DataFrame, blocks: int | None) -> DataFrame:
    """``old`` with what the contests for ids (child = stem_n) decide: n is taken for the stem, or 1 for the child.

    The child's first name (seq ``first``) gets the id unless the stem has reached the number by then:
    unless more of its names came before than there are free numbers below. What children of lower
    numbers have won isn't free. That count runs along the numbers of a stem in constant memory.
    """
    came = own.select("base", "seq", F.lit(1).alias("one"), F.lit(None).cast("string").alias("child")).unionByName(edges.select(F.col("stem").alias("base"), F.col("first").alias("seq"), F.lit(0).alias("one"), "child"))
    before = running_sum(came, ["base"], "seq", F.col("one"), "before", blocks).where("child IS NOT NULL").select("child", "before")
    held = old.select("base", (2 * F.col("n")).alias("at"), F.lit(1).alias("one"), F.lit(None).cast("string").alias("child")).unionByName(edges.select(F.col("stem").alias("base"), (2 * F.col("n") - 1).alias("at"), F.lit(0).alias("one"), "child"))
    below = running_sum(held, ["base"], "at", F.col("one"), "below", blocks).where("child IS NOT NULL").select("child", "below")
    met = edges.join(before, "child").join(below, "child").select("stem", "n", "child", (F.col("n") - 1 - F.col("below") - F.col("before")).alias("room"))

    def contest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, won = None, 0
        for pdf in batches:
            out = []
            for stem, n, child, room in zip(pdf.stem, pdf.n, pdf.child, pdf.room, strict=True):
                if stem != now:
                    now, won = stem, 0
                wins = room >= won
                won += wins
                out.append((stem, int(n)) if wins else (child, 1))
            yield pd.DataFrame(out, columns=["base", "n"]).astype({"base": "object", "n": "int64"})

    decided = met.repartition("stem").sortWithinPartitions("stem", "n").mapInPandas(contest, "base string, n bigint")
    return old.unionByName(decided).distinct()


def import_plan(rows: DataFrame, clients: DataFrame) -> DataFrame:
    """rows (seq, name) with ``action``: blank, dupe (in the table or earlier in the file, by folded name) or create."""
    key = F.lower(F.trim(F.coalesce("name", F.lit(""))))
    known = clients.select(F.lower(F.trim("name")).alias("known")).distinct()
    keyed = rows.withColumn("key", key)
    named = keyed.where("key <> ''")
    first = named.groupBy("key").agg(F.min("seq").alias("first"))
    joined = named.join(first, "key").join(known, F.col("key") == F.col("known"), "left")
    told = F.when(F.col("known").isNotNull() | (F.col("seq") > F.col("first")), "dupe").otherwise("create")
    return joined.select("seq", "name", told.alias("action")).union(keyed.where("key = ''").select("seq", "name", F.lit("blank")))


def import_counts(plan: DataFrame) -> DataFrame:
    by = lambda a: F.count_if(F.col("action") == a)
    return plan.agg((F.count("*") - by("blank")).alias("found"), by("dupe").alias("dupes"), by("blank").alias("blanks"), by("create").alias("to_create"))
