"""The deterministic part of the extraction pipeline, over columns of raw model answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.functions import fields as C
from paperloom.functions import tables as V


def ask(df: DataFrame, model_fn: Callable[[str, str], str], key: str, prompt: str, out: str) -> DataFrame:
    """Adds the model's answers; ``model_fn(key, prompt)`` is the only place where a model is called."""

    @F.pandas_udf("string")
    def call(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for keys, prompts in batches:
            yield pd.Series([model_fn(k, p) for k, p in zip(keys, prompts, strict=True)], dtype=object)

    return df.withColumn(out, call(F.col(key), F.col(prompt)))


def parsed(first: Column, second: Column) -> tuple[Column, Column]:
    """(object, retried): of the first answer that parses, and whether the first didn't."""
    a = C.parse_json(first)
    return F.coalesce(a, C.parse_json(second)), a.isNull()


def classified(answers: DataFrame) -> DataFrame:
    """id, raw1, raw2 -> id, doc_type, handwritten, retried; what doesn't parse is UNRECOGNIZED."""
    held, retried = parsed(F.col("raw1"), F.col("raw2"))
    return answers.select("*", held.alias("__o"), retried.alias("retried")).select(
        "id", C.normalize_doc_type(F.get_json_object("__o", "$.doc_type")).alias("doc_type"), C.coerce_bool(F.get_json_object("__o", "$.handwritten")).alias("handwritten"), "retried")


def cascaded(small: Column, large: Column) -> Column:
    """The large model's type, only where the small one recognised none."""
    return F.when(small == V.UNRECOGNIZED, large).otherwise(small)


def extracted(answers: DataFrame, schema: DataFrame) -> DataFrame:
    """id, doc_type, raw1, raw2 -> one row for each field of the type's schema; classify-only types have none.

    Values are trimmed, null is empty; where no answer parses the document has no rows.
    """
    held, retried = parsed(F.col("raw1"), F.col("raw2"))
    some = answers.select("id", "doc_type", held.alias("__o"), retried.alias("retried")).where("__o IS NOT NULL")
    rows = some.join(F.broadcast(schema), "doc_type")  # a fixed table
    plain = F.from_json("__o", "map<string,string>")
    return rows.select("id", "doc_type", "pos", "key", F.trim(F.coalesce(plain[F.col("key")], F.lit(""))).alias("value"), "retried")


def flags(fields: DataFrame) -> DataFrame:
    """Adds low_confidence of the full rules: format, retry, label echoes, amounts that aren't positive, box 2 over box 1."""
    money = C.parse_money(F.col("value"))
    base = C.field_low_confidence(F.col("key"), F.col("value"), F.col("retried")) | C.looks_like_label(F.col("value"))
    base = base | (C.is_money_key(F.col("key")) & F.coalesce(money <= 0, F.lit(False)))
    w = W.partitionBy("id")
    wages = F.max(F.when(F.col("key") == "box1_wages", money)).over(w)
    over = (F.col("doc_type") == "W-2") & (F.col("key") == "box2_fed_withheld") & F.coalesce(money >= wages, F.lit(False))
    return fields.select("*", (base | over).alias("low_confidence"))


def reask_plan(fields: DataFrame, cap: int = V.REASK_CAP) -> DataFrame:
    """The fields to ask for anew: those of bad format, the first ``cap`` of a document in schema order."""
    bad = fields.where(~C.field_format_ok(F.col("key"), F.col("value")))
    rank = F.row_number().over(W.partitionBy("id").orderBy("pos"))
    return bad.withColumn("call", rank.cast("bigint")).where(F.col("call") <= cap)


def reasked(fields: DataFrame, answers: DataFrame, cap: int = V.REASK_CAP) -> DataFrame:
    """Fields after focused questions (id, key, answer): a new value counts only if its format holds."""
    plan = reask_plan(fields, cap).select("id", "key").join(answers, ["id", "key"])
    new = plan.select("id", "key", F.trim(F.coalesce("answer", F.lit(""))).alias("new"))
    new = new.where(C.field_format_ok(F.col("key"), F.col("new")))
    return fields.join(new, ["id", "key"], "left").select(*fields.columns[:0], *[F.coalesce("new", "value").alias("value") if c == "value" else F.col(c) for c in fields.columns])


def region_plan(fields: DataFrame, regions: DataFrame, cap: int = V.REGION_CAP) -> DataFrame:
    """The fields to read from a crop: they have a region, and are a name or of bad format; ``cap`` a document."""
    has = regions.select("doc_type", F.col("field").alias("key"))
    some = fields.join(F.broadcast(has), ["doc_type", "key"], "left_semi")
    some = some.where(C.is_name_field(F.col("key")) | ~C.field_format_ok(F.col("key"), F.col("value")))
    rank = F.row_number().over(W.partitionBy("id").orderBy("pos"))
    return some.withColumn("call", rank.cast("bigint")).where(F.col("call") <= cap)


def region_pass(fields: DataFrame, answers: DataFrame, regions: DataFrame, cap: int = V.REGION_CAP) -> DataFrame:
    """Fields after crops (id, key, answer), with ``replaced`` where a good name gave way to another.

    A name is taken if it is no label and has three characters at least; other fields if their format holds.
    """
    new = region_plan(fields, regions, cap).select("id", "key").join(answers, ["id", "key"]).select("id", "key", F.trim(F.coalesce("answer", F.lit(""))).alias("new"))
    name = C.is_name_field(F.col("key"))
    fits = F.when(name, ~C.looks_like_label(F.col("new")) & (F.length("new") >= 3)).otherwise(C.field_format_ok(F.col("key"), F.col("new")))
    joined = fields.join(new.where((F.col("new") != "") & fits), ["id", "key"], "left")
    other = C.norm_string(F.col("new")) != C.norm_string(F.col("value"))
    take = F.col("new").isNotNull() & (~name | (F.col("value") == "") | other)
    out = joined.withColumn("replaced", F.coalesce(take & name & (F.col("value") != ""), F.lit(False)))
    return out.select(*[F.when(take, F.col("new")).otherwise(F.col("value")).alias("value") if c == "value" else F.col(c) for c in fields.columns], "replaced")


def run_pipeline(answers: DataFrame, schema: DataFrame) -> DataFrame:
    """id, class_raw1, class_raw2, fields_raw1, fields_raw2 -> id, status, doc_type, handwritten, retried, n_fields, n_low.

    Classify-only types and unrecognised documents have no fields and need no second question.
    """
    first = classified(answers.select("id", F.col("class_raw1").alias("raw1"), F.col("class_raw2").alias("raw2")))
    known = first.where(F.col("doc_type").isin(V.EXTRACT_TYPES)).select("id", "doc_type")
    asked = known.join(answers.select("id", F.col("fields_raw1").alias("raw1"), F.col("fields_raw2").alias("raw2")), "id")
    read = flags(extracted(asked, schema)).groupBy("id").agg(F.count("*").alias("n_fields"), F.count_if("low_confidence").alias("n_low"), F.bool_or("retried").alias("r2"))
    joined = first.join(read, "id", "left")
    fine = F.col("doc_type").isin(V.CLASSIFY_ONLY_TYPES) | F.col("n_fields").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select("id", F.when((F.col("doc_type") != V.UNRECOGNIZED) & fine, "extracted").otherwise("unrecognized").alias("status"), "doc_type", "handwritten", (F.col("retried") | F.coalesce("r2", F.lit(False))).alias("retried"), zero("n_fields").alias("n_fields"), zero("n_low").alias("n_low"))


def views(pages: DataFrame, overlap: int = 50, least: int = 1400) -> DataFrame:
    """id, width, height -> boxes a page is read in: itself, then quarters of large pages or halves along the long side."""
    w, h = F.col("width"), F.col("height")
    box = lambda a, b, c, d: F.struct(a.cast("int").alias("x0"), b.cast("int").alias("y0"), c.cast("int").alias("x1"), d.cast("int").alias("y1"))
    zero, mx, my = F.lit(0), F.floor(w / 2), F.floor(h / 2)
    quarters = F.array(box(zero, zero, mx + overlap, my + overlap), box(mx - overlap, zero, w, my + overlap), box(zero, my - overlap, mx + overlap, h), box(mx - overlap, my - overlap, w, h))
    halves = F.when(h >= w, F.array(box(zero, zero, w, my + overlap), box(zero, my - overlap, w, h))).otherwise(F.array(box(zero, zero, mx + overlap, h), box(mx - overlap, zero, w, h)))
    every = F.concat(F.array(box(zero, zero, w, h)), F.when(F.least(w, h) > least, quarters).otherwise(halves))
    return pages.select("id", F.posexplode(every).alias("view", "b")).select("id", "view", "b.x0", "b.y0", "b.x1", "b.y1")


def crop_boxes(pages: DataFrame, regions: DataFrame, least: int = 8, long_side: int = 1024) -> DataFrame:
    """id, doc_type, width, height -> each region in whole pixels, clamped; null under 8 pixels; and its upscaling."""
    px = lambda f, n: F.least(F.greatest(F.floor(F.col(f) * F.col(n)), F.lit(0)), F.col(n)).cast("int")
    rows = pages.join(F.broadcast(regions), "doc_type").select("id", "doc_type", "field", px("x0", "width").alias("left"), px("y0", "height").alias("top"), px("x1", "width").alias("right"), px("y1", "height").alias("bottom"))
    long_ = F.greatest(F.col("right") - F.col("left"), F.col("bottom") - F.col("top"))
    ok = (F.col("right") - F.col("left") >= least) & (F.col("bottom") - F.col("top") >= least)
    return rows.select("*", F.when(ok, F.greatest(F.lit(1.0), F.lit(float(long_side)) / long_)).alias("scale"))


def render_plan(files: DataFrame, cap: int = V.PDF_PAGE_CAP, dpi: float = 200.0, most: float = 4000.0) -> DataFrame:
    """name, head (first bytes as text), n_pages, width_pt, height_pt -> one row a page with its scale.

    A file is a PDF by its first bytes or its extension; one of more than ``cap`` pages is rejected whole.
    """
    pdf = F.col("head").startswith("%PDF") | (C.extension(F.col("name")) == ".pdf")
    some = files.where(pdf).withColumn("error", F.when(F.col("n_pages") > cap, F.format_string("more than %d pages", F.lit(cap))).when(F.col("n_pages") < 1, "no pages"))
    scale = F.least(F.lit(dpi / 72), F.lit(most) / F.greatest("width_pt", "height_pt"))
    pages = F.when(F.col("error").isNull(), F.sequence(F.lit(1), F.col("n_pages"))).otherwise(F.array(F.lit(None).cast("int")))
    return some.select("name", F.explode(pages).alias("page_number"), scale.alias("scale"), "error")
