"""Readers and writers of the intake's own formats."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import fields as C
from paperloom.functions import tables as V

FIELD_VALUE = "struct<value:string,corrected:boolean,original_value:string,low_confidence:boolean>"
DOCUMENT = f"id string, client_id string, status string, doc_type string, image_path string, received_at string, fields map<string,{FIELD_VALUE}>, source_name string, phash string, duplicate_of string, source string, page_number int, source_file string, error string"
CLIENT = "id string, name string, expected_docs array<string>, received_docs array<string>"
EVENT = (
    "ts string, type string, doc_id string, doc_type string, latency_s double, fields_total bigint, fields_low_confidence bigint, retried boolean, re_asks bigint, "
    "preprocessed boolean, model string, raw_ref string, error string, fields_corrected bigint, corrected_keys array<string>, manual_type_change boolean, "
    "duplicate_of string, action string, client_id string, generated_by string, name string"
)
TRACE = "doc_id string, ts string, model_runtime string, model_name string, status string, doc_type string, latency_s double, retried boolean, calls array<struct<seq:int,prompt:string,stage:string,retry:boolean,response:string,error:string>>"


def _state_schema() -> T.StructType:
    doc, client = T._parse_datatype_string(DOCUMENT), T._parse_datatype_string(CLIENT)
    return T.StructType([
        T.StructField("documents", T.MapType(T.StringType(), doc)), T.StructField("clients", T.MapType(T.StringType(), client)),
        T.StructField("seq_doc", T.LongType()), T.StructField("seq_client", T.LongType()),
    ])


def read_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, clients) of a state file, in its order as ``seq``; absent keys take their defaults."""
    state = spark.read.schema(_state_schema()).json(path, multiLine=True)
    docs = state.select(F.posexplode(F.map_entries("documents")).alias("seq", "e")).select("seq", "e.value.*")
    entry = lambda e: F.struct(e["key"].alias("key"), e["value"]["value"].alias("value"), F.coalesce(e["value"]["corrected"], F.lit(False)).alias("corrected"), e["value"]["original_value"].alias("original_value"), F.coalesce(e["value"]["low_confidence"], F.lit(False)).alias("low_confidence"))
    docs = docs.withColumn("fields", F.transform(F.map_entries("fields"), entry)).withColumn("source", F.coalesce("source", F.lit("upload")))
    clients = state.select(F.posexplode(F.map_entries("clients")).alias("seq", "e")).select("seq", "e.value.*")
    none = F.array().cast("array<string>")
    return docs, clients.withColumns({c: F.coalesce(c, none) for c in ("expected_docs", "received_docs")})


def pending(docs: DataFrame) -> DataFrame:
    """The work queue after a restart, in order of entry."""
    return docs.where("status = 'pending'").select("seq", "id", "image_path")


def write_state(df: DataFrame, path: str, keep: int = 2) -> str:
    """Writes a new version of the state under ``path`` and returns its folder.

    Versions are numbered; a version counts once its _SUCCESS file is there, so that a write that
    fails leaves the one before. ``df`` may come from the version before. Older ones than ``keep`` go.
    """
    spark = df.sparkSession
    done = state_versions(spark, path)
    out = f"{path}/v{(done[-1] if done else 0) + 1:012d}"
    df.write.mode("overwrite").parquet(out)
    fs, root = _files(spark, path)
    for old in done[: max(0, len(done) + 1 - keep)]:
        fs.delete(_path(spark, f"{path}/v{old:012d}"), True)
    return out


def current_state(spark: SparkSession, path: str) -> DataFrame:
    """The last whole version."""
    done = state_versions(spark, path)
    if not done:
        raise FileNotFoundError(f"no state under {path}")
    return spark.read.parquet(f"{path}/v{done[-1]:012d}")


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    root = _path(spark, path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def state_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions, in order."""
    fs, root = _files(spark, path)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(_path(spark, f"{path}/{n}/_SUCCESS")))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event log, one JSON object a line, with ``seq``, the order of entry; blank and broken lines are left out.

    seq is (file, start of its part, line): by file name, and in a file as written.
    """
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line")).alias("seq"))
    lines = lines.where(F.trim("value") != "")
    held = lines.select("seq", F.from_json("value", EVENT, {"mode": "PERMISSIVE"}).alias("e"), F.try_parse_json("value").isNotNull().alias("ok"))
    return held.where("ok AND e IS NOT NULL").select("seq", "e.*").withColumn("at", C.parse_timestamp(F.col("ts")))


def reportable(log: DataFrame) -> DataFrame:
    """``read_events`` as the reports take it: ``ts`` a time without zone, missing counts 0, lists empty, flags false."""
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("fields_total", "fields_low_confidence", "fields_corrected")}
    false = {c: F.coalesce(c, F.lit(False)) for c in ("manual_type_change", "retried")}
    listed = {"corrected_keys": F.coalesce("corrected_keys", F.array().cast("array<string>"))}
    return log.withColumn("ts", F.col("at").cast("timestamp_ntz")).drop("at").withColumns(zero | false | listed)


def referred(traces: DataFrame) -> DataFrame:
    """``read_traces`` with ``raw_ref``, the name that events know a trace by."""
    return traces.withColumn("raw_ref", F.concat(F.lit("raws/"), F.col("doc_id"), F.lit(".json")))


def calls(traces: DataFrame) -> DataFrame:
    """One row for each call of ``read_traces``: doc_id, pos, seq, stage, retry, prompt, response, error."""
    return traces.select("doc_id", F.posexplode("calls").alias("pos", "c")).select("doc_id", "pos", "c.seq", "c.stage", "c.retry", "c.prompt", "c.response", "c.error")


def field_rows(docs: DataFrame) -> DataFrame:
    """One row for each field of ``read_state``'s documents: doc_id, pos, key, value, corrected, original_value, low_confidence."""
    return docs.select(F.col("id").alias("doc_id"), F.posexplode("fields").alias("pos", "f")).select("doc_id", "pos", "f.key", "f.value", "f.corrected", "f.original_value", "f.low_confidence")


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Traces, the last of each doc_id; files that don't parse are left out."""
    held = spark.read.schema(TRACE).option("mode", "DROPMALFORMED").json(path, multiLine=True).where("doc_id IS NOT NULL")
    last = held.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in held.columns if c != "doc_id"]), "ts").alias("t"))
    return last.select("doc_id", "t.*")


def read_folder(spark: SparkSession, path: str, extensions: list[str] | None = None) -> DataFrame:
    """name, length, modified, content of the folder's eligible files. Spark lists no empty files."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    listed = files.select(name.alias("name"), "length", F.col("modificationTime").alias("modified"), "content")
    return listed.where(C.is_eligible(F.col("name"), extensions or V.UPLOAD_EXTENSIONS + [".pdf"]))


def read_test_images(spark: SparkSession, path: str, extensions: list[str] | None = None) -> DataFrame:
    """``read_folder`` for an evaluation: an error if the folder has no eligible file."""
    found = read_folder(spark, path, extensions)
    if found.drop("content").isEmpty():
        raise FileNotFoundError(f"no images in {path}")
    return found


def image_at(spark: SparkSession, path: str) -> DataFrame:
    """name, length, modified, content of the file at ``path``, no row if it isn't there or isn't eligible."""
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(held):
        return spark.createDataFrame([], "name string, length bigint, modified timestamp, content binary")
    return read_folder(spark, path)


def read_client_csv(spark: SparkSession, path: str) -> DataFrame:
    """seq, name, expected_docs (null for the template's), blank; a header row of known names is skipped.

    Quoted values may hold separators, quotes ("") and line breaks. A file is read by one task, as
    its rows have no borders of their own; a client list is a few kilobytes.
    """

    def rows(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            out = []
            for path_, held in zip(pdf.path, pdf.content, strict=True):
                started = False
                for k, row in enumerate(csv.reader(io.StringIO(bytes(held).decode("utf-8-sig"), newline=""))):
                    name = row[0].strip() if row else ""
                    blank = not any(x.strip() for x in row)
                    if not started and not blank:
                        started = True
                        if name.lower() in ("name", "client", "client name"):
                            continue
                    out.append((path_, k, name, row[1] if len(row) > 1 else None, blank or not name))
            yield pd.DataFrame(out, columns=["path", "seq", "name", "docs", "blank"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInPandas(rows, "path string, seq bigint, name string, docs string, blank boolean")
    listed = F.filter(F.transform(F.split("docs", "[;|]"), lambda t: F.trim(t)), lambda t: t != "")
    return found.select("seq", "name", F.when(F.size(listed) > 0, listed).alias("expected_docs"), "blank")


def with_template(rows: DataFrame) -> DataFrame:
    template = F.array(*[F.lit(x) for x in V.ORGANIZER_TEMPLATE])
    return rows.withColumn("expected_docs", F.coalesce("expected_docs", template))


def write_csv(df: DataFrame, path: str) -> None:
    """The export's CSV dialect: quotes doubled, CRLF, empty values bare."""
    df.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="", nullValue="", lineSep="\r\n")


def merge_labels(old: DataFrame, new: DataFrame) -> DataFrame:
    """Labels (file, ...) with new entries in the place of old ones."""
    return old.join(new.select("file"), "file", "left_anti").unionByName(new)


def synthetic_forms(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """n made-up W-2 forms with their labels, the same for each seed."""
    part = lambda salt, m: F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt)), F.lit(m))
    ssn = F.format_string("4%02d-%02d-%04d", part("a", 100), part("b", 99) + 1, part("c", 10000))
    wages = part("w", 200_000) + 12_000
    money = lambda c: F.format_number(c + part("d", 100) / 100, 2)
    return spark.range(n).select(F.format_string("w2_%06d.png", "id").alias("file"), F.lit("W-2").alias("doc_type"), ssn.alias("ssn"), money(wages).alias("box1_wages"), money(F.floor(wages / 5)).alias("box2_fed_withheld"))
