"""From the intake's own files to its reports, and what a run leaves behind."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from paperloom.functions import fields as C
from paperloom.operators import dedup, evaluate, intake, mutations, reports, telemetry
from paperloom.sources import readers
from paperloom.streaming import inbox

LOG = [
    {"ts": "2024-01-02T10:05:00Z", "type": "extracted", "doc_id": "doc_001", "doc_type": "W-2", "latency_s": 4.0, "fields_total": 5, "fields_low_confidence": 1, "retried": True, "model": "m", "preprocessed": True, "raw_ref": "raws/doc_001.json"},
    {"ts": "2024-01-02T10:40:00Z", "type": "unrecognized", "doc_id": "doc_002", "latency_s": 2.005, "raw_ref": "raws/doc_002.json"},
    {"ts": "2024-01-02T11:10:00Z", "type": "confirmed", "doc_id": "doc_001", "fields_corrected": 2, "corrected_keys": ["box1_wages", "ssn"], "manual_type_change": True},
    {"ts": "2024-01-02T11:20:00Z", "type": "confirmed", "doc_id": "doc_003", "fields_corrected": 1, "corrected_keys": ["employer"]},
    {"ts": "2023-12-01T00:00:00Z", "type": "extracted", "doc_id": "doc_000", "latency_s": 9.0, "fields_total": 5},
    {"ts": "no time", "type": "extracted", "doc_id": "doc_009", "raw_ref": None},
]


@pytest.fixture
def log(spark, tmp_path):
    (tmp_path / "events.jsonl").write_text("\n\n".join(json.dumps(e) for e in LOG) + "\nbroken {\n")
    clock = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-02 11:30:00' AS now")
    return readers.reportable(readers.read_events(spark, str(tmp_path / "events.jsonl"))), clock


def test_log_to_timeline(spark, log):
    events, clock = log
    hours = telemetry.hourly(events, clock).collect()
    assert len(hours) == 24 and {r.hour: (r.docs, r.corrections) for r in hours if r.docs or r.corrections} == {"2024-01-02 10:00": (2, 0), "2024-01-02 11:00": (0, 3)}
    got = reports.report_totals(events, clock).first().asDict()
    assert got == {"docs_processed": 2, "fields_extracted": 5, "fields_low_confidence": 1, "fields_corrected": 3, "correction_rate": 0.6, "first_try_type_acc": 0.5, "median_latency_s": 3.0, "p95_latency_s": 4.0}
    assert {r.category: r.corrections for r in reports.report_categories(events, clock).collect()} == {"money": 1, "tin_ssn": 1, "names": 1, "doc_type": 1}
    assert tuple(reports.low_confidence_share(reports.report_totals(events, clock)).first()) == ("20.0%", "20%")
    none = reports.report_totals(events.limit(0), clock).first()
    assert none.correction_rate == 0 and none.p95_latency_s == 0 and reports.low_confidence_share(reports.report_totals(events.limit(0), clock)).first().low == "0%"


def test_log_and_traces_to_runs(spark, log, tmp_path):
    (tmp_path / "raws").mkdir()
    trace = {"doc_id": "doc_001", "ts": "2024", "model_runtime": "local", "calls": [{"seq": 1, "prompt": "p", "stage": "classify", "response": "r"}, {"seq": 2, "prompt": "q", "stage": "extract", "retry": True}, {"seq": 3, "prompt": "s"}, {"prompt": "t", "stage": ""}]}
    (tmp_path / "raws/doc_001.json").write_text(json.dumps(trace))
    (tmp_path / "raws/doc_008.json").write_text("{broken")
    traces = readers.referred(readers.read_traces(spark, str(tmp_path / "raws")))
    rows = reports.runs(log[0], traces).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == ["doc_009", "doc_000", "doc_002", "doc_001"]  # the last written first
    last = rows[-1]
    assert (last.model_runtime, last.model_name, last.retried, last.call_count, last.stages, last.raw_available) == ("local", "m", True, 4, ["classify", "extract", "call 3", "call 4"], True)
    assert (rows[0].model_runtime, rows[0].call_count, rows[0].stages, rows[0].raw_available, rows[0].retried) == ("ollama", None, [], False, False)
    assert [r.doc_id for r in reports.runs(log[0], traces, limit=1).collect()] == ["doc_009"]
    assert [(r.pos, r.stage) for r in readers.calls(traces).orderBy("pos").collect()] == [(0, "classify"), (1, "extract"), (2, None), (3, "")]


def test_the_clock_reaches_the_scan(spark):
    from paperloom.plans.queries import QUERIES

    for name in ("timeline_hourly", "timeline_totals", "report_totals"):
        import paperloom.plans.intake  # noqa: F401

        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(ts" in plan and "NestedLoop" not in plan.split("hour_start")[0], name


def test_state_is_swapped_whole(spark, tmp_path):
    path = str(tmp_path / "state")
    readers.write_state(spark.range(3), path)
    readers.write_state(readers.current_state(spark, path).where("id > 0"), path)  # reads what it replaces
    assert sorted(r.id for r in readers.current_state(spark, path).collect()) == [1, 2]
    (tmp_path / "state/v000000000009").mkdir()  # a write that broke off
    assert readers.current_state(spark, path).count() == 2
    readers.write_state(spark.range(1), path)
    assert readers.state_versions(spark, path) == [2, 3]
    with pytest.raises(FileNotFoundError):
        readers.current_state(spark, str(tmp_path / "none"))


def test_state_to_fields(spark, tmp_path):
    state = {"documents": {"doc_002": {"id": "doc_002", "status": "extracted", "fields": {"z": {"value": "1"}, "a": {"value": "2", "corrected": True, "original_value": "0"}}}}, "clients": {}}
    (tmp_path / "s.json").write_text(json.dumps(state))
    docs, _ = readers.read_state(spark, str(tmp_path / "s.json"))
    rows = readers.field_rows(docs).orderBy("pos").collect()
    assert [(r.key, r.value, r.corrected) for r in rows] == [("z", "1", False), ("a", "2", True)]
    assert reports.correction_stats(docs, readers.field_rows(docs)).first().correction_rate == 0.5


def test_documents_are_numbered_on(spark):
    rows = [(k, f"n{k}.JPG" if k % 2 else None, "folder" if k == 4 else "upload", None, None, "p", None) for k in (9, 4, 7, 30, 2)]
    d = spark.createDataFrame(rows, "seq bigint, name string, source string, page_number int, source_file string, phash string, duplicate_of string").repartition(3)
    got = intake.created_documents(d, 998, F.lit("now")).orderBy("seq").collect()
    assert [r.id for r in got] == ["doc_999", "doc_1000", "doc_1001", "doc_1002", "doc_1003"]
    assert [(r.image_path, r.source) for r in got][:3] == [("uploads/doc_999.png", None), ("uploads/doc_1000.png", "folder"), ("uploads/doc_1001.jpg", None)]
    assert intake.created_documents(d.limit(0), 0, F.lit("now")).count() == 0
    names = spark.createDataFrame([(1, "Ann"), (2, "Ann")], "seq bigint, name string")
    ids = mutations.mint_client_ids(names, spark.createDataFrame([], "id string"))
    assert sorted(r.id for r in intake.created_clients(names, ids, F.array(F.lit("W-2"))).collect()) == ["client_ann", "client_ann_2"]


def test_failed_calls_are_rows_not_jobs(spark, tmp_path):
    d = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "p")], "key string, prompt string")
    folder = str(tmp_path)

    def model(key, prompt):
        import os

        n = len([f for f in os.listdir(folder) if f.startswith(key)])
        open(f"{folder}/{key}{n}", "w").close()
        if key == "b" or key == "c" and n < 2:
            raise TimeoutError("away")
        return f"{key}!"

    got = {r.key: (r.answer, r.error) for r in intake.asked(d.coalesce(1), model, "key", "prompt").collect()}
    assert got == {"a": ("a!", None), "b": (None, "TimeoutError: away"), "c": ("c!", None)}
    runs = intake.settled(spark.createDataFrame([("b", None, None, "TimeoutError: away"), ("a", "unrecognized", "UNRECOGNIZED", None)], "id string, status string, doc_type string, error string"))
    assert sorted(map(tuple, runs.collect())) == [("a", "unrecognized", "UNRECOGNIZED", None), ("b", "error", "UNRECOGNIZED", "TimeoutError: away")]
    for _ in range(2):  # a batch that comes again replaces itself
        intake.write_run(d, d.limit(1), d, str(tmp_path / "out"), 7)
    assert spark.read.json(str(tmp_path / "out/traces")).count() == 3 and spark.read.json(str(tmp_path / "out/documents")).count() == 1


def test_whole_fingerprints(spark):
    r = random.Random(4)
    cells = [[r.randrange(9) for _ in range(16 * 17)] for _ in range(30)]
    d = spark.createDataFrame(list(enumerate(cells)), "seq bigint, cells array<int>")
    got = {x.seq: x.phash for x in dedup.wide_prints(d).select("seq", C.hash_digits(F.col("fp")).alias("phash")).collect()}
    for k, c in enumerate(cells):
        bits = "".join("1" if c[row * 17 + col] > c[row * 17 + col + 1] else "0" for row in range(16) for col in range(16))
        assert got[k] == f"{int(bits, 2):064x}"
    back = spark.createDataFrame([(v,) for v in got.values()] + [("12ab",), (None,)], "phash string").select("phash", C.words_of_digits(F.col("phash")).alias("w"))
    assert all((x.w is None) == (len(x.phash or "") != 64) for x in back.collect())
    assert back.where("w IS NOT NULL").select((C.hash_digits(F.col("w")) == F.col("phash")).alias("same")).distinct().first().same


def test_whole_fingerprints_are_linked_and_calibrated(spark):
    r = random.Random(5)
    base = [r.getrandbits(256) for _ in range(12)]
    prints = base + [b ^ sum(1 << x for x in r.sample(range(256), r.randrange(25))) for b in base for _ in range(3)] + base[:4]
    signed = lambda w: w - (1 << 64) if w >> 63 else w
    words = lambda p: [signed(p >> (192 - 64 * k) & (1 << 64) - 1) for k in range(4)]
    d = spark.createDataFrame([(k, words(p), k % 2) for k, p in enumerate(prints)], "seq bigint, fp array<bigint>, label int")
    near = {k: min(((p ^ q).bit_count(), j) for j, q in enumerate(prints[:k])) for k, p in enumerate(prints) if k}
    assert {x.seq: (x.distance, x.duplicate_of) for x in dedup.wide_nearest(d).collect()} == {k: v for k, v in near.items() if v[0] <= 16}
    want = {same: min((p ^ q).bit_count() for k, p in enumerate(prints) for j, q in enumerate(prints[:k]) if (k % 2 == j % 2) == same) for same in (True, False)}
    got = dedup.calibrated(dedup.wide_floor(d)).collect()
    assert {x.same_label: x.floor for x in got} == want and all(x.passes == ((x.floor <= 16) == x.same_label) for x in got)


def test_evaluation_report(spark):
    scores = spark.createDataFrame([("a", "correct", True, False), ("a", "wrong", True, True), ("b", "wrong", False, None), ("b", "missing", None, None), ("h", "correct", True, False), ("h", "wrong", True, True)], "file string, verdict string, low_confidence boolean, disputed boolean")
    runs = spark.createDataFrame([("a", "W-2", "W-2", 1.0, False, False, False), ("b", "K-1", "W-2", 2.0, False, False, False), ("c", "W-9", "W-9", 4.0, True, False, False), ("h", "1098", "1098", 9.0, False, True, True)], "file string, expected_type string, predicted_type string, latency_s double, classify_only boolean, hand boolean, hand_ensemble boolean")
    r = evaluate.report(scores, runs).first()
    assert (r.docs, r.types_correct, r.doc_type_accuracy, r.field_total, r.field_correct, r.field_accuracy) == (4, 3, 0.75, 6, 2, 0.3333)
    assert (r.silent_wrong, r.silent_wrong_flagged, r.flag_coverage, r.errors, r.errors_flagged, r.flag_coverage_all) == (3, 2, 0.6667, 4, 2, 0.5)
    assert (r.classify_only_docs, r.median_latency_s, r.hand_median_latency_s, r.hand_field_accuracy, r.hand_all_flagged) == (1, 3.0, 9.0, 0.5, True)
    assert (r.agreement_precision, r.disputed_correct_rate, r.agreed, r.disputed) == (1.0, 0.0, 1, 1)
    none = evaluate.report(scores.where("file = 'a' AND verdict = 'correct'"), runs.where("file = 'a'")).first()
    assert none.flag_coverage is None and none.hand_all_flagged is None and none.hand_median_latency_s is None and none.agreement_precision is None


def test_previews_percents_and_choices(spark):
    names = spark.createDataFrame([(9 - k, f"c{k}") for k in range(9)], "seq bigint, name string")
    assert reports.preview(names).first().line == "c8, c7, c6, c5, c4, c3 +3 more"
    assert reports.preview(names.where("seq < 3")).first().line == "c8, c7" and reports.preview(names.limit(0)).first().line.startswith("Every row")
    row = spark.range(1).select(reports.percent(F.lit(0.12345)).alias("a"), reports.percent(F.lit(0.005), 0).alias("b"), reports.percent(F.lit(1.0)).alias("c")).first()
    assert tuple(row) == ("12.3%", "1%", "100.0%")
    files = spark.createDataFrame([("b",), ("a",), ("B",), ("é",)], "file string")
    assert [r.file for r in reports.chosen(files, ["b", "é", "a"], 2).collect()] == ["a", "b"]
    assert [r.name for r in reports.by_name(files.withColumnRenamed("file", "name")).collect()] == ["B", "a", "b", "é"]
    assert '"W-2"' in reports.classify_prompt() and "UNRECOGNIZED" in reports.classify_prompt()


def test_growing_files_wait(spark, tmp_path):
    box, ledger, polls = tmp_path / "in", str(tmp_path / "ledger"), str(tmp_path / "polls")
    box.mkdir()
    (box / "a.png").write_bytes(b"whole")
    (box / "b.png").write_bytes(b"part")
    (box / "c.txt").write_bytes(b"other")

    def look(n):
        inbox.poll(spark, str(box), ledger, polls, n)
        return sorted(r.name for r in inbox.ledger_at(spark, ledger).collect())

    assert look(0) == []
    (box / "b.png").write_bytes(b"part and more")
    assert look(1) == ["a.png"] and look(1) == ["a.png"]
    (box / "d.png").write_bytes(b"whole")  # a content that is known
    assert look(2) == ["a.png", "b.png"] and look(3) == ["a.png", "b.png"]
    inbox.compacted(spark, ledger, str(tmp_path / "small"))
    assert sorted(r.name for r in inbox.ledger_at(spark, str(tmp_path / "small")).collect()) == ["a.png", "b.png"]


def test_growing_files_in_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.png").write_bytes(b"x")
    q = inbox.watch_growing(spark, str(tmp_path / "in"), str(tmp_path / "l"), str(tmp_path / "p"), str(tmp_path / "c"), "1 second")
    for _ in range(60):
        time.sleep(0.5)
        if inbox.ledger_at(spark, str(tmp_path / "l")).count():
            break
    q.stop()
    assert [r.name for r in inbox.ledger_at(spark, str(tmp_path / "l")).collect()] == ["a.png"]
