"""Examples of the reference behaviour on small tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions import fields as C
from paperloom.functions import tables as V
from paperloom.operators import checklist, dedup, extraction, mutations
from paperloom.sources import readers
from paperloom.streaming import inbox


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_label_phrases_and_echoes(spark):
    assert len(C.label_phrases()) == 34
    for value, want in [("co", True), ("A", True), ("State", True), ("Copperline Bank", False), ("Jane Doe", False), ("68,420.15", False), ("", True), ("EMPLOYER'S NAME", True)]:
        assert one(spark, C.looks_like_label(F.lit(value))) is want, value


def test_scores(spark):
    cases = [("100.00", "$100", "correct"), ("100.00", "100.005", "correct"), ("100.00", "101", "wrong"), ("Jane Doe", "JANE  DOE.", "correct"), ("Jane Doe", "", "missing"), ("Jane Doe", None, "missing"), ("-5", "5", "correct"), ("Straße", "STRASSE", "correct")]
    for a, b, want in cases:
        assert one(spark, C.score_field(F.lit(a), F.lit(b).cast("string"))) == want, (a, b)


def test_parse_json(spark):
    for text, ok in [('{"a": 1}', True), ('x {"a": {"b": 2}} y', True), ("```\n{\"a\": 1}\n```", True), ("{", False), ("} {", False), ("[1]", False), (None, False), ('{"a": }', False)]:
        got = one(spark, C.parse_json(F.lit(text).cast("string")))
        assert (got is not None) is ok, text


def test_missing_keeps_order_and_repeats(spark):
    a = F.array(*map(F.lit, ["a", "b", "a", "c"]))
    assert one(spark, checklist.missing(a, F.array(F.lit("b")))) == ["a", "a", "c"]


def mint(names, taken):
    import re

    used, out = set(taken), []
    for n in names:
        base = "client_" + (re.sub("[^a-z0-9]+", "_", n.lower()).strip("_") or "client")
        got, k = base, 2
        while got in used:
            got, k = f"{base}_{k}", k + 1
        used.add(got)
        out.append(got)
    return out


def test_minted_ids_are_as_one_by_one(spark):
    r = random.Random(1)
    names = [r.choice(["Ann", "ann 2", "ANN!", "Ann 2 2", "Bob", "", "bob 3", "é"]) for _ in range(60)]
    taken = ["client_ann", "client_ann_3", "client_bob_2"]
    rows = mutations.mint_client_ids(spark.createDataFrame(list(enumerate(names)), "seq bigint, name string"), spark.createDataFrame([(t,) for t in taken], "id string")).collect()
    assert [x.client_id for x in sorted(rows, key=lambda x: x.seq)] == mint(names, taken)


def fold(fields, confirms):
    state = {k: dict(zip(("value", "corrected", "original", "low"), v, strict=True)) for k, v in fields.items()}
    for doc, key, new in confirms:
        new = new or ""
        cur = state.get((doc, key), {"value": "", "corrected": False, "original": None, "low": False})
        if new != cur["value"]:
            cur = {"value": new, "corrected": True, "original": cur["original"] if cur["corrected"] else cur["value"], "low": False}
        state[doc, key] = cur
    return {k: (v["value"], v["corrected"], v["original"], v["low"]) for k, v in state.items()}


def test_confirms_fold_as_one_by_one(spark):
    r = random.Random(2)
    fields = {(d, k): (r.choice("abc"), r.random() < 0.3, None, r.random() < 0.5) for d in range(12) for k in "xyz"}
    fields = {k: (v, c, "orig" if c else None, low) for k, (v, c, _, low) in fields.items()}
    confirms = [(r.randrange(12), r.choice("xyzw"), r.choice(["a", "b", "c", "", None])) for _ in range(150)]
    f = spark.createDataFrame([(d, k, *v) for (d, k), v in fields.items()], mutations.FIELD)
    c = spark.createDataFrame([(n, d, k, v) for n, (d, k, v) in enumerate(confirms)], "seq bigint, doc_id bigint, key string, value string")
    got = {(x.doc_id, x.key): (x.value, x.corrected, x.original_value, x.low_confidence) for x in mutations.confirm_fields(f, c).collect()}
    assert got == fold(fields, confirms)


def test_bands_find_all_pairs(spark):
    r = random.Random(3)
    base = [r.getrandbits(63) for _ in range(20)]
    prints = base + [b ^ sum(1 << x for x in r.sample(range(63), r.randrange(20))) for b in base for _ in range(3)]
    d = spark.createDataFrame([(k, p) for k, p in enumerate(prints)], "seq bigint, fp bigint")
    got = {(x.seq, x.cand): x.distance for x in dedup.candidate_pairs(d).collect()}
    want = {(a, b): (x ^ y).bit_count() for a, x in enumerate(prints) for b, y in enumerate(prints[:a]) if (x ^ y).bit_count() <= 16}
    assert got == want


def test_banded_plan_is_an_equi_join(spark):
    d = spark.createDataFrame([(1, 2)], "seq bigint, fp bigint")
    plan = dedup.candidate_pairs(d)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pipeline_with_a_model_function(spark):
    docs = spark.createDataFrame([(1, "p1", "W-2 please"), (2, "p2", "noise")], "id bigint, image string, prompt string")
    asked = extraction.ask(docs, lambda image, prompt: '{"doc_type": "W-2"}' if "W-2" in prompt else "??", "image", "prompt", "raw1").withColumn("raw2", F.lit(None).cast("string"))
    got = {r.id: (r.doc_type, r.retried) for r in extraction.classified(asked).collect()}
    assert got == {1: ("W-2", False), 2: ("UNRECOGNIZED", True)}


def test_low_confidence_rules(spark):
    rows = [(1, "W-2", 3, "box1_wages", "1,000", False), (1, "W-2", 4, "box2_fed_withheld", "1,500", False), (1, "W-2", 0, "employee_name", "Jane Doe", False), (2, "1098", 2, "box1_mortgage_interest", "0", False), (2, "1098", 0, "lender", "lender", False), (3, "K-1", 0, "partner_name", "Al Bo", True)]
    got = extraction.flags(spark.createDataFrame(rows, "id bigint, doc_type string, pos int, key string, value string, retried boolean")).collect()
    assert {(r.id, r.key): r.low_confidence for r in got} == {(1, "box1_wages"): False, (1, "box2_fed_withheld"): True, (1, "employee_name"): False, (2, "box1_mortgage_interest"): True, (2, "lender"): True, (3, "partner_name"): True}


def test_state_events_traces(spark, tmp_path):
    state = {"documents": {"doc_002": {"id": "doc_002", "status": "pending", "fields": {"z": {"value": "1"}, "a": {"value": "2", "corrected": True, "original_value": "0"}}}, "doc_001": {"id": "doc_001", "status": "confirmed", "source": "folder"}}, "clients": {"client_a": {"id": "client_a", "name": "A", "expected_docs": ["W-2"]}}, "seq_doc": 2}
    (tmp_path / "state.json").write_text(json.dumps(state))
    docs, clients = readers.read_state(spark, str(tmp_path / "state.json"))
    rows = docs.orderBy("seq").collect()
    assert [r.id for r in rows] == ["doc_002", "doc_001"] and [f.key for f in rows[0].fields] == ["z", "a"] and [r.source for r in rows] == ["upload", "folder"]
    assert clients.first().received_docs == [] and readers.pending(docs).first().id == "doc_002"
    (tmp_path / "events.jsonl").write_text('{"ts": "2024-01-01T00:00:00Z", "type": "confirmed", "fields_corrected": 2}\n\nbroken {\n{"ts": "bad", "type": "other"}\n')
    found = readers.read_events(spark, str(tmp_path / "events.jsonl")).collect()
    assert sorted((r.type, r.at is None) for r in found) == [("confirmed", False), ("other", True)]
    (tmp_path / "raws").mkdir()
    (tmp_path / "raws/doc_1.json").write_text('{"doc_id": "doc_1", "ts": "2024", "calls": [{"seq": 1, "prompt": "p"}]}')
    assert readers.read_traces(spark, str(tmp_path / "raws")).first().calls[0].prompt == "p"


def test_client_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Client Name,docs\r\n"Doe, Jane","W-2; K-1|"\r\n\r\n"Line\nbreak ""q""",\nBob\n', newline="")
    rows = readers.with_template(readers.read_client_csv(spark, str(tmp_path / "c.csv"))).orderBy("seq").collect()
    assert [(r.name, r.blank) for r in rows] == [("Doe, Jane", False), ("", True), ('Line\nbreak "q"', False), ("Bob", False)]
    assert rows[0].expected_docs == ["W-2", "K-1"] and rows[3].expected_docs == V.ORGANIZER_TEMPLATE


def test_written_csv_and_labels(spark, tmp_path):
    d = spark.createDataFrame([("a", 'x "y", z', None, "")], "k string, v string, n string, e string").coalesce(1)
    readers.write_csv(d, str(tmp_path / "out"))
    held = next((tmp_path / "out").glob("part-*")).read_bytes()
    assert held == b'k,v,n,e\r\na,"x ""y"", z",,\r\n'
    old = spark.createDataFrame([("f1", 1), ("f2", 2)], "file string, n int")
    new = spark.createDataFrame([("f2", 3)], "file string, n int")
    assert sorted(map(tuple, readers.merge_labels(old, new).collect())) == [("f1", 1), ("f2", 3)]
    assert readers.synthetic_forms(spark, 5, 1).collect() == readers.synthetic_forms(spark, 5, 1).collect()


def test_watched_folder_takes_each_content_once(spark, tmp_path):
    box, ledger, mark = tmp_path / "in", str(tmp_path / "ledger"), str(tmp_path / "mark")
    box.mkdir()
    for name, content in (("b.PNG", b"same"), ("a.png", b"same"), ("c.txt", b"text"), ("d.jpg", b"other"), (".e.png", b"hidden")):
        (box / name).write_bytes(content)

    def run():
        inbox.watch(spark, str(box), ledger, mark).awaitTermination()
        return sorted(r.name for r in spark.read.parquet(ledger).collect())

    assert run() == ["a.png", "d.jpg"]
    (box / "f.png").write_bytes(b"other")
    (box / "g.png").write_bytes(b"new")
    assert run() == ["a.png", "d.jpg", "g.png"]
    assert run() == ["a.png", "d.jpg", "g.png"]


def test_live_hours_as_batch(spark, tmp_path):
    rows = [("2024-01-01 10:05:00", "extracted", 0), ("2024-01-01 10:55:00", "confirmed", 3), ("2024-01-01 11:00:00", "unrecognized", 0)]
    d = spark.createDataFrame(rows, "t string, type string, fields_corrected bigint").select(F.to_timestamp("t").alias("ts"), "type", "fields_corrected")
    d.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "ev"))
    q = inbox.live_hours(stream).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.hour.hour, r.docs, r.corrections) for r in spark.table("hours").collect()) == [(10, 1, 3), (11, 1, 0)]


def test_filters_reach_the_scan(spark):
    from paperloom.plans.queries import QUERIES

    plan = QUERIES["review_queue"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan
    plan = QUERIES["document_by_id"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,7)" in plan


@pytest.mark.parametrize("name", ["timeline_hourly"])
def test_entry(spark, name):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 24 and name in e.queries() and name in e.oracle_sql()
