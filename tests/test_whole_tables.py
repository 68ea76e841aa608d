from paperloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_look_ups_have_their_whole_tables(spark):
    calls = {(x.conv_id, x.turn, x.text) for x in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    got = QUERIES["trace_responses"](spark, SF).collect()
    assert {(x.doc_id, x.seq, x.response) for x in got} == calls and all(x.head == (x.response and x.response[:240]) for x in got)
    ids = {x.id for x in QUERIES["documents_by_id"](spark, SF).collect()}
    assert len(ids) > 1 and ids >= {x.id for x in QUERIES["document_by_id"](spark, SF).collect()}
