from collections import Counter

import pytest
import xxhash

from paperloom.llm import sharding as H


def plain_fill(shards, size):
    walks = []
    for s in shards:
        first, step = H.preference(s, size)
        walks.append([(first + k * step) % size for k in range(size)])
    taken, owner = set(), {}
    while len(taken) < size:
        for k, walk in enumerate(walks):
            if len(taken) == size:
                break
            slot = next(x for x in walk if x not in taken)
            taken.add(slot)
            owner[slot] = k
    return [owner[x] for x in range(size)]


def test_fill_is_as_the_plain_rule_and_even():
    names = H.shard_names(7)
    got = H.fill(names, 211)
    assert got == plain_fill(names, 211)
    counts = Counter(got)
    assert max(counts.values()) - min(counts.values()) <= 1


def test_few_slots_move_when_a_shard_leaves():
    names = H.shard_names(20)
    before, after = H.fill(names, 10007), H.fill(names[:-1], 10007)
    stayed = sum(a == b for a, b in zip(before, after) if b != 19 and a != 19)
    assert stayed > 0.85 * 10007 * 19 / 20


def test_sizes_are_checked():
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8), (list("abcdefgh"), 7)):
        with pytest.raises(ValueError):
            H.fill(*bad)


def test_place_documents_places_every_row(spark):
    docs = [(k, f"text {k}", "x") for k in range(500)] + [(None, None, "x"), (None, "t", "x"), (3, "again", "x")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, shard string")
    rows = H.place_documents(d, 5, 211).collect()
    assert len(rows) == len(docs)
    assert len({r.shard for r in rows if r.doc_id == 3}) == 1
    table = H.fill(H.shard_names(5), 211)
    assert all(r.shard == H.shard_names(5)[table[r.shard_slot]] for r in rows)
    slots = {r.doc_id: r.shard_slot for r in rows}
    for k in range(500):  # the hash by another library, signed, as Spark's
        h = xxhash.xxh64_intdigest(str(k).encode(), seed=42) if k != 3 else None
        assert h is None or slots[k] == (h - (1 << 64) if h >> 63 else h) % 211
    assert H.place_documents(d.limit(0), 5, 211).collect() == []


def test_columns_of_any_name_pass_through(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", 5, 6, 7, "old"), (None, None, 5, 6, 7, "old")], "doc_id bigint, text string, __slot int, key int, key_ int, Shard string")
    out = H.placed(d, H.document_key(), H.shard_names(3), 211)
    assert out.columns == ["doc_id", "text", "__slot", "key", "key_", "shard_slot", "shard"]
    assert sorted(r["__slot"] for r in out.collect()) == [5, 5]
    H.write_shards(d, str(tmp_path / "x"), 3, 211)
    back = spark.read.parquet(str(tmp_path / "x"))
    assert {*back.columns} == {"doc_id", "text", "__slot", "key", "key_", "shard"} and back.count() == 2
