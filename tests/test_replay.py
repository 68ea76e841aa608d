"""The log replayed against one change after another; carries against plain loops; nothing lies in one task."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions import tables as V
from paperloom.operators import carry, dedup, mutations, replay
from paperloom.streaming import inbox


def one_by_one(docs, log, lists):
    docs = {d[0]: dict(zip(("id", "status", "doc_type", "client_id", "duplicate_of"), d, strict=True)) for d in docs}
    lists = {k: list(v) for k, v in lists}
    results, events = [], []

    def uncheck(client, kind):
        if client in lists and kind and kind != V.UNRECOGNIZED and not any(d["client_id"] == client and d["doc_type"] == kind and d["status"] == "confirmed" for d in docs.values()):
            lists[client] = [t for t in lists[client] if t != kind]

    for seq, doc_id, action, kind, client in sorted(log):
        doc = docs.get(doc_id)
        if doc is None:
            results.append((seq, doc_id, action, "missing"))
            continue
        if action not in replay.ACTIONS:
            results.append((seq, doc_id, action, "bad"))
        elif action == "confirm":
            manual = bool(kind) and kind != doc["doc_type"]
            doc["doc_type"] = kind or doc["doc_type"]
            doc["client_id"] = doc["client_id"] if client is None else client
            doc["status"] = "confirmed"
            if doc["client_id"] in lists and doc["doc_type"] and doc["doc_type"] != V.UNRECOGNIZED and doc["doc_type"] not in lists[doc["client_id"]]:
                lists[doc["client_id"]].append(doc["doc_type"])
            results.append((seq, doc_id, action, "done"))
            events.append((seq, "confirmed", doc_id, doc["doc_type"], manual))
        elif action == "reopen":
            if doc["status"] != "confirmed":
                results.append((seq, doc_id, action, "conflict"))
                continue
            doc["status"] = "extracted"
            uncheck(doc["client_id"], doc["doc_type"])
            results.append((seq, doc_id, action, "done"))
            events.append((seq, "unconfirmed", doc_id, doc["doc_type"], None))
        elif action == "discard":
            del docs[doc_id]
            for other in docs.values():
                if other["duplicate_of"] == doc_id:
                    other["duplicate_of"] = None
            if doc["status"] == "confirmed":
                uncheck(doc["client_id"], doc["doc_type"])
            results.append((seq, doc_id, action, "done"))
            events.append((seq, "deleted", doc_id, doc["doc_type"], None))
        elif doc["duplicate_of"] is None:
            results.append((seq, doc_id, action, "nothing"))
        else:
            doc["duplicate_of"] = None
            results.append((seq, doc_id, action, "done"))
            events.append((seq, "dup_resolved", doc_id, None, None))
    return results, events, sorted(map(tuple, (d.values() for d in docs.values()))), sorted((k, v) for k, v in lists.items())


@pytest.mark.parametrize("seed", range(2, 4))
def test_replay_is_as_one_by_one(spark, seed):
    r = random.Random(seed)
    types = ["W-2", "K-1", V.UNRECOGNIZED, "", None]
    docs = [(k, r.choice(["pending", "extracted", "confirmed"]), r.choice(types), r.choice([0, 1, 2, None, 77]), r.choice([None, (k + 3) % 12, 99])) for k in range(12)]
    log = [(7 * n, r.choice([*range(14), 3, 3, 3, 3, 3, 3, 3, 3]), r.choices(["confirm", "reopen", "discard", "resolve", "other"], [8, 6, 0.4, 2, 1])[0], r.choice(types), r.choice([0, 1, None])) for n in range(160)]
    lists = [(0, ["W-2", "X"]), (1, []), (2, ["K-1"])]
    made = replay.replay(
        spark.createDataFrame(docs, "id bigint, status string, doc_type string, client_id bigint, duplicate_of bigint"),
        spark.createDataFrame(log, "seq bigint, doc_id bigint, action string, doc_type string, client_id bigint").repartition(3), blocks=5)
    results, events, left, got = one_by_one(docs, log, lists)
    assert sorted(map(tuple, made.results().collect())) == results
    assert sorted(map(tuple, made.events().collect())) == events
    assert sorted(map(tuple, made.documents().collect()), key=repr) == sorted(left, key=repr)
    assert sorted((x.id, x.received_docs) for x in made.received(spark.createDataFrame(lists, "id bigint, received_docs array<string>")).collect()) == got
    assert made.accepted(spark.createDataFrame([(s, "k") for s, *_ in log], "seq bigint, key string")).count() == sum(a == "confirm" and o == "done" for _, _, a, o in results)


def test_replay_of_nothing(spark):
    docs = spark.createDataFrame([(1, "confirmed", "W-2", 5, None)], "id bigint, status string, doc_type string, client_id bigint, duplicate_of bigint")
    none = spark.createDataFrame([], "seq bigint, doc_id bigint, action string, doc_type string, client_id bigint")
    lists = spark.createDataFrame([(5, ["W-2"])], "id bigint, received_docs array<string>")
    made = replay.replay(docs, none)
    assert made.results().count() == 0 and [tuple(x) for x in made.documents().collect()] == [(1, "confirmed", "W-2", 5, None)]
    assert made.received(lists).first().received_docs == ["W-2"]
    assert replay.replay(docs.limit(0), none).documents().count() == 0


@pytest.mark.parametrize("blocks", [1, 4, 9])
def test_carries_are_as_plain_loops(spark, blocks):
    r = random.Random(blocks)
    rows = [(r.choice(["a", "a", "a", None, "b"]), n * 3, r.choice([None, None, n])) for n in range(200)]
    df = spark.createDataFrame(rows, "k string, at bigint, v bigint").repartition(3)
    last, total, want, sums = {}, {}, [], []
    for k, at, v in rows:
        want.append((k, at, v, last.get(k)))
        last[k] = last.get(k) if v is None else v
        total[k] = total.get(k, 0) + (v or 0)
        sums.append((k, at, v, total[k]))
    key = repr
    assert sorted(map(tuple, carry.last_before(df, ["k"], "at", {"was": F.col("v")}, blocks).collect()), key=key) == sorted(want, key=key)
    assert sorted(map(tuple, carry.running_sum(df, ["k"], "at", F.coalesce("v", F.lit(0)), "total", blocks).collect()), key=key) == sorted(sums, key=key)


def test_one_key_is_spread_over_the_blocks(spark):
    rows = spark.range(4000).select(F.lit("a").alias("k"), F.col("id").alias("at"))
    cut = rows.withColumn("b", carry.block_of(F.col("at"), carry._bounds(rows, "at", 8)))
    sizes = [x["count"] for x in cut.groupBy("b").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 700


def test_one_content_and_one_name(spark):
    docs = spark.range(3000).select(F.col("id").alias("seq"), F.lit("same").alias("content"))
    got = sorted((x.seq, x.duplicate_of) for x in dedup.exact_duplicates(docs, 6).collect())
    assert got == [(k, k - 1 if k else None) for k in range(3000)]
    looks = spark.range(500).select(F.col("id").alias("poll"), F.lit("f").alias("name"), F.floor(F.col("id") / 100).alias("size"), F.lit(0).alias("mtime"))
    assert sum(x.stable for x in inbox.stable(looks, 5).collect()) == 495


def minted(names, taken):
    """One by one, the search going on where the base's last one ended."""
    import re

    used, after, out = set(taken), {}, []
    for seq, name in sorted(names):
        base = "client_" + (re.sub("[^a-z0-9]+", "_", name.lower()).strip("_") or "client")
        got, k = base, after.get(base, 2)
        while got in used:
            got, k = f"{base}_{k}", k + 1
        after[base] = k
        used.add(got)
        out.append((seq, got))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_minted_ids_with_rivals(spark, seed):
    r = random.Random(seed)
    words = ["Ann"] * 6 + [f"Ann {k}" for k in range(1, 14)] + ["Ann 2 2", "Ann 2 3", "Ann 3 2", "Ann 02", "Bob", "Bob 2", "", "client 2"]
    names = [(3 * k, r.choice(words)) for k in range(150)]
    taken = r.sample([f"client_ann_{k}" for k in range(2, 30)] + ["client_ann", "client_ann_2_2", "client_ann_2_3", "client_bob_2", "client_client", "other"], 12)
    got = mutations.mint_client_ids(spark.createDataFrame(names, "seq bigint, name string").repartition(3), spark.createDataFrame([(x,) for x in taken], "id string"), blocks=[None, 4][seed])
    assert sorted(map(tuple, got.collect())) == minted(names, taken)


def test_many_names_of_one_stem(spark):
    rows = spark.range(100_000).select(F.col("id").alias("seq"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("Ann "), (F.col("id") / 7).cast("int").cast("string"))).otherwise("Ann").alias("name"))
    taken = spark.range(5000).select(F.concat(F.lit("client_ann_"), (F.col("id") * 3 + 2).cast("string")).alias("id"))
    got = sorted(map(tuple, mutations.mint_client_ids(rows, taken, blocks=6).collect()))
    assert got == minted([tuple(x) for x in rows.collect()], [x.id for x in taken.collect()])


def test_documents_without_a_flag_are_dealt_out(spark):
    """Most documents have no flag: they don't meet in one task on the way to the flags' targets."""
    from pyspark.sql import functions as F

    n = 4000
    docs = spark.range(n).select("id", F.lit("extracted").alias("status"), F.lit("w2").alias("doc_type"), F.lit(1).cast("bigint").alias("client_id"), F.when(F.col("id") % 100 == 0, F.col("id") + 1).alias("duplicate_of"))
    log = spark.range(n).select("id", F.when(F.col("id") < n - 10, F.col("id")).otherwise(-F.col("id")).alias("doc_id")).select(F.col("id").alias("seq"), "doc_id", F.when(F.col("id") % 2 == 1, "discard").otherwise("confirm").alias("action"), F.lit(None).cast("string").alias("doc_type"), F.lit(None).cast("bigint").alias("client_id"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(old, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        targets = docs.where("id % 7 = 0").select(F.col("id").alias("target"))
        met = carry.left_spread(docs, targets, "duplicate_of", "target", "id")
        sizes = met.groupBy(F.spark_partition_id()).count().toPandas()["count"]
        assert met.count() == n and sizes.max() < n / 2
        assert met.where("target IS NOT NULL").count() == len([k for k in range(0, n, 100) if (k + 1) % 7 == 0])
        left = {r.id: r.duplicate_of for r in replay.replay(docs, log).documents().collect()}
        want = {k: None if k % 100 or k + 1 < n - 10 else k + 1 for k in range(n) if k % 2 == 0 or k >= n - 10}
        assert left == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def most_read(spark, df, least):
    """Rows that the largest task reads, over all rows, in the stages that read ``least`` rows or more; the worst stage."""
    sc, group = spark.sparkContext, f"read {id(df)}"
    sc.setJobGroup(group, group)
    df.write.format("noop").mode("overwrite").save()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    sc.setLocalProperty("spark.jobGroup.id", None)
    store, worst = sc._jsc.sc().statusStore(), 0
    for stage in {s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds}:
        tasks = store.taskList(stage, 0, 1000)
        rows = [tasks.apply(k).taskMetrics().get().shuffleReadMetrics().recordsRead() for k in range(tasks.size())]
        if sum(rows) >= least:
            worst = max(worst, max(rows) / sum(rows))
    return worst


@pytest.fixture
def dealt(spark):
    """A replay of 8,000 changes over 4,000 documents, one in a hundred with a flag, in 8 tasks that nothing joins or cuts up."""
    n = 4000
    docs = spark.range(n).select("id", F.lit("extracted").alias("status"), F.lit("w2").alias("doc_type"), (F.col("id") % 50).alias("client_id"), F.when(F.col("id") % 100 == 0, F.col("id") + 1).alias("duplicate_of"))
    log = spark.range(2 * n).select(F.col("id").alias("seq"), (F.col("id") % n).alias("doc_id"), F.when(F.col("id") < n, "confirm").when(F.col("id") % 4 == 1, "discard").otherwise("reopen").alias("action"), F.lit(None).cast("string").alias("doc_type"), F.lit(None).cast("bigint").alias("client_id"))
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield docs, log
    for k, v in old.items():
        spark.conf.set(k, v)


def test_no_task_reads_most_of_the_documents(spark, dealt):
    docs, log = dealt
    made = replay.replay(docs, log, blocks=3).documents()
    assert most_read(spark, made, 3000) < 0.4
    assert {x.id: x.duplicate_of for x in made.collect()} == {k: None for k in range(4000) if k % 4 != 1}
    assert made._jdf.queryExecution().executedPlan().toString().count("Window [") == 2  # rows and heads of one replay


def test_no_task_reads_most_of_the_moves(spark, dealt):
    docs, log = dealt
    lists = spark.range(50).select("id", F.array(F.lit("w2")).alias("received_docs"))
    made = replay.replay(docs, log, blocks=3).received(lists)
    assert most_read(spark, made, 3000) < 0.4
    assert {x.id: x.received_docs for x in made.collect()} == {k: [] for k in range(50)}
