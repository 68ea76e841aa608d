"""Toxicity: slots against plain features, the fit against a plain loop, held-out labels, odd rows."""

import math
import re
import zlib

import numpy as np
import pyarrow as pa

from paperloom.llm import toxicity
from paperloom.llm.common import table


def plain_features(text):
    words = re.findall(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+", (text or "").lower())
    found = {("w", w) for w in words}
    for w in words:
        raw = w.encode()
        found |= {(k, raw[:k]) for k in toxicity.STEMS if len(raw) >= k}
    for gap in toxicity.GAPS:
        found |= {("pair", gap, a, b) for a, b in zip(words, words[gap:], strict=False)}
    return found


TEXTS = ["You are a PATHETIC loser.", None, "", "  ...  ", "été Réeuxou", "a b a b a b", "word " * 40_000, "pathetic x losers", "One-two;three\nfour"]


def test_slots_are_the_plain_features(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", 7)
    column = pa.array(TEXTS[:6] + TEXTS[7:])
    got = [set() for _ in column]
    for own, slots in toxicity.slots_of(column):
        for o, s in zip(own.tolist(), slots.tolist(), strict=True):
            got[o].add(s)
    want = [plain_features(x) for x in column.to_pylist()]
    assert [len(x) for x in got] == [len(x) for x in want]
    for a in range(len(got)):
        for b in range(a):
            assert len(got[a] & got[b]) == len(want[a] & want[b])


def test_a_block_border_changes_nothing(monkeypatch):
    column = pa.array(TEXTS)
    whole = {(o, s) for own, slots in toxicity.slots_of(column) for o, s in zip(own.tolist(), slots.tolist(), strict=True)}
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", 1000)
    assert whole == {(o, s) for own, slots in toxicity.slots_of(column) for o, s in zip(own.tolist(), slots.tolist(), strict=True)}


def test_fit_against_a_plain_loop():
    rng = np.random.default_rng(3)
    texts = [np.unique(rng.integers(0, 30, 6)) for _ in range(200)]
    toxic = np.array([float(7 in x) for x in texts])
    weights, intercept = toxicity.fit_ftrl(texts, toxic, 30, alpha=0.5, l1=1.0, passes=2)
    z, n = dict.fromkeys(range(-1, 30), 0.0), dict.fromkeys(range(-1, 30), 0.0)

    def weight(i):
        one, two = (0.0, 0.0) if i < 0 else (1.0, toxicity.L2)
        return 0.0 if abs(z[i]) <= one else (math.copysign(one, z[i]) - z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / 0.5 + two)

    for _ in range(2):
        for x, y in zip(texts, toxic, strict=True):
            own = [-1, *x.tolist()]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in own:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.5 * w[i]
                n[i] += g * g
    assert np.allclose(weights, [weight(i) for i in range(30)]) and math.isclose(intercept, weight(-1))
    assert weights[7] == weights.max() > 0 and (weights == 0).any()


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    got = {r.doc_id: r for r in toxicity.toxicity_report(table(spark, sf, "documents"), labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    pairs = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out]
    hit = sum(p and t for p, t in pairs)
    assert hit >= 0.88 * sum(t for _, t in pairs) and hit >= 0.97 * sum(p for p, _ in pairs)


def test_held_out_labels_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"nice words here {i}" + (" scumbag" if i % 3 == 0 else ""), "x") for i in range(120)], "doc_id long, text string, score string")
    rows = [(i, int(i % 3 == 0)) for i in range(120)]
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in rows]
    a, b = (sorted(map(tuple, toxicity.toxicity_report(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect())) for x in (rows, turned))
    assert a == b and all(r[3] == int(r[0] % 3 == 0) for r in a)


def test_odd_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS), (None, "loser"), (3, "again")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity_report(docs, none).collect()} == {float(toxicity.sigmoid(np.array(-40.0)))}
    labels = spark.createDataFrame([(i, int(i in (0, 7))) for i in range(9)] + [(None, 1), (4, None)], "doc_id long, toxic int")
    rows = toxicity.toxicity_report(docs, labels).collect()
    assert len(rows) == len(TEXTS) + 2 and len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert toxicity.toxicity_report(docs.limit(0), labels).count() == 0
    named = toxicity.scored(docs.withColumnRenamed("doc_id", "Score").withColumn("C0", docs["text"]), toxicity.fit(docs, labels), "score2")
    assert named.columns == ["Score", "text", "C0", "score2"] and named.count() == len(rows)
