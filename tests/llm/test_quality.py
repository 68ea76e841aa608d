import math
import re

import numpy as np
import xxhash

from paperloom.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_fit_finds_ordered_grades():
    r = np.random.default_rng(3)
    n = 900
    x = r.normal(size=(n, 3))
    grades = np.digitize(x @ [2.0, -1.0, 0.0] + r.logistic(size=n) * 0.3, [-1.0, 1.0])
    rows, features = np.repeat(np.arange(n), 3), np.tile([5, 9, 700], n)
    m = Q.fit_ordinal(rows, features, x.ravel(), grades, penalty=1e-6, steps=200)
    assert (np.diff(m.thresholds) > 0).all() and abs(m.weights[5] / m.weights[9] + 2) < 0.4
    p = m.probabilities(x @ [m.weights[5], m.weights[9], m.weights[700]])
    assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == grades).mean() > 0.8


def plain_loss(x, rows, features, values, grades, k, penalty):
    """Penalised negative log likelihood, row by row: x holds the weights and the thresholds."""
    total = penalty / 2 * float(x[:k] @ x[:k])
    for i, g in enumerate(grades):
        score = sum(v * x[f] for r, f, v in zip(rows, features, values) if r == i)
        below = [0.0, *(1 / (1 + math.exp(-(c - score))) for c in x[k:]), 1.0]
        total -= math.log(below[g + 1] - below[g]) / len(grades)
    return total


def test_fit_is_at_the_least_of_the_plain_loss():
    r = np.random.default_rng(4)
    n, k = 60, 4
    rows, features = np.repeat(np.arange(n), 3), r.integers(0, k, 3 * n)
    values = r.normal(size=3 * n)
    score = np.bincount(rows, values * np.array([1.0, -2.0, 0.5, 0.0])[features], n)
    grades = np.digitize(score + r.logistic(size=n), [-0.7, 0.9])
    m = Q.fit_ordinal(rows, features, values, grades, size=k, penalty=0.02, steps=500)
    x = np.concatenate([m.weights.astype(float), m.thresholds])
    held = (rows.tolist(), features.tolist(), values.tolist(), grades.tolist(), k, 0.02)
    least = plain_loss(x, *held)
    for j in range(len(x)):  # the slope in each direction is nought
        step = np.zeros(len(x))
        step[j] = 1e-3
        up, down = plain_loss(x + step, *held), plain_loss(x - step, *held)
        assert abs(up - down) / 2e-3 < 2e-3 and up > least - 1e-7 and down > least - 1e-7
    assert least < plain_loss(np.concatenate([np.zeros(k), m.thresholds]), *held)


def test_report_is_as_plain_scoring(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = Q.fit(docs, labels)
    got = {r.doc_id: r for r in Q.quality_report(docs, labels).collect()}
    for d in docs.collect():
        ws = re.split(r"[ \t\n\r\x0b\x0c]+", d.text or "")
        ws = [w for w in ws if w]
        total = 0.0
        for k, w in enumerate(ws):
            core = w.lower().strip(".,;:!?\"'()[]*#$%&|")
            shape, last = "", None
            for c in w:
                c = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c
                shape += "" if c == last else c
                last = c
            named = ["w" + core, "p" + core[:4], "q" + core[:5], "s" + shape] + (["repeat"] if k and w == ws[k - 1] else [])
            total += sum(float(model.weights[xxhash.xxh64_intdigest(x.encode()) % Q.SIZE]) for x in named)
        score = 2.0 * total / math.sqrt(max(1, len(ws)))
        below = [0.0, *(1 / (1 + math.exp(-min(40, max(-40, c - score)))) for c in model.thresholds), 1.0]
        p = [y - x for x, y in zip(below, below[1:])]
        r = got[d.doc_id]
        assert abs(r.expected_grade - sum(g * x for g, x in enumerate(p))) < 1e-6 and abs(r.tail_probability - p[2]) < 1e-6
        assert r.keep == (r.tail_probability >= 0.5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fit_on = labels.where("doc_id % 10 < 7")
    rest = labels.where("doc_id % 10 >= 7").withColumnRenamed("doc_id", "label_id")
    rows = Q.scored(docs, Q.fit(docs, fit_on)).join(rest, Q.F.col("doc_id") == Q.F.col("label_id")).select("quality", "toxic", "tail_probability").collect()

    def share(keep):
        some = [r.tail_probability >= 0.5 for r in rows if keep(r)]
        return sum(some) / len(some)

    assert share(lambda r: r.quality == 1 and not r.toxic) > 0.97
    assert share(lambda r: r.toxic) < 0.1
    assert share(lambda r: r.quality == 0 and not r.toxic) < 0.4


def test_odd_tables(spark):
    kind = "doc_id bigint, text string, expected_grade string, tail_probability int"
    docs = spark.createDataFrame([(1, "good text", "x", 1), (1, "good text", "x", 1), (None, None, None, None), (2, "", "x", 1), (3, "bad " * 30000, "x", 1)], kind)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert len(Q.kept(docs, none).collect()) == 5
    assert Q.kept(docs, none).columns == docs.columns
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, None), (3, 1, 1), (None, 1, 1), (2, None, 1)], none.schema)
    rows = Q.quality_report(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in rows)
    assert Q.quality_report(docs.limit(0), labels).collect() == []
