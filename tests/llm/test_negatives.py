"""Hard negatives against all pairs in integers, intervals against true products, odd rows."""

import math

import numpy as np
import pyarrow as pa

from paperloom.llm import negatives


def plain(rows, every=50):
    """Every anchor with every other row, in Python's integers."""
    use, first = [], (2**63, 0)
    for vec_id, x, label in rows:
        if label is None or not x or any(v is None or not math.isfinite(v) for v in x):
            continue
        use.append((vec_id, [math.floor(256 * v) for v in x], int(math.fmod(label + 1, 10)) if vec_id is not None and vec_id % 7 == 0 else label))
    out, seen = [], []
    for a in use:
        if a[0] is None or a[0] % every or a in seen:
            continue
        seen.append(a)
        found = sorted(((-sum(p * q for p, q in zip(a[1], b[1], strict=True)), b[0] if b[0] is not None else first, b) for b in use if b[0] != a[0] and len(a[1]) == len(b[1])), key=lambda t: (t[0], isinstance(t[1], tuple), t[1] if not isinstance(t[1], tuple) else 0))
        for s, _, b in [t for t in found if t[2][2] == a[2]][:5]:
            near = [t for t in found if t[2][2] != a[2] and 50 * -s <= 100 * -t[0] <= 95 * -s][:3]
            out += [(a[0], b[0], k + 1, t[2][0], -s, -t[0]) for k, t in enumerate(near)]
    return sorted(out, key=repr)


def answer(spark, rows, **more):
    data = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, id int, Score string")
    return sorted(map(tuple, negatives.mined(data, **more).collect()), key=repr)


def test_intervals_hold():
    rng = np.random.default_rng(1)
    for d in (1, 3, 64, 100):
        rows = np.concatenate([rng.integers(-200, 200, (300, d)), np.zeros((2, d), int), np.full((2, d), 77), rng.integers(-(2**30), 2**30, (5, d))])
        asks = np.concatenate([rng.integers(-200, 200, (40, d)), np.zeros((1, d), int), rows[:3]])
        near, off = negatives.Queries(asks).interval(slice(0, len(asks)), negatives.encode(rows))
        true = (asks.astype(object) @ rows.astype(object).T).astype(float)
        assert (np.abs(true - near) <= off).all()
        if d == 64:
            plain_rows = off[:40, :300] / np.outer(np.linalg.norm(asks[:40], axis=1), np.linalg.norm(rows[:300], axis=1))
            assert plain_rows.max() < 0.16


def test_few_rows_are_scored(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = rng.integers(-90, 90, (6000, 64)).astype(np.int32)
    anchors = negatives.Anchors(np.arange(50), np.zeros(50, np.int64), vectors[:50])
    codes = negatives.encode(vectors)
    raw = [vectors.astype("<i4"), np.ascontiguousarray(codes.bits.transpose(2, 0, 1)), np.ascontiguousarray(codes.align.T), codes.rest[:, None]]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(6000)), pa.array(np.arange(6000) % 10), pa.array(np.full(6000, 64, np.int32)), *[pa.array([x.tobytes() for x in p], pa.binary()) for p in raw]], names=list("abcdefg"))
    counted, exact = [], negatives._exact
    monkeypatch.setattr(negatives, "_exact", lambda a, b, x, y: counted.append(len(x)) or exact(a, b, x, y))
    tops = negatives.negatives(iter([batch]), anchors, np.arange(50), np.full(50, 40_000), np.full(50, 10**9), 3)
    assert len(tops.owner) == 150 and sum(counted) < 0.2 * 50 * 6000


def test_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(v) for v in rng.normal(0, 0.125, 20)], int(rng.integers(0, 3))) for i in range(-100, 500)]
    want = plain(rows)
    assert len(want) > 100 and answer(spark, rows) == want
    monkeypatch.setattr(negatives, "GROUP_COMPONENTS", 60)  # several groups of anchors
    monkeypatch.setattr(negatives, "PAIR_ANCHORS", 2)
    assert answer(spark, rows) == want


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    same = [0.5, -0.25, 1.0]
    rows = [(i, same if i % 3 else [0.5, -0.26, 1.0], i % 2) for i in range(0, 210, 5)]
    rows += [(None, same, 0), (None, same, 1), (None, None, 1), (100, same, None), (150, [0.1, None, 2.0], 1), (200, [float("nan"), 0.0, 1.0], 1), (250, [float("inf"), 0.0, 1.0], 0), (300, [], 1), (350, [1.0], 1), (351, [0.9], 0), (352, [0.8], 1)]
    rows += [(400, [0.0, 0.0, 0.0], 1), (401, [-0.5, 0.25, -1.0], 1), (50, same, 0), (50, same, 0), (51, same, 0), (-50, same, -5), (-49, same, -5)]
    rows += [(int(i), [float(v) for v in rng.normal(0, 1, 3)], 3) for i in range(600, 640)]
    want = plain(rows)
    assert want and answer(spark, rows) == want
    assert answer(spark, []) == [] and answer(spark, [(1, [1.0], 2)]) == []
