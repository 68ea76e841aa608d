import random

import pytest
from paperloom.operators import dedup


@pytest.mark.parametrize("spread", [3, 63])
def test_floors_and_closest_pairs_are_as_brute_force(spark, spread):
    r = random.Random(spread)
    base = r.getrandbits(63)
    rows = [(k, base ^ sum(1 << b for b in r.sample(range(63), r.randrange(spread + 1))), r.randrange(3)) for k in range(30)]
    if spread == 3:
        rows += [(100 + k, base, 1) for k in range(40)]
    else:  # two far labels: no cross pair is within the threshold
        rows = [(0, 0, 1), (1, (1 << 40) - 1, 2), (2, 3, 1), (3, (1 << 63) - 1, 2)]
    d = spark.createDataFrame(rows, "seq bigint, fp bigint, label int")
    pairs = {True: [], False: []}
    for a, x, la in rows:
        for b, y, lb in rows:
            if b < a:
                pairs[la == lb].append(((x ^ y).bit_count(), a, b))
    got = sorted((not x.same_label, x["rank"], x.distance, x.seq, x.cand) for x in dedup.closest_by_label(d).collect())
    assert got == [(not same, k + 1, *p) for same in (True, False) for k, p in enumerate(sorted(pairs[same])[:6])]
    floors = {x.same_label: (x.floor, x.pairs, x.threshold_below) for x in dedup.floors(d).collect()}
    least = {same: min(pairs[same])[0] for same in pairs}
    assert floors == {True: (least[True], len(pairs[True]), None), False: (least[False], len(pairs[False]), least[False] > 16)}


def test_floors_of_an_empty_table(spark):
    d = spark.createDataFrame([], "seq bigint, fp bigint, label int")
    assert dedup.closest_by_label(d).collect() == [] and {(x.floor, x.pairs) for x in dedup.floors(d).collect()} == {(None, 0)}


def _counted(rows, k):
    import numpy as np

    fp = np.array([x for _, x, _ in rows], np.uint64)
    label = np.array([y for *_, y in rows])
    out = {}
    for same in (True, False):
        best = []
        for i in range(1, len(rows)):
            d = np.bitwise_count(fp[:i] ^ fp[i])
            d = np.where((label[:i] == label[i]) == same, d, 255)
            few = np.argpartition(d, min(k, i - 1))[: k + 1] if i > k else np.arange(i)
            best = sorted(best + [(int(d[j]), i, int(j)) for j in few.tolist() if d[j] < 255] + [(int(d[j]), i, int(j)) for j in np.flatnonzero(d == d[few].max())[:k].tolist() if d[j] < 255])
            best = sorted(set(best))[:k]
        out[same] = best
    return out


def test_few_pairs_are_compared(spark):
    """Groups of forms that share most bits, and forms of their own: under 5 % of all pairs are looked at."""
    r = random.Random(4)
    bases = [r.getrandbits(63) for _ in range(40)]
    rows = []
    for k in range(20_000):
        which = r.randrange(40)
        x = bases[which] if k % 2 else r.getrandbits(63)
        rows.append((k, x ^ sum(1 << b for b in r.sample(range(63), r.randrange(6, 20))) if k % 2 else x, which if k % 2 else r.randrange(40)))
    d = spark.createDataFrame(rows, "seq bigint, fp bigint, label int")
    told = {}
    got = {same: [] for same in (True, False)}
    for x in dedup.closest_by_label(d, 6, told=told).collect():
        got[x.same_label].append((x.distance, x.seq, x.cand))
    assert {same: sorted(v) for same, v in got.items()} == _counted(rows, 6)
    assert all(t["compared"] < 0.05 * len(rows) ** 2 / 2 for t in told.values()), told


def test_wide_floors_far_apart(spark):
    r = random.Random(9)
    low = lambda x: x - (1 << 64) if x >> 63 else x
    base = [r.getrandbits(256) for _ in range(3)]
    rows = [(k, base[k % 3] ^ sum(1 << b for b in r.sample(range(256), 20)), k % 3) for k in range(60)]
    want = {same: min((x ^ y).bit_count() for a, x, la in rows for b, y, lb in rows if b < a and (la == lb) == same) for same in (True, False)}
    d = spark.createDataFrame([(k, [low(x >> (64 * w) & (1 << 64) - 1) for w in range(4)], label) for k, x, label in rows], "seq bigint, fp array<bigint>, label int")
    assert {x.same_label: x.floor for x in dedup.wide_floor(d).collect()} == want and want[False] > 80


@pytest.mark.parametrize("wide", [False, True])
def test_far_prints_are_compared_in_squares(spark, monkeypatch, wide):
    """Random prints, for which rings reach more rows than there are pairs: all pairs, in bounded tasks, ties and null labels too."""
    import numpy as np
    from paperloom.operators import closest

    monkeypatch.setattr(closest, "SIDE", 300)
    monkeypatch.setattr(closest, "TILE", 1 << 14)
    r = np.random.default_rng(3)
    words = r.integers(0, 1 << 64, (1500, 4), np.uint64).view(np.int64)
    labels = [None if x == 0 else x for x in r.integers(0, 4, 1500).tolist()]
    rows = [(k, w if wide else w[0], label) for k, (w, label) in enumerate(zip(words.tolist(), labels, strict=True))]
    d = spark.createDataFrame(rows, f"seq bigint, fp {'array<bigint>' if wide else 'bigint'}, label int")
    some = words.view(np.uint64)[:, : 4 if wide else 1]
    want = []
    for same in (True, False):
        far = np.array([(int(np.bitwise_count(some[a] ^ some[b]).sum()), a, b) for a in range(1500) for b in range(a) if (labels[a] == labels[b]) == same])
        want += [(same, k + 1, *x) for k, x in enumerate(far[np.lexsort(far.T[::-1])[:6]].tolist())]
    told = {}
    assert sorted(((x.same_label, x["rank"], x.seq, x.cand, x.distance) for x in dedup.closest_by_label(d, wide=wide, told=told).collect()), key=lambda x: (not x[0], x[1])) == [(same, k, a, b, n) for same, k, n, a, b in want]
    assert not wide or told[True]["whole"] and told[False]["whole"]


def test_ring_joins_have_tasks_by_their_rows(spark, monkeypatch):
    """Flipped rows are dealt over as many tasks as they are worth, whatever the session's shuffle partitions."""
    from paperloom.operators import closest
    from pyspark.sql import functions as F

    monkeypatch.setattr(closest, "RING_ROWS", 100)
    d = spark.createDataFrame([(k, [k % 16, k // 16]) for k in range(256)], "seq bigint, values array<bigint>")
    met = closest._rings(d, [(0, 4, 1), (1, 4, 1)], F.lit(True), 2048)
    assert met.count() == 16384 and met.rdd.getNumPartitions() >= 21
