import hashlib
import random

import numpy as np
import pytest

from paperloom.llm import suffixes as U


def brute(docs):
    least = {}
    for i, t in docs:
        b = (t or "").encode()
        if i is not None:
            for k in range(len(b) - 49):
                least[b[k : k + 50]] = min(least.get(b[k : k + 50], i), i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        if i is not None:
            for k in range(len(b) - 49):
                if least[b[k : k + 50]] < i:
                    gone[k : k + 50] = [True] * 50
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def cases(seed):
    r = random.Random(seed)
    letters = "abcdeé " if seed == 1 else "ab" if seed == 2 else "abcdefghijklmnopqrstuvwxyz éß🎉"
    pool = ["".join(r.choices(letters, k=r.choice([48, 49, 50, 51, 80, 200, 400]))) for _ in range(12)]
    docs = []
    for k in range(60):
        parts = ["".join(r.choices(letters, k=r.randrange(120))) if r.random() < 0.5 else r.choice(pool)[r.randrange(0, 4) :] for _ in range(r.randrange(6))]
        docs.append((k * 3 - 30, "".join(parts)))
    docs += [(500 + k, docs[k][1]) for k in range(12)] + [(700, None), (701, ""), (None, pool[4]), (None, pool[4]), (3, pool[5]), (3, pool[6] + pool[5]), (3, pool[5]), (800, "Ga " * 3000), (801, "x" + "Ga " * 2000), (802, "z" * 49), (803, "z" * 49)]
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_report_is_as_brute_force(spark, monkeypatch, seed):
    docs = cases(seed)
    if seed == 3:  # many buckets, a few to a range
        monkeypatch.setattr(U, "BUCKET_BYTES", 500)
        monkeypatch.setattr(U, "MOST_RANGES", 5)
    d = spark.createDataFrame([(*x, 1, "") for x in docs], "doc_id bigint, text string, bucket int, spans string").repartition(6)
    got = [tuple(r) for r in U.suffix_report(d).collect()]
    assert sorted(got, key=repr) == sorted(brute(docs), key=repr)


def test_every_window_has_one_anchor():
    r = np.random.default_rng(1)
    for n in (0, 49, 50, 51, 300):
        data = r.integers(0, 3, n).astype(np.uint8)
        at, _, first, last = U.anchors(data)
        covered = [p for a, b in zip(first, last) for p in range(a, b + 1)]
        assert covered == list(range(max(0, n - 49)))
        assert all(a <= p + 0 and p + U.GRAM <= a + 50 and b <= p for p, a, b in zip(at, first, last))


def test_multikey_groups():
    r = np.random.default_rng(2)
    columns = [r.integers(0, 3, 500).astype(np.uint64) for _ in range(3)]
    got, seen = U.multikey_groups(columns), {}
    for k, row in enumerate(zip(*columns)):
        assert seen.setdefault(row, got[k]) == got[k]
    assert len({*seen.values()}) == len(seen)


def test_empty_table(spark):
    assert U.suffix_report(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def settled(docs):
    """The bytes that one bucket with all strings of ``docs`` (id, text) settles as lost."""
    entries = []
    for i, t in docs:
        data = np.frombuffer(t.encode(), np.uint8)
        for p, _, a, b in zip(*U.anchors(data), strict=True):
            entries.append((i, 0, int(a), int(p - a), t.encode()[a : b + 50]))
    ids, _, starts, ends = U._settle([dict(zip(U.STRING_NAMES, U._packed(0, entries, False), strict=True))])
    lost = {i: set() for i, _ in docs}
    for i, a, b in zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True):
        lost[i].update(range(a, b))
    return lost


def test_the_sorted_suffixes_decide(monkeypatch):
    r = random.Random(5)
    base = "".join(r.choices("abcdefgh ", k=300))
    docs = [(k, "".join(r.choices("abcdefgh ", k=r.randrange(40))) + base[(a := r.randrange(150)) : a + r.randrange(50, 150)] + "".join(r.choices("abcdefgh ", k=40))) for k in range(40)]
    want = {i: n for (i, _, n, _, _) in brute(docs)}
    assert {i: len(x) for i, x in settled(docs).items()} == want
    whole = U.multikey_groups
    for broken in (lambda columns: np.zeros(len(columns[0]), np.int64), lambda columns: np.arange(len(columns[0])), lambda columns: whole(columns[:1])):
        monkeypatch.setattr(U, "multikey_groups", broken)
        assert {i: len(x) for i, x in settled(docs).items()} != want
