import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import common as C
from paperloom.llm import winnow as N


def plain(text, gram, window):
    points = [ord(c) + 1 for c in text]
    g = min(gram, len(points))
    if not g:
        return [], []
    hs = []
    for k in range(len(points) - g + 1):
        h = 0
        for c in points[k : k + g]:
            h = (h * int(N.BASE) + c) & 0xFFFFFFFFFFFFFFFF
        hs.append(int(N.mix(np.array([h], np.uint64))[0]) >> 32)
    w, chosen = min(window, len(hs)), []
    for a in range(len(hs) - w + 1):
        best = min(range(a, a + w), key=lambda k: (hs[k], -k))
        if not chosen or chosen[-1] != best:
            chosen.append(best)
    return [hs[k] for k in chosen], chosen


@pytest.mark.parametrize(("gram", "window"), [(20, 24), (5, 4), (1, 1), (7, 9), (3, 16)])
def test_chosen_grams_are_as_plain(gram, window):
    r = random.Random(gram)
    for n in (0, 1, 2, 5, 20, 23, 44, 200):
        text = "".join(r.choices("ab é🎉", k=n))
        hashes, positions = N.winnow(text, gram, window)
        assert (hashes.tolist(), positions.tolist()) == plain(text, gram, window)


def test_shared_passages_share_a_hash():
    r = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz "
    for _ in range(100):
        shared = "".join(r.choices(letters, k=N.GRAM + N.WINDOW - 1))
        a, b = ("".join(r.choices(letters, k=r.randrange(90))) + shared + "".join(r.choices(letters, k=r.randrange(90))) for _ in range(2))
        assert {*N.winnow(a)[0].tolist()} & {*N.winnow(b)[0].tolist()}


@pytest.mark.parametrize("block_docs", [3, 512])
def test_report_is_as_plain(spark, block_docs):
    r = random.Random(6)
    docs = [(k * 3 - 40, "".join(r.choices("abc dé🎉", k=r.choice([0, 1, 3, 7, 300, 2000])))) for k in range(60)] + [(900, None), (901, "x" * 200_000)]
    d = spark.createDataFrame([(*x, 1, "") for x in docs], "doc_id bigint, text string, block int, fingerprint string").repartition(4)
    got = {x.doc_id: x for x in N.fingerprint_report(d, block_docs=block_docs).collect()}
    assert len(got) == len(docs)
    for k, (i, t) in enumerate(docs):
        t, nxt = t or "", docs[(k + 1) % len(docs)][1] or ""
        n = len(t) // 4
        e = t[: len(t) - n] + nxt[:n]
        own, changed, after = (N.winnow(x)[0] for x in (t, e, nxt))
        assert (got[i].n_chars, got[i].edited_sha256, got[i].fingerprint) == (len(t), hashlib.sha256(e.encode()).hexdigest(), N.spelled(own))
        assert got[i].edited_fingerprint == N.spelled(changed) and got[i].positions == N.winnow(t)[1].tolist()

        def like(x, y):
            x, y = {*x.tolist()}, {*y.tolist()}
            return len(x & y) / len(x | y) if x | y else 1.0

        assert (got[i].near_edited, got[i].near_next) == (like(own, changed), like(own, after))


def test_odd_tables(spark):
    kind = "doc_id bigint, text string, key string"
    assert N.fingerprint_report(spark.createDataFrame([], kind)).collect() == []
    one = N.fingerprint_report(spark.createDataFrame([(5, "only one text here", "")], kind)).collect()
    assert one[0].near_next == 1.0
    rows = N.fingerprint_report(spark.createDataFrame([(None, "a", ""), (1, "same text", ""), (1, "other", ""), (2, None, "")], kind)).collect()
    assert sorted(str(x.doc_id) for x in rows) == ["1", "1", "2", "None"]
    d = spark.createDataFrame([(1, "abc", "k"), (None, None, "k")], kind.replace("key", "positions"))
    assert [x.fingerprint == "" for x in N.fingerprints(d).collect()] == [False, True]


def test_blocks_hold_as_many_wherever_ids_lie(spark):
    ids = [-(2**63), 2**63 - 1, 10**15, *range(2000)]
    d = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(None, f"n{k}") for k in range(300)], "doc_id bigint, text string").repartition(5)
    blocks = C.Blocks.of(d, 64)
    numbers = blocks.number(pa.array([*sorted(ids), None, None]), np.array([0] * len(ids) + [0, 2**32 - 1], np.uint32))
    assert numbers[-2:].tolist() == [-64, -1] and (np.diff(numbers[:-2]) >= 0).all()
    assert max(Counter(numbers.tolist()).values()) < 300
    got = N.fingerprint_report(d, block_docs=64).collect()
    assert sorted(x.doc_id for x in got if x.doc_id is not None) == sorted(ids) and len(got) == len(ids) + 300
    at = {x.doc_id: x for x in got}
    assert at[2**63 - 1].edited_fingerprint and at[1999].n_chars == 5
    order = [*range(1995, 2000), 10**15, 2**63 - 1]
    for i, k in zip(order, order[1:]):
        t, n = f"t{i}", len(f"t{i}") // 4
        assert at[i].edited_sha256 == hashlib.sha256((t[: len(t) - n] + f"t{k}"[:n]).encode()).hexdigest()
