import random

import numpy as np
import xxhash

from paperloom.llm import simhash as S


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    ws = [w for w in low.split(" ") if w]
    shingles = [" ".join(ws[k : k + 3]) for k in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    return [find(x) for x in range(len(prints))]


def test_fingerprints_are_as_plain():
    r = random.Random(3)
    texts = ["", " \t\n", "One", "one TWO", "a b c", "É é x a b c d\x1ce f", "x " * 3000] + [" ".join(r.choices(["a", "bb", "Cc", "ß"], k=r.randrange(600))) for _ in range(30)]
    for t in texts:
        assert S.fingerprint(t.encode()) == plain_fingerprint(t)


def test_links_find_all_within_two_bits(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(60)]
    prints = set(base) | {0, (1 << 64) - 1}
    for x in base[:30]:
        prints |= {x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(4)}
    hot = base[0]
    prints |= {hot ^ (1 << a) ^ (1 << b) for a in range(0, 24) for b in range(24, 40)}
    prints = sorted(prints)
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in prints], "simhash bigint")
    for bucket in (4, 64):
        rows = S.components(S.checkpointed(S.links(df, bucket=bucket))).collect()
        root = {r.node: r.root for r in rows}
        got = {}
        for k, x in enumerate(prints):
            s = int(np.uint64(x).view(np.int64))
            got.setdefault(root.get(s, s), set()).add(k)
        want = {}
        for k, x in enumerate(brute_components(prints)):
            want.setdefault(x, set()).add(k)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_thresholds_cover_the_radius():
    r = np.random.default_rng(1)
    sample = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    for n in (100, 10**6, 10**9):
        for radius in (2, 7):
            plan = S.planned(sample, n, radius)
            assert sum(t + 1 for _, t in plan) == radius + 1
            for _ in range(200):
                flips = r.choice(64, radius, replace=False)
                assert any(sum(f in g for f in flips) <= t for g, t in plan)


def test_linked_documents(spark):
    docs = [(3, "the cat sat on the mat"), (1, "the cat sat on the mat"), (2, None), (9, ""), (9, " \n"), (4, "THE CAT\tSAT ON THE MAT"), (None, "alone here now")]
    rows = S.linked(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert len(rows) == len(docs)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    cat = f"{plain_fingerprint(docs[0][1]):016x}"
    assert {by[k, cat] for k in (1, 3, 4)} == {1}
    assert by[2, "0" * 16] == by[9, "0" * 16] == 2
    assert S.linked(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
