import hashlib
import random
import re

import pytest

from paperloom.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items):
    def ws(t):
        return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    out = []
    for doc_id, text in docs:
        dw, hit, names = ws(text), set(), set()
        for name, it in items:
            iw = ws(it)
            n = min(10, len(iw))
            for a in range(len(iw) - n + 1 if n else 0):
                for b in range(len(dw) - n + 1):
                    if iw[a : a + n] == dw[b : b + n]:
                        hit |= {*range(b, b + n)}
                        if name is not None:
                            names.add(str(name))
        out.append((doc_id, len(dw), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


def cases(seed):
    r = random.Random(seed)
    vocabulary = ["a", "b", "C", "dé", "E9"]
    items = [(k, " ".join(r.choices(vocabulary, k=r.choice([0, 1, 4, 9, 10, 13, 30])))) for k in range(12)] + [(50, None), (None, "q1 q2 q3"), (51, "  ,;")]
    if seed % 2:
        items = [(k, t) for k, t in items if not t or len(t.split()) > 3]
    docs = [(k, r.choice([" ", ", ", "\n"]).join(r.choices(vocabulary + ["zz"], k=r.choice([0, 1, 5, 40, 200])))) for k in range(40)]
    docs += [(100, None), (101, ""), (102, "x " * 30000 + str(items[5][1])), (102, "x"), (103, "q1-q2 Q3"), (None, "q1 q2 q3")]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block", [512 << 10, 60])
def test_report_is_as_brute_force(spark, seed, block):
    docs, items = cases(seed)
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    got = [tuple(r) for r in D.report(d, i, block_bytes=block).collect()]
    assert sorted(got, key=repr) == sorted(brute(docs, items), key=repr)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    i = spark.createDataFrame([], "item_id bigint, text string")
    assert D.report(d, i).collect() == []
    d = spark.createDataFrame([(1, "one two")], "doc_id bigint, text string")
    assert D.report(d, i).first().n_words == 2


def test_cleaned_cuts_spans_and_drops_covered(spark):
    item = " ".join(f"w{k}" for k in range(12))
    docs = [(1, f"head {' '.join(['own'] * 30)} {item.upper()} tail", 1), (2, item, 2), (3, None, None), (4, "clean", 5), (1, "clean", 5)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, items int")
    i = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    got = sorted((tuple(r) for r in D.cleaned(d, i).collect()), key=repr)
    assert got == sorted([(1, f"head {' '.join(['own'] * 30)} tail", 1), (3, None, None), (4, "clean", 5), (1, "clean", 5)], key=repr)
