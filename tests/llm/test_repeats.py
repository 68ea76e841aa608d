import random

import pytest

from paperloom.llm import repeats as R


def brute(docs, unit, least):
    seen, cuts = {}, {}
    rows = [(i, a, b, u) for i, t in docs if i is not None for a, b, u, n in R.units(t or "", unit, least) if n >= least]
    for i, a, _, u in rows:
        seen[u] = min(seen.get(u, (i, a)), (i, a))
    for i, a, b, u in rows:
        if seen[u] != (i, a):
            cuts.setdefault(i, set()).add((a, b))
    out = []
    for i, t in docs:
        own = {(a, b) for a, b, _, _ in R.units(t or "", unit, least)} & cuts.get(i, set())
        out.append((i, t if t is None else "".join(c for k, c in enumerate(t) if not any(a <= k < b for a, b in own))))
    return out


def texts(seed, n=60):
    r = random.Random(seed)
    pool = ["One two three four five six seven.", "One  TWO three four\tfive six seven. ", "Short.", "Oh no!", "É à ü ö ä ß ç ñ ø å.", "no stop at the end of this line\n", "\n", "\n \n", " ", "what is it? Yes it is so for all of us! "]
    return ["".join(r.choices(pool, k=r.randrange(12))) + (f"own sentence number {k} of this very document." if r.random() < 0.7 else "") for k in range(n)]


@pytest.mark.parametrize("unit", R.UNITS)
def test_units_are_the_whole_text(unit):
    for t in texts(1, 200):
        got = R.units(t, unit)
        assert "".join(t[a:b] for a, b, _, _ in got) == t and all(a < b for a, b, _, _ in got)


@pytest.mark.parametrize("unit", R.UNITS)
def test_removed_is_as_brute_force(spark, unit):
    docs = [(k // 2 if k < 6 else k, t) for k, t in enumerate(texts(2))] + [(200, None), (None, "One two three four five six seven."), (201, ""), (202, "One two three four five six seven. " * 5000)]
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id bigint, text string, at int, removed_spans int").repartition(3)
    rows = R.removed(d, unit, 5).collect()
    assert sorted([(r.doc_id, r.text) for r in rows], key=repr) == sorted(brute(docs, unit, 5), key=repr)
    had = {x[0]: x[1] for x in docs}
    for r in rows:
        if r.doc_id is not None and r.doc_id > 2:
            cut = {k for s in r.removed_spans for k in range(s.start, s.end)}
            assert r.text is None or r.text == "".join(c for k, c in enumerate(had[r.doc_id]) if k not in cut)


def test_passages_and_empty_tables(spark):
    passage = " ".join(f"Word{k} goes with other words{k} in sentence {k}." for k in range(12))
    d = spark.createDataFrame([(2, f"start of two {passage} end", 5), (1, f"begin one. {passage} done", 5), (3, "clean text stays here as it is, all of it.", 7)], "doc_id bigint, text string, n_chars bigint")
    got = {r.doc_id: r for r in R.removed(d).collect()}
    assert passage in got[1].text and got[3].text.startswith("clean") and not got[3].removed_spans
    assert len(got[2].text.split()) < 20 and got[2].n_chars == len(got[2].text)
    assert R.unit_report(d.limit(0)).collect() == []


def brute_all(docs):
    rows = [(u, i, a, b) for i, t in docs for a, b, u in R.all_units(t)]
    first = {}
    for u, i, a, b in rows:
        first[u] = min(first.get(u, (i, a, b)), (i, a, b))
    gone = {i: set() for i, _ in docs}
    for u, i, a, b in rows:
        if i != first[u][0] or a >= first[u][2]:
            gone[i].update(range(a, b))
    return {i: "".join(c for k, c in enumerate(t) if k not in gone[i]) for i, t in docs}


def test_all_units_are_as_brute_force(spark):
    docs = list(enumerate([*texts(3), "Yes. " * 40, "a b c\n" * 5]))
    got = {r.doc_id: r.text for r in R.removed(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()}
    assert got == brute_all(docs)


def left(spark, first, second):
    rows = R.removed(spark.createDataFrame([(1, first), (2, second)], "doc_id bigint, text string")).collect()
    assert next(r.text for r in rows if r.doc_id == 1) == first
    return next(r.text for r in rows if r.doc_id == 2)


def test_short_lines_and_rewrapped_paragraphs(spark):
    assert left(spark, "own one\nall rights reserved.\n", "own two\nAll rights  reserved.\n") == "own two\n"
    lines = "".join(f"w{k} x{k} y{k} z{k} q{k}\n" for k in range(11))
    assert left(spark, f"own one\n{lines}", f"{lines}own two\n") == "own two\n"
    words = " ".join(f"p{k}" for k in range(20))
    assert left(spark, words.replace("p9 ", "p9\n"), "own\n\n" + words.replace("p5 ", "p5\n")) == "own\n\n"


def test_sentences_do_not_depend_on_what_precedes(spark):
    passage = " ".join(f"It was {k}." for k in range(20))
    assert left(spark, f"One own sentence. {passage}", f"Oh. Well then, see. {passage} Bye.") == "Oh. Well then, see. Bye."


def test_passages_without_stops_inside_lines(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    got = left(spark, " ".join(f"a{k}" for k in range(30)) + f" {passage} z", " ".join(f"b{k}" for k in range(40)) + f" {passage} y {passage}")
    assert sum(w.startswith("w") for w in got.split()) < 60 and got.startswith("b0 ") and " y " in got
