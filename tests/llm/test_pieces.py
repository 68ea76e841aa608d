import random

import numpy as np
import public_tokenizers
import sentencepiece

from paperloom.llm import pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = P.model_at(PATH)


def texts(n, seed=1):
    r = random.Random(seed)
    odd = ["", " ", "   ", "\n", "don't", "é", "日本語", "x y", "🎉", "internationalisation", "a" * 40, " " * 21, "123,456", "\t", "ﷺ", "the", "thing"]
    return ["".join(r.choices(odd, k=r.randrange(30))) if k % 2 else " ".join(r.choices(odd, k=r.randrange(30))) for k in range(n)]


def encoded(found, dropout, seed=17, ids=None):
    held = [x.encode() for x in found]
    at = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64)
    import pyarrow as pa

    keys = P.doc_keys(pa.array(ids or list(range(len(found)))), seed)
    out, offsets = P.encode_chunk(MODEL, np.frombuffer(b"".join(held), np.uint8), at, keys, P.threshold(dropout))
    data, cuts = P.decode_chunk(MODEL, out, offsets)
    return [out[a:b].tolist() for a, b in zip(offsets, offsets[1:])], [data[a:b].decode() for a, b in zip(cuts, cuts[1:])]


def test_without_dropout_it_is_the_library(monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    found = texts(300)
    want = sp.encode(found)
    assert encoded(found, 0.0) == (want, found)
    monkeypatch.setattr(P, "IN_STEP", 3)
    assert encoded(found, 0.0) == (want, found)


def test_agenda_in_step_is_the_plain_agenda_and_lossless(monkeypatch):
    found = [*texts(200, 2), "▁ literal ▁▁x"]
    for dropout in (0.1, 0.5, 0.99):
        got = encoded(found, dropout)
        assert got[1] == found
        monkeypatch.setattr(P, "IN_STEP", 0)
        assert encoded(found, dropout) == got
        monkeypatch.undo()


def test_seeds_vary_and_repeat():
    found = ["the internationalisation of everything"] * 50
    a, b, c = encoded(found, 0.2, 1)[0], encoded(found, 0.2, 1)[0], encoded(found, 0.2, 2)[0]
    assert a == b != c and len({*map(tuple, a)}) > 10
    assert len({*map(tuple, encoded(found, 0.2, 1, [7] * 50)[0])}) == 1


def test_table(spark):
    docs = [(1, "a b", "x"), (1, "a b", "x"), (None, "c", "x"), (2, None, "x"), (3, "", "x"), (4, "word " * 40000, None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, pieces string")
    rows = P.encode(d, PATH).collect()
    assert all(r.decoded == r.text for r in rows) and len(rows) == 6
    assert [r.pieces for r in rows if r.doc_id in (2, 3)] == [None, []]
    assert [r.pieces for r in rows if r.doc_id == 1][0] == [r.pieces for r in rows if r.doc_id == 1][1]
    assert all(r.lossless for r in P.piece_report(d, PATH).collect())
    assert P.piece_report(d.limit(0), PATH).collect() == []
