import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from paperloom.llm import tokenfiles as K

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts(n, seed=1):
    r = random.Random(seed)
    odd = ["don't", "é", "éx", "<|endoftext|>", "ABC's", "日本語", "x y", " ", "ΑΣ", "İstanbul", "12a3", "b.<|endoftext|>c", "<|startoftext|>", "a.'s", "'.b", "it's,", "é.b", "….a", "1é2", "J̌", "≮", "İx", "x=1+2;", "'re'reb", "№5", "...!", "a​b", "\x85", "🎉🎉", "́"]
    return [r.choice([" ", "  ", "\n", "\t "]).join(r.choices([*odd, "the", "cat", "thing", "other"], k=r.randrange(80))) for _ in range(n)]


def plain(docs):
    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc_id, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_words_encode_as_whole_texts():
    t = Tokenizer.from_file(PATH)
    found = texts(120)
    held = [x.encode() for x in found]
    at = np.concatenate([[0], np.cumsum([len(x) for x in held])])
    ids, offsets = K.encode_chunk(K.encoder(PATH), np.frombuffer(b"".join(held), np.uint8), at)
    for k, x in enumerate(found):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == [*t.encode(x, add_special_tokens=False).ids, 1]


def test_grammar_round_trips_and_spans_decode():
    r = np.random.default_rng(2)
    for ids in (np.zeros(0), np.array([5]), np.zeros(1000), r.integers(0, 9, 20000), np.tile([1, 2, 3, 1, 2], 999), r.integers(0, 49000, 3000)):
        for base in (49408, 70000):
            ids = ids.astype("<u2" if base < 65536 else "<u4")
            sequence, rules, lengths = K.compress(ids, base)
            assert (K.expand(sequence, rules, lengths, base) == ids).all()
            row = {"sequence": sequence.tobytes(), "rules": rules.tobytes(), "rule_lengths": lengths.tobytes()}
            for _ in range(20 if len(ids) else 0):
                a, b = sorted(r.integers(0, len(ids) + 1, 2).tolist())
                assert (K.read_span(row, a, b, base) == ids[a:b]).all()
    assert len(K.compress(np.tile([1, 2, 3, 1, 2], 999).astype("<u2"), 49408)[0]) < 100


def test_report_is_as_plain_encoding(spark, tmp_path):
    docs = [(k * 7 % 1000 - 20, t) for k, t in enumerate(texts(300))] + [(5000, None), (5001, ""), (5002, "long " * 20000)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    want = plain(sorted(docs, key=lambda x: x[0]))
    assert sorted(map(tuple, K.token_report(d, PATH).collect())) == sorted(want)
    path = str(tmp_path / "small")
    K.write_token_files(d, PATH, path, block_docs=16, segment_tokens=500)
    assert sorted(map(tuple, K.read_token_files(spark, path, PATH).collect())) == sorted(want)


def test_odd_tables(spark):
    kind = "doc_id bigint, text string, block int, ids string"
    assert K.token_report(spark.createDataFrame([], kind), PATH).collect() == []
    docs = [(None, "cat", 1, ""), (3, "the cat", 1, ""), (3, "the", 1, ""), (None, None, 1, "")]
    rows = K.token_report(spark.createDataFrame(docs, kind), PATH).collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == [None, None, 3, 3]
    assert sorted(r.n_tokens for r in rows) == [1, 2, 2, 3]


def test_ids_over_the_whole_range(spark):
    docs = [(i, t) for i, t in zip([-(2**63), -5, 10**15, 2**63 - 1, *range(100, 300)], texts(204, 5), strict=True)]
    d = spark.createDataFrame(docs + [(None, f"the cat {k}") for k in range(50)], "doc_id bigint, text string").repartition(4)
    rows = sorted((r for r in K.token_report(d, PATH).collect()), key=lambda r: r.start)
    assert [r.doc_id for r in rows[:50]] == [None] * 50
    first = rows[50].start
    assert [(r.doc_id, r.start - first, r.n_tokens, r.ids_crc32) for r in rows[50:]] == plain(sorted(docs))
