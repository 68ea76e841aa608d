"""Token-id files: documents are encoded, laid out in ascending doc_id order and compressed by Re-Pair.

A file is a Parquet table of segments. A segment holds some thousand consecutive documents: their
ids and token counts, and their tokens as a grammar. Re-Pair replaces frequent pairs of symbols by
nonterminals, again and again; the rules and each nonterminal's expansion length are stored, so any
span of tokens is decoded without the rest. Segments are written by Spark in the shared folder.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import LARGE_CHUNK, Blocks, chunks, raw, shared_path, spans_of

END_ID = 1
#: Documents in a block of consecutive ids (more if there would be too many blocks).
BLOCK_DOCS = 512
#: Tokens at which a segment is closed.
SEGMENT_TOKENS = 2_000_000
ROUNDS, LEAST_COUNT = 8, 8
#: Pieces whose ids a Python worker remembers, and those encoded in one call.
MEMORY_PIECES, AT_ONCE = 600_000, 4_000
#: Classes of bytes: white space, digits, letters, other ASCII, and what pieces are not cut beside.
SPACE, DIGIT, LETTER, MARK, WHOLE = range(5)


def _class_of(x: int) -> int:
    if x in b" \t\n\r\x0b\x0c":
        return SPACE
    if x >= 128 or x == 39:  # an apostrophe may begin a contraction
        return WHOLE
    return LETTER if chr(x).isalpha() else DIGIT if chr(x).isdigit() else MARK


CLASSES = np.array([_class_of(x) for x in range(256)], np.uint8)
LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
#: Pieces of one class in ASCII: the tokenizer takes each as one word, whose last id alone ends a word.
ONE_WORD = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9\x80-\xff']+")


# --- encoding ----------------------------------------------------------------------------------


def cut_pieces(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(first piece of each text, n+1 entries; the pieces): the parts of a text that are encoded apart.

    Texts are cut at white space and between ASCII letters, digits and marks, where the tokenizer's
    own words end as well; never beside an apostrophe or a byte of a longer character. Letters are
    lower-cased unless combining marks (U+0300 to U+036F) may turn them into others.
    """
    if not len(data):
        return np.zeros(len(at), np.int64), pa.array([], pa.binary())
    kind = CLASSES[data]
    solid = kind != SPACE
    left, right = kind[:-1], kind[1:]
    edge = ((left != right) | (left == DIGIT)) & (left != WHOLE) & (right != WHOLE)
    cuts = np.concatenate([at, np.flatnonzero(edge) + 1])
    starts, ends = spans_of(solid, cuts)
    plain = data if ((data == 0xCC) | (data == 0xCD)).any() else np.frombuffer(data.tobytes().translate(LOWER), np.uint8)
    ends_at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    kept = np.ascontiguousarray(plain[solid])
    return np.searchsorted(starts, at), pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends_at), pa.py_buffer(kept)])


class PieceEncoder:
    """Ids of pieces, as the tokenizer gives them for whole texts without special tokens in them.

    Each worker remembers the pieces it met first, up to a bound; the others are encoded each time.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel ones
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.closes = np.zeros(self.size, bool)
        self.closes[[k for word, k in self.tokenizer.get_vocab(with_added_tokens=False).items() if word.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def _encode(self, found: list[bytes]) -> dict[bytes, bytes]:
        out: dict[bytes, bytes] = {}
        simple = [w for w in found if ONE_WORD.fullmatch(w)]
        lines = [simple[k : k + 50] for k in range(0, len(simple), 50)]
        for first in range(0, len(lines), AT_ONCE // 50):
            some = lines[first : first + AT_ONCE // 50]
            made = self.tokenizer.encode_batch_fast([b" ".join(x).decode() for x in some], add_special_tokens=False)
            ids = np.concatenate([np.array(m.ids, self.kind) for m in made])
            cuts = (self.kind.itemsize * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
            held = ids.tobytes()
            words = [w for x in some for w in x]
            out.update((w, held[a:b]) for w, a, b in zip(words, [0, *cuts], cuts, strict=False))
            if len(cuts) != len(words):
                raise ValueError("the tokenizer does not end words as its pieces do")
        rest = [w for w in found if w not in out]
        for first in range(0, len(rest), AT_ONCE):
            some = rest[first : first + AT_ONCE]
            made = self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
            out.update((w, np.array(m.ids, self.kind).tobytes()) for w, m in zip(some, made, strict=True))
        return out

    def ids(self, found: list[bytes]) -> list[bytes]:
        known = self.known
        new = [w for w in found if w not in known]
        if not new:
            return [known[w] for w in found]
        made = self._encode(new)
        room = MEMORY_PIECES - len(known)
        if room > 0:
            known.update(made if len(made) <= room else list(made.items())[:room])
        return [made[w] if w in made else known[w] for w in found]


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encode_plain(coder: PieceEncoder, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many texts one after the other, and the n+1 offsets."""
    first, found = cut_pieces(data, at)
    coded = found.dictionary_encode() if len(found) else pa.array([], pa.binary()).dictionary_encode()
    parts = coder.ids(coded.dictionary.to_pylist())
    flat = np.frombuffer(b"".join(parts), coder.kind)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // coder.kind.itemsize
    begins = np.cumsum(sizes) - sizes
    which = coded.indices.to_numpy(zero_copy_only=False)
    lengths = sizes[which]
    ends = np.cumsum(lengths)
    ids = flat[np.repeat(begins[which] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
    return ids, np.concatenate([[0], ends])[first]


def encode_chunk(coder: PieceEncoder, data: np.ndarray, at: np.ndarray, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many texts one after the other, each closed by ``end_id``, and the n+1 offsets.

    A text that holds a special token's string is encoded by the tokenizer in one piece.
    """
    held = data.tobytes()
    if any(x in held for x in coder.special):
        texts = [held[a:b] for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
        odd = [any(x in t for x in coder.special) for t in texts]
        plain = [b"" if o else t for t, o in zip(texts, odd, strict=True)]
        ids, offsets = encode_plain(coder, np.frombuffer(b"".join(plain), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in plain])]).astype(np.int64))
        parts = [np.array(coder.tokenizer.encode(t.decode(), add_special_tokens=False).ids, coder.kind) if o else ids[offsets[k] : offsets[k + 1]] for k, (t, o) in enumerate(zip(texts, odd, strict=True))]
        ids, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    else:
        ids, offsets = encode_plain(coder, data, at)
    if end_id is None:
        return ids, offsets
    return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))


# --- Re-Pair -----------------------------------------------------------------------------------


def _slots(codes: np.ndarray) -> np.ndarray:
    return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def compress(ids: np.ndarray, base: int, rounds: int = ROUNDS, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, rules, lengths): rule k is what symbol base + k stands for, lengths its tokens.

    A round replaces many frequent pairs at once, left to right where they overlap. ``base`` is
    over every id; symbols stay in 16 bits where ids do.
    """
    narrow = base < (1 << 16)
    kind = np.dtype("<u2") if narrow else np.dtype("<u4")
    room = (1 << 16) - base if narrow else 1 << 20
    sequence, rules = ids.astype(kind), np.zeros((0, 2), kind)
    size_of = np.ones(base, np.int64)
    for k in range(rounds):
        if len(sequence) < 2 or len(rules) >= room:
            break
        wide = np.uint32 if narrow else np.uint64
        codes = (sequence[:-1].astype(wide) << wide(16 if narrow else 32)) | sequence[1:].astype(wide)
        ordered = np.sort(codes)
        edges = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)]])
        counts, values = np.diff(edges), ordered[edges[:-1]]
        often = np.flatnonzero(counts >= least)
        if not len(often):
            break
        most = -(-(room - len(rules)) // (rounds - k))
        often = often[np.argsort(-counts[often], kind="stable")[:most]][::-1]
        chosen = values[often]
        held = np.zeros(1 << 16, wide)
        name = np.full(1 << 16, -1, np.int64)
        slot = _slots(chosen)
        held[slot], name[slot] = chosen, 0  # of pairs that fall in one slot the most frequent stays
        used = np.flatnonzero(name >= 0)
        name[used] = base + len(rules) + np.arange(len(used))
        where = _slots(codes)
        at = np.flatnonzero((held[where] == codes) & (name[where] >= 0))
        opening = np.concatenate([[True], np.diff(at) != 1])
        order = np.arange(len(at))
        at = at[(order - np.maximum.accumulate(np.where(opening, order, 0))) % 2 == 0]
        pairs = np.stack([held[used] >> wide(16 if narrow else 32), held[used] & wide(0xFFFF if narrow else 0xFFFFFFFF)], 1).astype(kind)
        size_of = np.concatenate([size_of, size_of[pairs[:, 0]] + size_of[pairs[:, 1]]])
        rules = np.concatenate([rules, pairs])
        sequence = sequence.copy()
        sequence[at] = name[where[at]]
        keep = np.ones(len(sequence), bool)
        keep[at + 1] = False
        sequence = sequence[keep]
    return sequence, rules, size_of[base:].astype("<u4")


def expand(sequence: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The tokens that the symbols stand for."""
    if not len(rules):
        return sequence
    total = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    flat = np.zeros(total[-1], sequence.dtype)
    for k, (a, b) in enumerate(rules.tolist()):  # a rule only has symbols made before it
        at = int(total[k])
        for x in (a, b):
            if x < base:
                flat[at] = x
                at += 1
            else:
                n = int(lengths[x - base])
                flat[at : at + n] = flat[total[x - base] : total[x - base + 1]]
                at += n
    symbols = sequence.astype(np.int64)
    is_rule = symbols >= base
    pick = np.where(is_rule, symbols - base, 0)
    sizes = np.where(is_rule, lengths.astype(np.int64)[pick], 1)
    ends = np.cumsum(sizes)
    out = flat[np.minimum(np.repeat(total[pick] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0), len(flat) - 1)]
    plain = ~is_rule
    out[(ends - sizes)[plain]] = sequence[plain]
    return out


def read_span(segment: dict, first: int, last: int, base: int) -> np.ndarray:
    """Tokens first..last-1 of a segment; only the symbols that cover them are expanded."""
    kind = "<u2" if base < (1 << 16) else "<u4"
    sequence, rules, lengths = np.frombuffer(segment["sequence"], kind), np.frombuffer(segment["rules"], kind).reshape(-1, 2), np.frombuffer(segment["rule_lengths"], "<u4")
    sizes = np.concatenate([np.ones(base, np.int64), lengths])[sequence]
    ends = np.cumsum(sizes)
    a, b = int(np.searchsorted(ends, first, side="right")), int(np.searchsorted(ends, last, side="left")) + 1
    skipped = int(ends[a - 1]) if a else 0
    return expand(sequence[a:b], rules, lengths, base)[first - skipped : last - skipped]


# --- files -------------------------------------------------------------------------------------

SEGMENT = "block bigint, segment int, block_start bigint, n_tokens bigint, doc_ids array<bigint>, doc_tokens array<bigint>, rules binary, rule_lengths binary, sequence binary"


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, block_docs: int = BLOCK_DOCS, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encodes ``docs`` (doc_id, text) and writes the segments under ``path``.

    Order: doc_id, nulls first; rows of equal ids by their ids' checksum. Null text is empty. Part
    files are in ascending order of doc_id, as are blocks, segments in a block and rows in them.
    Blocks hold as many documents each, wherever the ids lie; only rows of one id, or of none and
    one text, are never parted. A very long text is encoded at once and closes its segment.
    Repeated rows are documents of their own; an empty table gives empty files.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    blocks = Blocks.of(docs, block_docs)
    rank, count = blocks.rank(F.col("block"))
    parts = max(1, min(count, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    part = F.expr(f"cast(rank * {parts} div {count} as int)")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in chunks(batches, most=LARGE_CHUNK):
            data, at = raw(batch.column(1))
            ids, offsets = encode_chunk(coder, data, at, end_id)
            wide = pa.array((offsets * coder.kind.itemsize).astype(np.int32))
            held = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, wide.buffers()[1], pa.py_buffer(np.ascontiguousarray(ids))])
            ties = np.array([zlib.crc32(held[k].as_buffer()) for k in range(batch.num_rows)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(blocks.number(batch.column(0), ties), pa.int64()), batch.column(0), pa.array(ties), held], names=["block", "doc_id", "tie", "ids"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        base = coder.size
        at = {"block": None, "segment": 0, "start": 0}
        names, parts_of, total = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal names, parts_of, total
            ids = np.frombuffer(b"".join(parts_of), coder.kind)
            sequence, rules, lengths = compress(ids, base)
            counts = [len(x) // coder.kind.itemsize for x in parts_of]
            row = [at["block"], at["segment"], at["start"], total, names, counts, rules.tobytes(), lengths.tobytes(), sequence.tobytes()]
            at["segment"] += 1
            at["start"] += total
            names, parts_of, total = [], [], 0
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in SEGMENT.split(", ")])

        for batch in batches:
            for block, doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if block != at["block"]:
                    if names:
                        yield close()
                    at = {"block": block, "segment": 0, "start": 0}
                elif total >= segment_tokens:
                    yield close()
                held = ids.as_py()
                names.append(doc_id)
                parts_of.append(held)
                total += len(held) // coder.kind.itemsize
        if names:
            yield close()

    ids = docs.mapInArrow(encoded, "block bigint, doc_id bigint, tie bigint, ids binary")
    dealt = ids.withColumn("rank", rank).withColumn("part", part).repartitionById(parts, F.col("part")).drop("part", "rank")
    ordered = dealt.sortWithinPartitions("block", F.col("doc_id").asc_nulls_first(), "tie")
    ordered.mapInArrow(packed, SEGMENT).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, decoded from the grammar."""
    segments = spark.read.schema(SEGMENT).parquet(path)
    bases = segments.groupBy("block").agg(F.sum("n_tokens").alias("n")).selectExpr("block", "sum(n) OVER (ORDER BY block) - n AS base_start")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = encoder(tokenizer).size
        kind = "<u2" if base < (1 << 16) else "<u4"
        for batch in batches:
            for row in batch.to_pylist():
                rules = np.frombuffer(row["rules"], kind).reshape(-1, 2)
                ids = expand(np.frombuffer(row["sequence"], kind), rules, np.frombuffer(row["rule_lengths"], "<u4"), base).astype("<u4")
                counts = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(counts)
                held, cuts = memoryview(ids.tobytes()), (4 * np.concatenate([[0], ends])).tolist()
                sums = [zlib.crc32(held[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                blocks = pa.array(np.full(len(counts), row["block"], np.int64))
                yield pa.RecordBatch.from_arrays([blocks, pa.array(row["doc_ids"], pa.int64()), pa.array(row["block_start"] + ends - counts), pa.array(counts), pa.array(sums, pa.int64())], names=["block", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = segments.mapInArrow(decoded, "block bigint, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    # at most MOST_BLOCKS + NULL_BLOCKS rows of 16 bytes
    placed = rows.join(F.broadcast(bases), "block")
    return placed.select("doc_id", (F.col("base_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = shared_path(docs.sparkSession, "token-files")
    write_token_files(docs, tokenizer, path)
    return read_token_files(docs.sparkSession, path, tokenizer)
