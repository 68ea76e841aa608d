"""SentencePiece encoding with seeded merge-dropout, and decoding.

Encoding works on a merge-type (BPE) piece model: the agenda holds every pair of neighbouring
symbols whose union is a piece, best score first and leftmost among equals. When a candidate comes
up, a hash keyed by the seed, the document, the place and the piece decides whether it is skipped;
a skipped candidate only comes back as a new one, when a neighbour has changed. One seed gives one
segmentation; other seeds give others, and all decode to the text itself.

Whole batches go through the agenda in step: words are dealt by length into matrices of symbols,
and each step takes every word's best candidate. ``encode_plainly`` is the same with one heap.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import chunks, list_array, mix, raw

DROPOUT, SEED = 0.1, 17
#: Bytes of text that a batch step takes: its matrices have some thirty times that.
STEP_BYTES = 1 << 20
#: Symbols up to which words go through the agenda in step; longer ones take the heap.
IN_STEP = 24
SPACE = "▁"
NONE = np.int32(1 << 30)


class PieceModel:
    """Pieces, their merges by rank and their bytes, of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [k for k in range(n) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]
        names = {model.id_to_piece(k): k for k in plain}
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        held = [b""] * n
        for b, k in enumerate(self.byte_ids.tolist()):
            held[k] = bytes([b])
        for piece, k in names.items():
            held[k] = piece.replace(SPACE, " ").encode()
        self.bytes_of = pa.array(held, pa.binary())
        self.size_of = np.array([len(x) for x in held], np.int64)
        self.char_ids = np.full(0x110000, -1, np.int32)
        for piece, k in names.items():
            if len(piece) == 1:
                self.char_ids[ord(piece)] = k
        # a literal U+2581 must not decode to a space: it goes byte by byte
        self.char_ids[ord(" ")], self.char_ids[ord(SPACE)] = self.char_ids[ord(SPACE)], -1
        order = {k: r for r, k in enumerate(sorted(names.values(), key=lambda k: -model.get_score(k)))}
        scores = {k: model.get_score(k) for k in names.values()}
        rank, last = {}, None
        for k in sorted(order, key=order.__getitem__):  # equal scores share a rank
            if last is None or scores[k] != scores[last]:
                top = order[k]
            rank[k], last = top, k
        merges = {}
        for piece, k in names.items():
            for cut in range(1, len(piece)):
                a, b = names.get(piece[:cut]), names.get(piece[cut:])
                if a is not None and b is not None:
                    merges[a << 20 | b] = k
        self.merges, self.rank = merges, rank
        self._hash(np.array(list(merges), np.uint64), np.array(list(merges.values()), np.int32))
        self.rank_of = np.full(n, NONE, np.int32)
        self.rank_of[list(rank)] = list(rank.values())

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressing table, at most an eighth full."""
        self.bits = max(4, int(np.ceil(np.log2(len(keys) * 8 + 1))))
        self.table = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.merged = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.table[at[left]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            claim = left[free]
            _, winners = np.unique(at[claim], return_index=True)
            won = claim[winners]
            self.table[at[won]], self.merged[at[won]] = keys[won], values[won]
            left = np.setdiff1d(left, won)
            taken = self.table[at[left]] != np.uint64(0xFFFFFFFFFFFFFFFF)
            at[left[taken]] = (at[left[taken]] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def union(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pieces that two neighbours make, -1 where they make none."""
        keys = (a.astype(np.uint64) << np.uint64(20)) | b.astype(np.uint64)
        keys[(a < 0) | (b < 0)] = np.uint64(0xFFFFFFFFFFFFFFFE)
        at = self._slot(keys)
        out = np.full(keys.shape, -1, np.int32)
        held = self.table[at]
        hit = held == keys
        out[hit] = self.merged[at[hit]]
        open_ = np.flatnonzero(~hit & (held != np.uint64(0xFFFFFFFFFFFFFFFF)))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            held = self.table[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.merged[at[open_[hit]]]
            open_ = open_[~hit & (held != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return out


@lru_cache(maxsize=2)
def model_at(path: str) -> PieceModel:
    return PieceModel(path)


def skips(key: np.ndarray, at: np.ndarray, piece: np.ndarray, limit: int) -> np.ndarray:
    """Whether the candidate ``piece`` whose left symbol begins at character ``at`` is skipped."""
    return mix(key ^ (at.astype(np.uint64) << np.uint64(32)) ^ piece.astype(np.uint64)) < np.uint64(limit)


def threshold(dropout: float) -> int:
    if not 0 <= dropout < 1:
        raise ValueError("dropout is at least 0 and less than 1")
    return int(dropout * 2.0**64)


def merge_plainly(model: PieceModel, symbols: list[int], key: int, limit: int) -> list[int]:
    """One word through the agenda."""
    n = len(symbols)
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    size, begin = [1] * n, list(range(n))
    agenda: list[tuple[int, int, int, int, int]] = []

    def propose(a: int) -> None:
        b = after[a]
        if a >= 0 and b < n and symbols[a] >= 0 and symbols[b] >= 0 and (k := model.merges.get(symbols[a] << 20 | symbols[b])) is not None:
            heapq.heappush(agenda, (model.rank[k], a, k, size[a], size[b]))

    for a in range(n - 1):
        propose(a)
    gone = [False] * n
    while agenda:
        _, a, k, had, took = heapq.heappop(agenda)
        b = after[a]
        if gone[a] or size[a] != had or b >= n or size[b] != took:
            continue
        if limit and skips(np.array([key], np.uint64), np.array([begin[a]]), np.array([k]), limit)[0]:
            continue
        symbols[a], size[a], gone[b], after[a] = k, had + took, True, after[b]
        if after[a] < n:
            before[after[a]] = a
        if before[a] >= 0:
            propose(before[a])
        propose(a)
    return [s for s, x in zip(symbols, gone, strict=True) if not x]


def moved_up(grid: np.ndarray, moved: np.ndarray, empty: int) -> np.ndarray:
    """Rows whose marked cells take what stands next to them; the last cell is emptied."""
    out = grid.copy()
    np.copyto(out[:, :-1], grid[:, 1:], where=moved[:, :-1])
    out[:, -1] = empty
    return out


def merge_in_step(model: PieceModel, symbols: np.ndarray, keys: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Many words of equal length through the agenda at once: the symbols left, and how many."""
    n, m = symbols.shape
    out, count = symbols.copy(), np.full(n, m)
    if m < 2:
        return out, count
    live = np.arange(n)
    now, begin = symbols.copy(), np.broadcast_to(np.arange(m, dtype=np.int16), (n, m)).copy()
    made = model.union(now[:, :-1].ravel(), now[:, 1:].ravel()).reshape(n, m - 1)
    rank = np.where(made >= 0, model.rank_of[made], NONE)
    left, key = np.full(n, m), keys
    column = np.arange(m, dtype=np.int16)
    while len(live):
        best = rank.argmin(axis=1)
        rows = np.arange(len(live))
        open_ = rank[rows, best] < NONE
        if not open_.all():
            done = ~open_
            out[live[done]], count[live[done]] = now[done], left[done]
            live, now, begin, made, rank, left, key, best = (x[open_] for x in (live, now, begin, made, rank, left, key, best))
            rows = np.arange(len(live))
            if not len(live):
                break
        piece = made[rows, best]
        if limit:
            skip = skips(key, begin[rows, best], piece, limit)
            rank[rows[skip], best[skip]] = NONE
            take = np.flatnonzero(~skip)
        else:
            take = rows
        if not len(take):
            continue
        at = best[take]
        moved = column > at[:, None].astype(np.int16)  # what lies behind the right symbol moves up
        some = moved_up(now[take], moved, -1)
        some[np.arange(len(take)), at] = piece[take]
        now[take] = some
        begin[take] = moved_up(begin[take], moved, 0)
        left[take] -= 1
        behind = moved[:, :-1]
        made[take], rank[take] = moved_up(made[take], behind, -1), moved_up(rank[take], behind, NONE)
        for side in (at - 1, at):
            ok = (side >= 0) & (side + 1 < left[take])
            r, c = take[ok], side[ok]
            k = model.union(now[r, c], now[r, c + 1])
            made[r, c], rank[r, c] = k, np.where(k >= 0, model.rank_of[k], NONE)
            gone = (side >= 0) & (side < m - 1) & ~ok
            rank[take[gone], side[gone]] = NONE
    return out, count


def encode_chunk(model: PieceModel, data: np.ndarray, at: np.ndarray, doc_keys: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of many texts one after the other, and the n+1 offsets into them.

    Each text that isn't empty begins with a space that isn't its own, as the model has it. A word
    is a run of spaces and what follows up to the next space; characters that no piece has are
    words of their own, encoded by their bytes. No piece reaches over such a border.
    """
    n_docs = len(at) - 1
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    first_of = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]  # characters before each text
    filled = np.flatnonzero(np.diff(first_of) > 0)
    chars = np.insert(points, first_of[filled], 32)
    first = first_of + np.searchsorted(filled, np.arange(n_docs + 1))
    total = len(chars)
    if not total:
        return np.zeros(0, np.int32), np.zeros(n_docs + 1, np.int64)
    ids = model.char_ids[chars]
    space, odd = chars == 32, ids < 0
    opens = np.ones(total, bool)
    opens[1:] = (space[1:] & ~space[:-1]) | odd[1:] | odd[:-1]
    opens[first[:-1][filled]] = True
    begins = np.flatnonzero(opens)
    sizes = np.diff(np.append(begins, total))
    doc = np.searchsorted(first, begins, side="right") - 1
    keys = mix(doc_keys[doc] ^ mix((begins - first[doc]).astype(np.uint64)))
    plain_bytes = np.where(chars < 0x80, 1, np.where(chars < 0x800, 2, np.where(chars < 0x10000, 3, 4)))
    alone = odd[begins]
    counts = np.where(alone, plain_bytes[begins], 0).astype(np.int64)
    results: list[tuple[np.ndarray, np.ndarray]] = []
    for m in np.unique(sizes[~alone]).tolist():
        rows = np.flatnonzero((sizes == m) & ~alone)
        if m <= IN_STEP:
            for a in range(0, len(rows), 1 << 14):
                some = rows[a : a + (1 << 14)]
                left, count = merge_in_step(model, ids[begins[some][:, None] + np.arange(m)], keys[some], limit)
                counts[some] = count
                results.append((some, left))
        else:
            for r in rows.tolist():
                left = np.array([merge_plainly(model, ids[begins[r] : begins[r] + m].tolist(), int(keys[r]), limit)], np.int32)
                counts[r] = left.shape[1]
                results.append((np.array([r]), left))
    ends = np.cumsum(counts)
    out = np.zeros(ends[-1], np.int32)
    offset = ends - counts
    for rows, left in results:
        column = np.arange(left.shape[1])
        mask = column < counts[rows][:, None]
        out[(offset[rows][:, None] + column)[mask]] = left[mask]
    rows = np.flatnonzero(alone)
    if len(rows):
        code = np.frombuffer(chars[begins[rows]].astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        n = counts[rows]
        out[np.repeat(offset[rows] - (np.cumsum(n) - n), n) + np.arange(len(code))] = model.byte_ids[code]
    return out, np.concatenate([[0], ends])[np.searchsorted(begins, first)]


def decode_chunk(model: PieceModel, ids: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """UTF-8 of many texts one after the other, and the n+1 offsets: the bytes of the pieces, without the first space."""
    held = np.frombuffer(model.bytes_of.take(pa.array(ids)).buffers()[2] or b"", np.uint8)
    at = np.concatenate([[0], np.cumsum(model.size_of[ids])])
    held, cuts = held[: at[-1]], at[offsets]
    filled = np.flatnonzero(np.diff(cuts) > 0)
    keep = np.ones(len(held), bool)
    keep[cuts[filled]] = False
    return held[keep].tobytes(), cuts - np.searchsorted(filled, np.arange(len(cuts)))


def doc_keys(doc_ids: pa.Array, seed: int) -> np.ndarray:
    """A key for each document; rows without an id share one."""
    numbers = pc.fill_null(doc_ids.cast(pa.int64()), -(1 << 62)).to_numpy(zero_copy_only=False).view(np.uint64)
    return mix(numbers ^ mix(np.array([seed], np.uint64)))


def encode(docs: DataFrame, path: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """``docs`` with ``pieces`` array<int> and ``decoded`` string (replaced if there).

    Null text has null pieces and a null decoded text, empty text no pieces. ``decoded`` is made of
    the pieces alone. Rows of equal doc_id and text are segmented alike.
    """
    limit = threshold(dropout)
    plain = docs.drop("pieces", "decoded")
    at_text, at_id = plain.columns.index("text"), plain.columns.index("doc_id")
    renamed = plain.toDF(*[f"c{k}" for k in range(len(plain.columns))])
    schema = T.StructType([*renamed.schema.fields, T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path)
        for batch in chunks(batches, f"c{at_text}", STEP_BYTES):
            column = batch.column(at_text)
            data, at = raw(column)
            ids, offsets = encode_chunk(model, data, at, doc_keys(batch.column(at_id), seed), limit)
            held, cuts = decode_chunk(model, ids, offsets)
            texts = pa.Array.from_buffers(pa.string(), batch.num_rows, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(held)])
            listed = list_array(ids, np.diff(offsets), pa.int32())
            if column.null_count:
                null = column.is_null()
                texts, listed = (pc.if_else(null, pa.scalar(None, x.type), x) for x in (texts, listed))
            yield pa.RecordBatch.from_arrays([*batch.columns, listed, texts], names=schema.names)

    made = renamed.mapInArrow(run, schema)
    return made.toDF(*plain.columns, "pieces", "decoded")


def piece_report(docs: DataFrame, path: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, n_pieces, pieces, decoded_sha256, lossless."""
    made = encode(docs.select("doc_id", "text"), path, dropout, seed)
    return made.select(
        "doc_id", F.coalesce(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces"), "pieces",
        F.sha2(F.coalesce("decoded", F.lit("")).cast("binary"), 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )
