"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton accepts every run of words of any item. A document's words are streamed through
it; the state and the matched length after each word give the longest run that ends there. Where
that length reaches the window (ten words, or a whole shorter item), the run's words are hit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import checkpointed, chunks, mix, raw, skew_join, unused, words

WINDOW = 10
#: Item text that one automaton holds; with more there are several, and runs of words are dealt to them.
BLOCK_BYTES = 512 << 10
#: Bits (as a power of two) of the sieve over all items' windows, and runs of words in a group of one automaton.
SIEVE_BITS, GROUP_RUNS = 24, 20_000
#: Words are runs of 0-9, a-z (after lowering A-Z) and bytes over 0x7F.
BYTE_MAP = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
MARKS = "hit_spans array<struct<first:int,last:int,start:int,end:int>>, items array<string>, n_words bigint"


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(BYTE_MAP).split()


class ItemAutomaton:
    """Generalised suffix automaton over word numbers, with the items of each window."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window = window
        number: dict[bytes, int] = {}
        texts = [(name, [number.setdefault(w, len(number)) for w in item_words(text)]) for name, text in items]
        self.vocabulary = pa.array(list(number), pa.binary())
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, ws in texts:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        #: Of each state: items whose windows of full length end there, and whole short items by length.
        self.full: dict[int, set[str]] = {}
        self.short: dict[int, dict[int, set[str]]] = {}
        self.least = window
        pairs = set()
        for name, ws in texts:
            pairs.update(zip(ws, ws[1:], strict=False))
            if not ws:
                continue
            state = matched = 0
            for w in ws:
                state, matched = self.next[state][w], matched + 1
                if len(ws) >= window and matched >= window:
                    while self.length[self.link[state]] >= window:
                        state = self.link[state]
                    matched = min(matched, self.length[state])
                    self.full.setdefault(state, set()).update([name] if name is not None else [])
            if len(ws) < window:
                self.short.setdefault(state, {}).setdefault(len(ws), set()).update([name] if name is not None else [])
                self.least = min(self.least, len(ws))
        self.ending = self._short_suffixes()
        codes = np.array(sorted(a * len(number) + b for a, b in pairs), np.int64)
        self.pair_codes = codes
        self.pair_sieve = np.zeros(1 << 20, bool)
        self.pair_sieve[self._slot(codes)] = True

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def _extend(self, last: int, w: int) -> int:
        go, link, length = self.next, self.link, self.length
        if w in go[last]:
            to = go[last][w]
            return to if length[to] == length[last] + 1 else self._clone(last, w, to)
        new = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in go[p]:
            go[p][w] = new
            p = link[p]
        if p >= 0:
            to = go[p][w]
            link[new] = to if length[to] == length[p] + 1 else self._clone(p, w, to)
        return new

    def _clone(self, p: int, w: int, to: int) -> int:
        go, link, length = self.next, self.link, self.length
        copy = len(go)
        go.append(dict(go[to]))
        link.append(link[to])
        length.append(length[p] + 1)
        link[to] = copy
        while p >= 0 and go[p].get(w) == to:
            go[p][w] = copy
            p = link[p]
        return copy

    def _short_suffixes(self) -> dict[int, int]:
        """The nearest state with short items on each state's suffix path, itself included."""
        found: dict[int, int] = {}
        if self.short:
            for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
                at = state if state in self.short else found.get(self.link[state], 0)
                if at:
                    found[state] = at
        return found

    def stream(self, numbers: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans (merged, word positions from 0) and the items whose windows occur."""
        go, link, length, window, ending = self.next, self.link, self.length, self.window, self.ending
        spans: list[list[int]] = []
        items: set[str] = set()
        state = matched = 0
        for k, w in enumerate(numbers):
            while state and w not in go[state]:
                state = link[state]
                matched = length[state]
            if w in go[state]:
                state, matched = go[state][w], matched + 1
            reach = 0
            if matched >= window:
                while length[link[state]] >= window:
                    state = link[state]
                matched = min(matched, length[state])
                if state in self.full:
                    reach = window
                    items |= self.full[state]
            at = ending.get(state, 0)
            while at:
                for n, names in self.short[at].items():
                    if n <= matched:
                        reach = max(reach, n)
                        items |= names
                at = ending.get(link[at], 0)
            if reach:
                first = k + 1 - reach
                while spans and spans[-1][0] >= first:
                    spans.pop()
                if spans and spans[-1][1] >= first:
                    spans[-1][1] = k + 1
                else:
                    spans.append([first, k + 1])
        return [(a, b) for a, b in spans], items

    def numbered(self, found: pa.Array) -> np.ndarray:
        """The words' numbers; -1 for those that no item has."""
        return pc.fill_null(pc.index_in(found, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False)

    def segments(self, numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of words in which each neighbouring pair is one of some item.

        The automaton falls back to a single word wherever a pair is none of the items', so runs
        that are shorter than the shortest window can't hold a hit and aren't streamed.
        """
        if self.least < 2:
            mask = numbers >= 0
            cuts, reach = first, 0
        else:
            codes = numbers[:-1].astype(np.int64) * len(self.vocabulary) + numbers[1:]
            mask = (numbers[:-1] >= 0) & (numbers[1:] >= 0)
            mask &= self.pair_sieve[self._slot(np.where(mask, codes, 0))]
            at = np.flatnonzero(mask)
            if len(at):
                where = np.searchsorted(self.pair_codes, codes[at])
                mask[at] = self.pair_codes[np.minimum(where, len(self.pair_codes) - 1)] == codes[at]
            inner = first[(first > 0) & (first <= len(mask))]
            mask[inner - 1] = False  # a pair over the border of two documents
            cuts, reach = np.zeros(0, np.int64), 1
        edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2] + reach
        if len(cuts):  # single-word items: runs may not cross documents
            inner = cuts[(cuts > 0) & (cuts < len(mask))]
            inside = inner[mask[inner] & mask[inner - 1]]
            starts, ends = np.union1d(starts, inside), np.union1d(ends, inside)
        keep = ends - starts >= self.least
        return starts[keep], ends[keep]


def _marked(model: ItemAutomaton | None, batches: Iterator[pa.RecordBatch], text: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches with hit_spans, items and n_words; without a model the first two are there (null: none)."""
    for batch in chunks(batches, text):
        data, at = raw(batch.column(batch.schema.get_field_index(text)))
        starts, ends, first, found = words(data, at, BYTE_MAP)
        counts = pa.array(np.diff(first), pa.int64())
        if model is None:
            yield pa.RecordBatch.from_arrays([*batch.columns, counts], names=schema.names)
            continue
        hits: dict[int, tuple[list, set]] = {}
        if len(starts) and len(model.vocabulary):
            numbers = model.numbered(found)
            for a, b in zip(*model.segments(numbers, first), strict=True):
                spans, items = model.stream(numbers[a:b].tolist())
                if spans:
                    doc = int(np.searchsorted(first, a, side="right")) - 1
                    had, names = hits.setdefault(doc, ([], set()))
                    had += [(int(a + x - first[doc]), int(a + y - first[doc]), int(starts[a + x] - at[doc]), int(ends[a + y - 1] - at[doc])) for x, y in spans]
                    names |= items
        keys = ("first", "last", "start", "end")
        found_spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        found_items: list[list[str]] = [[] for _ in range(batch.num_rows)]
        for doc, (spans, items) in hits.items():
            found_spans[doc] = [dict(zip(keys, s, strict=True)) for s in spans]
            found_items[doc] = sorted(items)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found_spans, schema.field("hit_spans").type), pa.array(found_items, schema.field("items").type), counts], names=schema.names)


# --- items that one automaton can't hold ----------------------------------------------------------


def word_hashes(found: pa.Array) -> np.ndarray:
    coded = found.dictionary_encode() if len(found) else pa.array([], pa.binary()).dictionary_encode()
    held = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    return held[coded.indices.to_numpy(zero_copy_only=False)]


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for each n words in a row."""
    out = np.full(max(0, len(hashes) - n + 1), n, np.uint64)
    for k in range(n if len(out) else 0):
        out = mix(out ^ hashes[k : k + len(out)])
    return out


def _windows_of_items(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """batch: text, block -> block, n, h of each window of each item."""
    for batch in batches:
        blocks, sizes, found = [], [], []
        for text, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ws = word_hashes(pa.array(item_words(text), pa.binary()))
            n = min(window, len(ws))
            h = np.unique(window_hashes(ws, n)) if n else np.zeros(0, np.uint64)
            found.append(h)
            blocks.append(np.full(len(h), block, np.int32))
            sizes.append(np.full(len(h), n, np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (blocks, sizes, [h.view(np.int64) for h in found])], names=["block", "n", "h"])


SEGMENT = "k1 bigint, k2 bigint, pos bigint, words binary, starts binary, ends binary, hs array<bigint>"


def _segments(batches: Iterator[pa.RecordBatch], sieve: np.ndarray, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """batch: text, k1, k2 -> the runs of words whose windows the sieve lets through, with these windows' hashes."""
    for batch in chunks(batches):
        data, at = raw(batch.column(0))
        starts, ends, first, found = words(data, at, BYTE_MAP)
        h = word_hashes(found)
        doc = np.searchsorted(first, np.arange(len(h)), side="right") - 1
        mask, hits = np.zeros(len(h) + 1, np.int64), []
        for n in sizes:
            w = window_hashes(h, n)
            slot = w & np.uint64(len(sieve) - 1)
            some = np.flatnonzero(sieve[slot] & (doc[: len(w)] == doc[n - 1 :][: len(w)]))
            mask[some] += 1
            np.subtract.at(mask, some + n, 1)
            hits.append(np.stack([some, w[some].view(np.int64)], 1))
        inside = np.cumsum(mask)[:-1] > 0
        opens = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1] | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
        if not len(opens):
            continue
        closes = np.flatnonzero(inside & np.concatenate([~inside[1:] | (doc[1:] != doc[:-1]), [True]])) + 1
        every = np.concatenate(hits)
        order = np.argsort(every[:, 0], kind="stable")
        cuts = np.searchsorted(every[order, 0], np.append(opens, len(h)))
        held, k1, k2 = found.to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        rows = []
        for j, (a, b) in enumerate(zip(opens.tolist(), closes.tolist(), strict=True)):
            d = int(doc[a])
            rows.append((k1[d], k2[d], a - int(first[d]), b" ".join(held[a:b]), (starts[a:b] - at[d]).astype("<i4").tobytes(), (ends[a:b] - at[d]).astype("<i4").tobytes(), np.unique(every[order[cuts[j] : cuts[j + 1]], 1]).tolist()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SEGMENT.split(", ")])


def _hits_by_blocks(keyed: DataFrame, items: DataFrame, blocks: int, window: int) -> DataFrame:
    """k1, k2, hit_spans, items for texts (text, k1, k2) that hold a window of any item.

    A sieve of fixed size over all items' windows, broadcast, leaves the runs of words that may hold
    one; a join on the windows' hashes deals them to the blocks that have them, in groups of bounded
    size, where the block's automaton streams them.
    """
    named = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    named = checkpointed(named.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int")))
    windows = checkpointed(named.select("text", "block").mapInArrow(lambda it: _windows_of_items(it, window), "block int, n int, h bigint"))
    sizes = sorted(r.n for r in windows.select("n").distinct().collect())  # at most ``window``
    low = F.col("h").bitwiseAND(F.lit((1 << SIEVE_BITS) - 1))
    bits = windows.groupBy(F.shiftright(low, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 AS int))")).alias("bits")).toArrow()  # at most 2 ** (SIEVE_BITS - 6) rows
    sieve = np.zeros(1 << (SIEVE_BITS - 6), np.int64)
    sieve[bits["at"].to_numpy()] = bits["bits"].to_numpy()
    held = keyed.sparkSession.sparkContext.broadcast(np.unpackbits(sieve.astype("<i8").view(np.uint8), bitorder="little").astype(bool))
    found = keyed.mapInArrow(lambda it: _segments(it, held.value, sizes), SEGMENT)
    runs = checkpointed(found.dropDuplicates(["k1", "k2", "pos"]))
    met = checkpointed(runs.select("k1", "k2", "pos", F.explode("hs").alias("h")))
    homes = windows.groupBy("h").agg(F.collect_set("block").alias("blocks")).join(met.groupBy("h").agg(F.count("*").alias("n")), "h")
    where = skew_join(met, checkpointed(homes), ["h"], met.count()).select("k1", "k2", "pos", F.explode("blocks").alias("block")).distinct()
    dealt = checkpointed(runs.drop("hs").join(where, ["k1", "k2", "pos"]))
    dealt, spread = _salted(dealt, named)
    kind = "k1 bigint, k2 bigint, spans array<struct<first:int,last:int,start:int,end:int>>, items array<string>"

    def stream(runs: pa.Table, items: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if runs.num_rows and items.num_rows:
            model = ItemAutomaton(list(zip(items["item_id"].to_pylist(), items["text"].to_pylist(), strict=True)), window)
            for r in runs.to_pylist():
                numbers = model.numbered(pa.array(r["words"].split(b" "), pa.binary()))
                spans, names = model.stream(numbers.tolist())
                starts, ends = (np.frombuffer(r[k], "<i4").tolist() for k in ("starts", "ends"))
                made = [{"first": r["pos"] + x, "last": r["pos"] + y, "start": starts[x], "end": ends[y - 1]} for x, y in spans]
                if made:
                    rows.append((r["k1"], r["k2"], made, sorted(names)))
        span = pa.struct([(k, pa.int32()) for k in ("first", "last", "start", "end")])
        kinds = [pa.int64(), pa.int64(), pa.list_(span), pa.list_(pa.string())]
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["k1", "k2", "spans", "items"])

    made = dealt.groupBy("block", "salt").cogroup(spread.groupBy("block", "salt")).applyInArrow(stream, kind)
    return made.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("hit_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def _salted(dealt: DataFrame, named: DataFrame, group: int = GROUP_RUNS) -> tuple[DataFrame, DataFrame]:
    """Runs and items by block and ``salt``: as many salts as a block's own runs are worth, its items copied to each."""
    sizes = checkpointed(dealt.groupBy("block").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / group).cast("int")))
    told = skew_join(dealt, sizes, ["block"], dealt.count())
    runs = told.withColumn("salt", F.pmod(F.xxhash64("k1", "pos"), F.col("salts")).cast("int")).drop("salts")
    return runs, named.join(sizes, "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts", "n")


def mark(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, text: str = "text") -> DataFrame:
    """``docs`` with ``hit_spans`` (word positions and byte offsets), ``items`` and ``n_words``.

    Null text and null items have no words; items with a null id hit words but aren't listed.
    Repeated rows are marked alike; columns of those three names are replaced. Whole texts are
    streamed, however long. Items over ``block_bytes`` are dealt to several automata
    (``_hits_by_blocks``); spans of different ones may overlap.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = docs.drop("hit_spans", "items", "n_words")
    schema = T.StructType([*out.schema.fields, *T._parse_datatype_string(MARKS).fields])
    arrow = to_arrow_schema(schema)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    if blocks == 1:
        held = [(r[0], r[1]) for r in items.select(F.col("item_id").cast("string"), "text").toLocalIterator()]  # block_bytes at most
        model = docs.sparkSession.sparkContext.broadcast(ItemAutomaton(held, window))
        return out.mapInArrow(lambda it: _marked(model.value, it, text, arrow), schema)
    plain = F.coalesce(F.col(text), F.lit(""))
    keys = F.xxhash64(plain), F.xxhash64(plain, F.lit("second"))
    hits = _hits_by_blocks(out.select(plain.alias("text"), keys[0].alias("k1"), keys[1].alias("k2")), items, blocks, window)
    names = [unused(out.columns, k) for k in ("k1", "k2")]
    keyed = out.withColumns(dict(zip(names, keys, strict=True))).join(hits.withColumnsRenamed(dict(zip(("k1", "k2"), names, strict=True))), names, "left")
    spans = T._parse_datatype_string(MARKS)["hit_spans"].dataType
    keyed = keyed.select(*out.columns, F.coalesce("hit_spans", F.array().cast(spans)).alias("hit_spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return keyed.mapInArrow(lambda it: _marked(None, it, text, arrow), schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    kind = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    names = [x.split()[0] for x in kind.split(", ")]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for b in batches:
            spans, listed = b.column(2), b.column(3)
            sizes = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
            hit, n_items, digests = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), [none] * b.num_rows
            for k in np.flatnonzero(sizes):
                hit[k] = sum(y - x for x, y in merged([(s["first"], s["last"]) for s in spans[k].as_py()]))
                got = sorted(listed[k].as_py())
                n_items[k], digests[k] = len(got), hashlib.sha256(",".join(got).encode()).hexdigest()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hit), pa.array(n_items), pa.array(digests), pa.array(hit > 0)], names=names)

    found = mark(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), items, window, block_bytes)
    return found.select("doc_id", "n_words", "hit_spans", "items").mapInArrow(digest, kind)


def cleaned(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_coverage: float = 0.5) -> DataFrame:
    """Documents without their hit spans; those with more than ``most_coverage`` of their words hit go.

    The columns are those of ``docs``. A removed span leaves the white space around it, cut to one
    break. Documents without a hit, null texts included, stay as they are; ``n_chars`` follows the text.
    Whole texts count, however long; repeated rows are cut alike, an empty table stays empty.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    columns = docs.columns
    arrow = to_arrow_schema(docs.schema)
    text_at = columns.index("text")
    size_at = columns.index("n_chars") if "n_chars" in columns else -1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, n_words = b.column(len(columns)), b.column(len(columns) + 1)
            sizes = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
            keep, changed, counts = np.ones(b.num_rows, bool), {}, {}
            for k in np.flatnonzero(sizes):
                got = spans[k].as_py()
                if sum(y - x for x, y in merged([(s["first"], s["last"]) for s in got])) > most_coverage * n_words[k].as_py():
                    keep[k] = False
                    continue
                held, parts, last = b.column(text_at)[k].as_py().encode(), [], 0
                for x, y in merged([(s["start"], s["end"]) for s in got]):
                    parts.append(held[last:x])
                    last = y
                parts.append(held[last:])
                kept = parts[0]
                for p in parts[1:]:
                    kept = kept + p.lstrip(b" \t\r\n") if kept[-1:] in (b" ", b"\n", b"") else kept + p
                changed[k] = kept.decode()
                counts[k] = len(changed[k])
            own = list(b.columns[: len(columns)])
            if changed:
                texts = own[text_at].to_pylist()
                for k, t in changed.items():
                    texts[k] = t
                own[text_at] = pa.array(texts, arrow.field(text_at).type)
                if size_at >= 0:
                    sizes_now = own[size_at].to_pylist()
                    for k, n in counts.items():
                        sizes_now[k] = n
                    own[size_at] = pa.array(sizes_now, arrow.field(size_at).type)
            out = pa.RecordBatch.from_arrays(own, names=arrow.names)
            yield out if keep.all() else out.filter(pa.array(keep))

    plain = docs.toDF(*[f"c{k}" if c != "text" else "text" for k, c in enumerate(columns)])
    found = mark(plain, items, window).select(*plain.columns, "hit_spans", "n_words")
    return found.mapInArrow(cut, docs.schema)
