"""Suffix-array dedup of bytes: what a 50-byte string repeats of a document with a smaller id goes.

Not all suffixes are sorted. Every string of LENGTH bytes holds an anchor, the gram of GRAM bytes
with the least hash in it, at the same place in each of its copies; so only suffixes that begin at
anchors are compared, and with them the strings around that share the anchor.

1. Anchors: each chunk of documents sends its distinct gram hashes to buckets, packed; buckets
   answer with the anchors that more than one place has. The rest can't repeat.
2. Suffixes: around each such anchor the strings that it stands for are sent on. Sampled splitters
   range-partition them by the leading bytes of the suffix at the anchor; each bucket sorts by
   multikey quicksort over eight-byte characters, first the suffixes at anchors, then, where strings
   differ around an anchor, the suffixes at each of their places. Neighbours with 50 bytes in common
   are a run, whose least doc_id keeps it. Splitters are as long as one character and equal ones go
   one way; with its anchor each 50-byte string has one bucket, so no run lies across a boundary.
3. Each document's spans are united and cut. They travel packed by parts of the documents.

What repeats inside a chunk is settled there: a string that a third of all documents hold is sent
once a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import LARGE_CHUNK, chunks, mix, raw
from paperloom.llm.winnow import BASE

LENGTH, GRAM = 50, 24
#: Text bytes that a bucket has on average; ranges of leading bytes (more buckets split ranges by hash).
BUCKET_BYTES, MOST_RANGES = 8 << 20, 4096
#: Documents, about, whose anchors the splitters are taken from, and anchors of each.
SAMPLE_DOCS, SAMPLE_EACH = 400, 256
#: Parts of the documents, for each shuffle partition, whose spans are united at once.
PARTS = 4
FLAG = np.uint32(1 << 31)


def _pack(data: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes, first, last): window starts first..last have the anchor; none in short texts."""
    n = len(data) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    powers, h, size = {1: BASE}, {1: data.astype(np.uint64) + np.uint64(1)}, 1
    with np.errstate(over="ignore"):
        while 2 * size <= gram:
            h[2 * size] = h[size][:-size] * powers[size] + h[size][size:]
            powers[2 * size] = powers[size] * powers[size]
            size *= 2
        made, width = h[size], size
        for k in sorted(h, reverse=True):
            if width + k <= gram:
                m = len(data) - width - k + 1
                made = made[:m] * powers[k] + h[k][width : width + m]
                width += k
    hashes = mix(made)
    keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(hashes), dtype=np.uint64))
    span, reach, least = length - gram + 1, 1, keys
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[:n], least[span - reach : span - reach + n])
    opens = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    at = (np.uint64(0xFFFFFFFF) - (least[opens] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    return at, hashes[at], opens, np.append(opens[1:], n) - 1


def leading(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as one big-endian character."""
    if not len(at):
        return np.zeros(0, np.uint64)
    view = np.ndarray((len(data) - 7,), ">u8", np.ascontiguousarray(data), strides=(1,))
    return view[at].astype(np.uint64)


def multikey_groups(columns: list[np.ndarray]) -> np.ndarray:
    """The group of each row: rows are equal in all columns if and only if their groups are.

    Multikey quicksort by whole columns: rows are parted by the first character, and only those
    that share it with another go on to the next one.
    """
    n = len(columns[0]) if columns else 0
    group = np.zeros(n, np.int64)
    live, fresh = np.arange(n), 1
    for column in columns:
        if not len(live):
            break
        value = column[live]
        order = np.lexsort((value, group[live]))
        g, v = group[live][order], value[order]
        opens = np.concatenate([[True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])])
        number = np.cumsum(opens) - 1
        group[live[order]] = fresh + number
        fresh += int(number[-1]) + 1
        sizes = np.bincount(number)
        live = live[order][sizes[number] > 1]
    return group


# --- 1: which anchors repeat --------------------------------------------------------------------

SENT = "bucket int, chunk bigint, payload binary, doc_ids array<bigint>, ties array<bigint>, starts array<bigint>"
SENT_NAMES = [x.split()[0] for x in SENT.split(", ")]


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=SENT_NAMES)


def _send_anchors(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, most=LARGE_CHUNK):
        data, at = raw(batch.column(1))
        places, hashes = [], []
        for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
            p, h, _, _ = anchors(data[a:b])
            places.append(p + a)
            hashes.append(h)
        place, h = np.concatenate(places), np.concatenate(hashes)
        if not len(place):
            continue
        ids, ties = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        chunk = xxhash.xxh64_intdigest(np.array([*ids, *ties], np.int64).tobytes()) - (1 << 63)
        _, first, inverse, counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        rows = [(chunk % buckets, chunk, None, ids, ties, at[:-1].tolist())]
        known = np.sort(place[counts[inverse] > 1])
        if len(known):
            rows.append((chunk % buckets, chunk, known.astype("<u4").tobytes(), None, None, None))
        first.sort()
        flags = np.where(counts[inverse[first]] > 1, FLAG, np.uint32(0))
        bucket = (h[first] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        held, tagged = h[first][order], (place[first].astype(np.uint32) | flags)[order]
        planes = np.ascontiguousarray(held.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, 4:]
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            x, y = cuts[b], cuts[b + 1]
            spots = tagged[x:y].astype("<u4").view(np.uint8).reshape(-1, 4)
            rows.append((b, chunk, _pack(np.ascontiguousarray(np.concatenate([planes[x:y], spots], 1).T)), [], None, None))
        yield _sent(rows)


def _answer_bucket(held: list[tuple[int, bytes]]) -> Iterator[tuple]:
    planes = [np.frombuffer(_unpack(p), np.uint8).reshape(8, -1).T for _, p in held]
    sizes = [len(p) for p in planes]
    every = np.concatenate(planes)
    # four bytes of each hash: in a bucket of bounded size few others share them, and those are told apart later
    codes, spots = (np.ascontiguousarray(every[:, k : k + 4]).view("<u4").ravel() for k in (0, 4))
    _, inverse, counts = np.unique(codes, return_inverse=True, return_counts=True)
    shared = (counts[inverse] > 1) & (spots & FLAG == 0)
    first = 0
    for (chunk, _), n in zip(held, sizes, strict=True):
        some = spots[first : first + n][shared[first : first + n]]
        first += n
        if len(some):
            yield (0, chunk, some.astype("<u4").tobytes(), None, None, None)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict]]:
    for batch in batches:
        for row in batch.to_pylist():
            yield row["bucket"], row


def _answer_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, held = None, []
    for bucket, row in _by_bucket(batches):
        if bucket != now:
            if held and (rows := [*_answer_bucket(held)]):
                yield _sent(rows)
            now, held = bucket, []
        if row["doc_ids"] == []:
            held.append((row["chunk"], row["payload"]))
        else:  # a chunk's documents, or what it has settled itself
            yield _sent([tuple(row[k] for k in SENT_NAMES)])
    if held and (rows := [*_answer_bucket(held)]):
        yield _sent(rows)


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            table = next(x for x in row["sent"] if x["doc_ids"])
            spots = np.concatenate([np.frombuffer(x["payload"], "<u4") for x in row["sent"] if x["payload"] is not None] or [np.zeros(0, np.uint32)])
            spots.sort()
            starts = np.array(table["starts"], np.int64)
            cuts = np.append(np.searchsorted(spots, starts), len(spots))
            some = np.flatnonzero(np.diff(cuts))
            if len(some):
                held = [(spots[cuts[k] : cuts[k + 1]] - starts[k]).astype("<u4").tobytes() for k in some.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([table["doc_ids"][k] for k in some.tolist()], pa.int64()), pa.array([table["ties"][k] for k in some.tolist()], pa.int64()), pa.array(held, pa.binary())], names=["a_id", "a_tie", "spots"])


# --- 2: the strings around them ------------------------------------------------------------------

STRINGS = "bucket int, doc_ids binary, ties binary, starts binary, anchors binary, sizes binary, strings binary, done boolean"
STRING_NAMES = [x.split()[0] for x in STRINGS.split(", ")]


def _strings(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.binary()] * 6, pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=STRING_NAMES)


def _packed(bucket: int, entries: list[tuple], done: bool) -> tuple:
    ids, ties, starts, places, strings = zip(*entries, strict=True)
    sizes = [len(s) if isinstance(s, bytes) else s for s in strings]
    return (bucket, np.array(ids, "<i8").tobytes(), np.array(ties, "<i8").tobytes(), np.array(starts, "<u4").tobytes(), np.array(places, "<u2").tobytes(), np.array(sizes, "<u4").tobytes(), b"" if done else _pack(b"".join(strings)), done)


def _send_strings(batches: Iterator[pa.RecordBatch], splitters: np.ndarray, subs: int) -> Iterator[pa.RecordBatch]:
    """batch: doc_id, text, tie, spots. A string seen in the chunk under a smaller id is done."""
    for batch in chunks(batches, most=LARGE_CHUNK):
        data, at = raw(batch.column(1))
        ids, ties, spots = (batch.column(k).to_pylist() for k in (0, 2, 3))
        seen: dict[bytes, int] = {}
        sent: dict[int, list[tuple]] = {}
        done: list[tuple] = []
        for k in sorted(range(len(ids)), key=ids.__getitem__):
            doc = data[at[k] : at[k + 1]]
            held = doc.tobytes()
            p, h, first, last = anchors(doc)
            some = np.flatnonzero(np.isin(p, np.frombuffer(spots[k], "<u4")))
            ranges = np.searchsorted(splitters, leading(doc, p[some]), side="right") * subs + (h[some] % np.uint64(subs)).astype(np.int64)
            for q, a, b, to in zip(p[some].tolist(), first[some].tolist(), (last[some] + LENGTH).tolist(), ranges.tolist(), strict=True):
                string = held[a:b]
                if seen.setdefault(string, ids[k]) < ids[k]:
                    done.append((ids[k], ties[k], a, q - a, b - a))
                else:
                    sent.setdefault(to, []).append((ids[k], ties[k], a, q - a, string))
        rows = [_packed(to, entries, False) for to, entries in sent.items()]
        if done:  # settled already: any bucket passes it on
            rows.append(_packed(int(mix(np.array([done[0][0]]))[0] % np.uint64((len(splitters) + 1) * subs)), done, True))
        if rows:
            yield _strings(rows)


REMOVED = "part int, r_ids binary, r_ties binary, counts binary, spans binary"
REMOVED_NAMES = [x.split()[0] for x in REMOVED.split(", ")]


def _spans(ids: np.ndarray, ties: np.ndarray, starts: np.ndarray, ends: np.ndarray, parts: int) -> pa.RecordBatch:
    """The spans of many documents, united and packed in one row for each part of the documents."""
    part = (mix(ids ^ ties) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((starts, ties, ids, part))
    ids, ties, starts, ends, part = ids[order], ties[order], starts[order].astype(np.int64), ends[order].astype(np.int64), part[order]
    opens = np.concatenate([[True], (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1])])
    doc = np.cumsum(opens) - 1
    reach = np.maximum.accumulate((doc << 33) + ends)
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] << 33) + starts[1:] > reach[:-1]]))
    held = np.stack([starts[first], reach[np.append(first[1:], len(ids)) - 1] - (doc[first] << 33)], 1).astype("<u4")
    at = np.flatnonzero(opens)
    counts = np.bincount(doc[first])
    after = np.concatenate([[0], np.cumsum(counts)])
    edges = np.flatnonzero(np.concatenate([[True], part[at][1:] != part[at][:-1], [True]]))
    rows = []
    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = at[x:y]
        rows.append((int(part[own[0]]), ids[own].astype("<i8").tobytes(), ties[own].astype("<i8").tobytes(), (2 * counts[x:y]).astype("<u4").tobytes(), held[after[x] : after[y]].tobytes()))
    kinds = [pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=REMOVED_NAMES)


def _unite_part(rows: list[dict]) -> pa.RecordBatch:
    ids, ties, counts = (np.concatenate([np.frombuffer(r[name], kind) for r in rows]) for name, kind in (("r_ids", "<i8"), ("r_ties", "<i8"), ("counts", "<u4")))
    ends = np.cumsum(counts.astype(np.int64))
    every = np.concatenate([np.frombuffer(r["spans"], "<u4") for r in rows])
    found: dict[tuple[int, int], list[bytes]] = {}
    for i, t, a, b in zip(ids.tolist(), ties.tolist(), (ends - counts).tolist(), ends.tolist(), strict=True):
        found.setdefault((i, t), []).append(every[a:b].tobytes())
    held = [[np.array(united(x), "<u4").tobytes()] for x in found.values()]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([t for _, t in found], pa.int64()), pa.array(held, pa.list_(pa.binary()))], names=["r_id", "r_tie", "spans"])


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != now and held:
                yield _unite_part(held)
                held = []
            now = row["part"]
            held.append(row)
    if held:
        yield _unite_part(held)


def suffix_runs(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The run of each suffix: in sorted order, suffixes whose neighbours have ``length`` bytes in common."""
    places = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    return multikey_groups([leading(data, at + k) for k in places])


def least_in(run: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row the least id of its run."""
    _, inverse = np.unique(run, return_inverse=True)
    out = np.full(int(inverse.max()) + 1 if len(inverse) else 0, np.iinfo(np.int64).max)
    np.minimum.at(out, inverse, ids)
    return out[inverse]


def repeat_ranges(firsts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of firsts[k], firsts[k] + 1, ... counts[k] times for each row k."""
    ends = np.cumsum(counts)
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.repeat(firsts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def _settle(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, ties, starts, ends): what the strings of one bucket lose, as they occur under a smaller id.

    The suffixes at anchors are sorted first: a string whose anchor no other string has is repeated
    whole or not at all. Where different strings share one, the suffixes at all their places are
    sorted; those with LENGTH bytes in common with their neighbour are one run, which its least
    doc_id keeps.
    """
    def column(name: str, kind: str) -> np.ndarray:
        return np.concatenate([np.frombuffer(r[name], kind) for r in rows])

    ids, ties, starts, places, sizes = column("doc_ids", "<i8"), column("ties", "<i8"), column("starts", "<u4").astype(np.int64), column("anchors", "<u2").astype(np.int64), column("sizes", "<u4").astype(np.int64)
    held = b"".join(_unpack(r["strings"]) for r in rows)
    ends = np.cumsum(sizes)
    data = np.frombuffer(held, np.uint8)
    # equal strings are one: its occurrences differ in their documents only
    strings = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(held)])
    which = strings.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    _, one = np.unique(which, return_index=True)
    begins = (ends - sizes)[one]
    keeper = least_in(which, ids)
    anchor = suffix_runs(data, begins + places[one], GRAM)
    _, group, members = np.unique(anchor, return_inverse=True, return_counts=True)
    alone = members[group] == 1
    whole = alone[which] & (ids > keeper)
    several = np.flatnonzero(~alone)
    windows = np.where(alone, 0, sizes[one] - LENGTH + 1)
    _, at = repeat_ranges(begins[several], windows[several])
    run = suffix_runs(data, at, LENGTH)
    first = np.cumsum(windows) - windows
    least = least_in(run, np.repeat(keeper[one][several], windows[several]))
    entry = np.flatnonzero(~alone[which])
    row, place = repeat_ranges(first[which[entry]], windows[which[entry]])
    lost = least[place] < ids[entry][row]
    # neighbouring lost places are one span
    opens = lost & np.concatenate([[True], ~lost[:-1] | (row[1:] != row[:-1])]) if len(lost) else lost
    closes = lost & np.concatenate([~lost[1:] | (row[1:] != row[:-1]), [True]]) if len(lost) else lost
    a, b = np.flatnonzero(opens), np.flatnonzero(closes)
    own = entry[row[a]]
    offset = first[which[own]]
    return (np.concatenate([ids[whole], ids[own]]), np.concatenate([ties[whole], ties[own]]),
            np.concatenate([starts[whole], starts[own] + place[a] - offset]), np.concatenate([(starts + sizes)[whole], starts[own] + place[b] - offset + LENGTH]))


def _settle_strings(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    now, held = None, []
    for bucket, row in _by_bucket(batches):
        if bucket != now:
            if held and len((lost := _settle(held))[0]):
                yield _spans(*lost, parts)
            now, held = bucket, []
        if row["done"]:
            ids, ties, starts, sizes = (np.frombuffer(row[k], x) for k, x in (("doc_ids", "<i8"), ("ties", "<i8"), ("starts", "<u4"), ("sizes", "<u4")))
            yield _spans(ids, ties, starts, starts + sizes, parts)
        else:
            held.append(row)
    if held and len((lost := _settle(held))[0]):
        yield _spans(*lost, parts)


# --- 3: what is left -----------------------------------------------------------------------------


def united(spans: list[bytes]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that any span covers."""
    if not spans:
        return []
    pairs = np.concatenate([np.frombuffer(x, "<u4") for x in spans]).reshape(-1, 2).astype(np.int64)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    opens = np.concatenate([[True], pairs[1:, 0] > reach[:-1]])
    at = np.flatnonzero(opens)
    return list(zip(pairs[at, 0].tolist(), reach[np.append(at[1:], len(pairs)) - 1].tolist(), strict=True))


def splitters_of(docs: DataFrame, n: int, ranges: int) -> np.ndarray:
    """Leading characters that part the sampled anchors' suffixes evenly; documents are chosen by hash.

    Texts stay where they are: at most SAMPLE_EACH characters a document come to the driver.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            data, at = raw(batch.column(0))
            found = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = leading(data[a:b], anchors(data[a:b])[0])
                found.append(own[np.unique(np.linspace(0, len(own) - 1, SAMPLE_EACH).astype(int))] if len(own) > SAMPLE_EACH else own)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["lead"])

    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // SAMPLE_DOCS))) == 0).select("text")
    every = np.sort(chosen.mapInArrow(run, "lead bigint").toArrow().column(0).to_numpy().view(np.uint64))
    return np.unique(every[np.linspace(0, len(every) - 1, ranges + 1).astype(int)[1:-1]]) if len(every) else every


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), spans: the byte runs [start, end) that go, for every row.

    A row without a doc_id loses nothing and takes nothing. Rows of one doc_id take nothing from
    each other. Texts under LENGTH bytes and empty tables are as they are.
    """
    spark = docs.sparkSession
    # no cast where none is needed: it would set the two uses of ``known`` apart, and both be shuffled
    doc_id = "doc_id" if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("bigint").alias("doc_id")
    plain = docs.select(doc_id, F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    n, total = plain.agg(F.count("doc_id"), F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()
    buckets = max(16, -(-total // BUCKET_BYTES))
    ranges = min(buckets, MOST_RANGES)
    subs = -(-buckets // ranges)
    known = plain.where("doc_id IS NOT NULL")
    splitters = spark.sparkContext.broadcast(splitters_of(known, n, ranges))  # at most MOST_RANGES numbers
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = known.mapInArrow(lambda it: _send_anchors(it, buckets), SENT)
    answers = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer_anchors, SENT)
    grouped = answers.groupBy("chunk").agg(F.collect_list(F.struct("payload", "doc_ids", "ties", "starts")).alias("sent"))
    spots = grouped.mapInArrow(_by_document, "a_id bigint, a_tie bigint, spots binary")
    # repeated rows of a document were answered alike, once each
    spots = spots.dropDuplicates(["a_id", "a_tie"])
    met = known.join(spots, (F.col("doc_id") == F.col("a_id")) & (F.col("tie") == F.col("a_tie"))).select("doc_id", "text", "tie", "spots")
    strings = met.mapInArrow(lambda it: _send_strings(it, splitters.value, subs), STRINGS)
    lost = strings.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _settle_strings(it, parts * PARTS), REMOVED)
    lost = lost.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_unite, "r_id bigint, r_tie bigint, spans array<binary>")
    # the same exchange of ``known`` by (doc_id, tie) as above, which Spark runs once
    cut = known.join(lost, (F.col("doc_id") == F.col("r_id")) & (F.col("tie") == F.col("r_tie")), "left").select("doc_id", "text", "spans")
    return cut.unionByName(plain.where("doc_id IS NULL").select("doc_id", "text", F.lit(None).cast("array<binary>").alias("spans")))


def suffix_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    kind = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            data, at = raw(batch.column(1))
            held, rows = data.tobytes(), []
            for a, b, spans in zip(at[:-1].tolist(), at[1:].tolist(), batch.column(2).to_pylist(), strict=True):
                runs, digest, last = united(spans or []), hashlib.sha256(), a
                for x, y in runs:
                    digest.update(held[last : a + x])
                    last = a + y
                digest.update(held[last:b])
                rows.append((b - a, sum(y - x for x, y in runs), len(runs), digest.hexdigest()))
            n_bytes, n_removed, n_spans, digests = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests)], names=[x.split()[0] for x in kind.split(", ")])

    return removed(docs).mapInArrow(run, kind)
