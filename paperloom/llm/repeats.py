"""Substring dedup by unit hashing: repeated lines and sentences go, the earliest stays.

By default (``unit="all"``) units are lines of any word count, paragraphs of several lines, and runs
of neighbouring sentences of a line that just reach ``least_words`` words, from each sentence onwards
and back; sentences of over ``LONG`` words are also cut at word boundaries that the words before them
choose, and runs of those parts are units. Units overlap, and none depends on the text around it; what
is removed is their union. A unit that overlaps the kept one in its own document stays.

With the other kinds units don't overlap. A unit is a line, or with ``unit="sentence"`` a run of sentences of a line that has at least
``least_words`` words (a shorter sentence is joined to what follows; what is left at the line's end
is a unit of its own). With ``unit="paragraph"`` units end at blank lines. Units are normalised
(lower case, white space runs as one space, trimmed) and hashed to 128 bits. Of equal units
(of at least ``least_words`` words, lines of ``all`` apart) the one with the least (doc_id, position) is kept, over all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import chunks

LEAST_WORDS = 6
LINE = re.compile(r"[^\n]*\n|[^\n]+\Z")
BLANK = re.compile(r"\n(?:[^\S\n]*\n)+")
SENTENCE = re.compile(r".*?(?:[.!?。！？]+(?:\s+|\Z)|\Z)", re.DOTALL)
SENTENCE_END = re.compile(r"[.!?。！？]+(?:\s+|\Z)")
WORD = re.compile(r"\S+")
UNITS = ("line", "sentence", "paragraph")
#: Bytes of text whose units are pre-aggregated.
UNIT_CHUNK = 2 << 20
#: A sentence of more words has further cuts, after one word in CUT; its units have at least twice the least words.
LONG, CUT = 24, 8


def lines(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in LINE.finditer(text)]


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Spans that end with a blank line, or the text."""
    ends = [m.end() for m in BLANK.finditer(text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return list(zip([0, *ends], ends, strict=False))


def units(text: str, unit: str = "sentence", least_words: int = LEAST_WORDS) -> list[tuple[int, int, str, int]]:
    """(start, end, normalised unit, words) of all units; together they are the whole text."""
    out: list[tuple[int, int, str, int]] = []
    for start, end in (paragraphs if unit == "paragraph" else lines)(text):
        if unit != "sentence":
            ws = text[start:end].lower().split()
            out.append((start, end, " ".join(ws), len(ws)))
            continue
        first, held = start, []
        for s in SENTENCE.finditer(text, start, end):
            held += s[0].lower().split()
            if s.end() > first and (len(held) >= least_words or s.end() == end):
                out.append((first, s.end(), " ".join(held), len(held)))
                first, held = s.end(), []
    return out


def _runs(sizes: list[int], least: int) -> set[tuple[int, int]]:
    """(first, last) of the shortest runs of parts with ``least`` words, onwards and back from each part."""
    spans, last, held, n = set(), 0, 0, len(sizes)
    for first in range(n):
        while last < n and held < least:
            held += sizes[last]
            last += 1
        if held < least:
            break
        spans.add((first, last))
        held -= sizes[first]
    first, held = n, 0
    for last in range(n, 0, -1):
        while first > 0 and held < least:
            first -= 1
            held += sizes[first]
        if held < least:
            break
        spans.add((first, last))
        held -= sizes[last - 1]
    return spans


def _cuts(norm: bytes, at: list[int], first: int, last: int) -> list[int]:
    """Where a long sentence's parts end, in words: it is cut after a word if the hash of it and the two before it says so.

    ``norm`` is the normalised line and ``at`` where its words begin; the sentence has words first..last-1.
    """
    digest = xxhash.xxh3_64_intdigest
    return [k + 1 for k in range(first + 2, last - 1) if digest(norm[at[k - 2] : at[k + 1] - 1]) % CUT == 0] + [last]


def all_units(text: str, least_words: int = LEAST_WORDS) -> list[tuple[int, int, bytes]]:
    """(start, end, normalised unit in UTF-8) of lines, paragraphs and runs of sentences; they overlap."""
    out: set[tuple[int, int, bytes]] = set()
    for m in LINE.finditer(text):
        # lower-casing may change a word's length, never the words' number
        norm = " ".join(m[0].lower().split()).encode("utf-8", "surrogatepass")
        if not norm:
            continue
        out.add((m.start(), m.end(), norm))
        ws = norm.split(b" ")
        if len(ws) < least_words:
            continue
        at = [0, *accumulate([len(w) + 1 for w in ws])]
        ends = [s.end() for s in SENTENCE_END.finditer(text, m.start(), m.end())]
        if not ends or ends[-1] < m.end():
            ends.append(m.end())
        spans = list(zip([m.start(), *ends], ends, strict=False))
        sizes = [len(text[x:y].split()) for x, y in spans] if len(spans) > 1 else [len(ws)]
        first = [0, *accumulate(sizes)]
        for x, y in _runs(sizes, least_words):
            out.add((spans[x][0], spans[y - 1][1], norm[at[first[x]] : at[first[y]] - 1]))
        for k, n in enumerate(sizes):
            if n > LONG:
                cuts = [first[k], *_cuts(norm, at, first[k], first[k + 1])]
                begins = [w.start() for w in WORD.finditer(text, *spans[k])]
                begins.append(spans[k][1])
                for x, y in _runs([b - a for a, b in pairwise(cuts)], 2 * least_words):
                    out.add((begins[cuts[x] - first[k]], begins[cuts[y] - first[k]], norm[at[cuts[x]] : at[cuts[y]] - 1]))
    for a, b in paragraphs(text):
        held = text[a:b]
        if "\n" in held.strip() and len(ws := held.lower().split()) >= least_words:
            out.add((a, b, " ".join(ws).encode("utf-8", "surrogatepass")))
    return sorted(out)


def counted(text: str, unit: str, least_words: int) -> list[tuple[int, int, bytes]]:
    """(start, end, normalised unit) of the units that count."""
    if unit == "all":
        return all_units(text, least_words)
    return [(a, b, held.encode("utf-8", "surrogatepass")) for a, b, held, n in units(text, unit, least_words) if n >= least_words]


UNIT = "h1 bigint, h2 bigint, doc_id bigint, at int, to int, sure array<struct<at: int, to: int>>"
SPAN = pa.struct([("at", pa.int32()), ("to", pa.int32())])


def _chunk_units(ids: list[int], texts: list[str | None], unit: str, least_words: int) -> pa.RecordBatch:
    """Rows of UNIT: of each digest the least (doc_id, at) of the chunk, and what can't go for it alone.

    All other units of the chunk surely go, as they have one before them in another document or ended
    before them in their own: they travel by document (``sure``), under a digest of no unit.
    """
    first: dict[bytes, tuple[int, int, int]] = {}
    rows: list[tuple[bytes, int, int, int]] = []
    sure: dict[int, list[tuple[int, int]]] = {}
    digest = xxhash.xxh3_128_digest
    for k in sorted(range(len(ids)), key=ids.__getitem__):
        doc_id = ids[k]
        for a, b, held in counted(texts[k] or "", unit, least_words):
            d = digest(held)
            had = first.setdefault(d, (doc_id, a, b))
            if had == (doc_id, a, b) or had[0] == doc_id and a < had[2]:
                rows.append((d, doc_id, a, b))
            else:
                sure.setdefault(doc_id, []).append((a, b))
    keys = np.frombuffer(b"".join([d for d, *_ in rows] + [digest(f"{i} {len(rows)} {s}") for i, s in sure.items()]), "<i8").reshape(-1, 2)
    spans = pa.array([None] * len(rows) + [[{"at": a, "to": b} for a, b in s] for s in sure.values()], pa.list_(SPAN))
    at, to = ([r[n] for r in rows] + [0] * len(sure) for n in (2, 3))
    return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([r[1] for r in rows] + [*sure], pa.int64()), pa.array(at, pa.int32()), pa.array(to, pa.int32()), spans], names=["h1", "h2", "doc_id", "at", "to", "sure"])


def unit_table(docs: DataFrame, unit: str = "all", least_words: int = LEAST_WORDS) -> DataFrame:
    """The units that count, pre-aggregated by chunks of documents: h1, h2 (digest), doc_id, at, to (offsets in code points), sure."""
    if unit not in ("all", *UNITS):
        raise ValueError(f"unit is all or one of {UNITS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=UNIT_CHUNK):
            yield _chunk_units(batch.column(0).to_pylist(), batch.column(1).to_pylist(), unit, least_words)

    return docs.select(F.col("doc_id").cast("bigint"), "text").where("doc_id IS NOT NULL").mapInArrow(run, UNIT)


def repeated(docs: DataFrame, unit: str = "all", least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, ats (offsets at, to of the units to remove) for documents that have any.

    One shuffle by digest: in it a digest has one row for each chunk of documents that holds it, even
    where a third of all rows do, and the first in rank keeps it.
    """
    w = W.partitionBy("h1", "h2").orderBy("doc_id", "at", "to")
    ranked = unit_table(docs, unit, least_words).withColumns({"first_id": F.first("doc_id").over(w), "first_to": F.first("to").over(w)})
    gone = ranked.where("sure IS NOT NULL OR doc_id <> first_id OR at >= first_to")
    spans = F.coalesce("sure", F.array(F.struct("at", "to")))
    return gone.groupBy("doc_id").agg(F.flatten(F.collect_list(spans)).alias("ats"))


def removed(docs: DataFrame, unit: str = "all", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the repeated units cut out of ``text``, and ``removed_spans``.

    removed_spans has the original offsets [start, end) in code points, adjoining units as one span.
    Rows without an id rank nowhere and stay as they are; null texts stay null, ``n_chars`` (if
    there) follows the text. Rows of the same doc_id lose the units at offsets where any of them repeats one.
    A column of the name removed_spans is replaced.
    """
    plain = docs.drop("removed_spans")
    names = plain.columns
    at_text, at_size = names.index("text"), names.index("n_chars") if "n_chars" in names else -1
    slim = plain.toDF(*[f"c{k}" for k in range(len(names))])
    cuts = repeated(docs, unit, least_words).withColumnRenamed("doc_id", "cut_id")
    several = plain.groupBy(F.col("doc_id").cast("bigint").alias("cut_id")).agg((F.count("*") > 1).alias("several")).where("several")
    cuts = cuts.join(several, "cut_id", "left")
    joined = slim.join(cuts, F.col(f"c{names.index('doc_id')}").cast("bigint") == F.col("cut_id"), "left").select(*slim.columns, "ats", "several")
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*slim.schema.fields, T.StructField("removed_spans", spans)])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, ats, several = list(batch.columns[:-2]), batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            made: list[list[dict]] = [[] for _ in ats]
            texts, sizes = None, None
            for k, starts in enumerate(ats):
                if not starts:
                    continue
                if texts is None:
                    texts = columns[at_text].to_pylist()
                    sizes = columns[at_size].to_pylist() if at_size >= 0 else None
                gone, kept, last = {(x["at"], x["to"]) for x in starts}, [], 0
                if several[k]:  # rows of one doc_id may differ: each loses units of its own only
                    gone &= {(a, b) for a, b, _ in counted(texts[k] or "", unit, least_words)}
                for a, b in sorted(gone):
                    if made[k] and made[k][-1]["end"] >= a:
                        made[k][-1]["end"] = max(b, made[k][-1]["end"])
                    else:
                        made[k].append({"start": a, "end": b})
                for s in made[k]:
                    kept.append(texts[k][last : s["start"]])
                    last = s["end"]
                if made[k]:
                    texts[k] = "".join([*kept, texts[k][last:]])
                    if sizes is not None:
                        sizes[k] = len(texts[k])
            if texts is not None:
                columns[at_text] = pa.array(texts, columns[at_text].type)
                if sizes is not None:
                    columns[at_size] = pa.array(sizes, columns[at_size].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(made, kind)], names=schema.names)

    return joined.mapInArrow(run, schema).toDF(*names, "removed_spans")


def span_chars() -> Column:
    return F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def unit_report(docs: DataFrame, unit: str = "all", least_words: int = LEAST_WORDS) -> DataFrame:
    """Per document: doc_id, text (kept), removed_spans, n_spans, n_removed (code points), kept_sha256."""
    out = removed(docs.select("doc_id", "text"), unit, least_words)
    return out.select("doc_id", "text", "removed_spans", F.size("removed_spans").cast("long").alias("n_spans"), span_chars().alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
