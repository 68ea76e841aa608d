"""Exact and near duplicates of intake payloads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.functions import fields as C
from paperloom.functions import tables as V
from paperloom.operators.carry import last_before
from paperloom.operators.closest import closest


#: Bits of whole fingerprints.
WIDE_BITS = 256


def exact_duplicates(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """seq, sha, duplicate_of: the latest earlier document of the same content (seq, content), null for the first.

    Keyed by the content's hash and carried along seq, so that a content that many documents hold is
    in as many tasks as it is worth.
    """
    hashed = docs.select("seq", F.sha2("content", 256).alias("sha"))
    return last_before(hashed, ["sha"], "seq", {"duplicate_of": F.col("seq")}, blocks)


def fingerprints(vectors: DataFrame, bits: int = 63) -> DataFrame:
    """seq, label, vec, fp: the difference hash of each vector's first bits + 1 elements."""
    return vectors.withColumn("fp", C.difference_hash(F.col("vec"), bits + 1))


def changed_cells(a: Column, b: Column, delta: float) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d > delta))


def band(fp: Column, k: int, bands: int, bits: int = 64) -> Column:
    """The k-th of ``bands`` runs of bits, their width as even as can be."""
    first, last = k * bits // bands, (k + 1) * bits // bands
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << (last - first)) - 1))


def candidate_pairs(prints: DataFrame, threshold: int = V.HAMMING_THRESHOLD, same_label: bool | None = None) -> DataFrame:
    """(seq, cand, distance) of each document with earlier ones within ``threshold`` bits.

    threshold + 1 bands: two fingerprints within the threshold agree in one of them at least, so an
    equi-join by band finds all pairs. A pair is made in the first band that it agrees in, once.
    With ``same_label`` only pairs of equal labels, or of different ones, are made.
    """
    bands = threshold + 1
    banded = prints.select("seq", "fp", *(["label"] if same_label is not None else []), F.posexplode(F.array(*[band(F.col("fp"), k, bands) for k in range(bands)])).alias("band", "bits"))
    a, b = banded.alias("a"), banded.alias("b")
    same = [band(F.col("a.fp"), k, bands) == band(F.col("b.fp"), k, bands) for k in range(bands)]
    first = F.expr("0")
    for k in range(bands - 1, -1, -1):
        first = F.when(same[k], k).otherwise(first)
    distance = C.hamming(F.col("a.fp"), F.col("b.fp"))
    on = (F.col("a.band") == F.col("b.band")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("b.seq") < F.col("a.seq")) & (distance <= threshold) & (F.col("a.band") == first)
    if same_label is not None:
        on = on & (F.col("a.label").eqNullSafe(F.col("b.label")) == F.lit(same_label))
    met = a.join(b, on)
    return met.select(F.col("a.seq").alias("seq"), F.col("b.seq").alias("cand"), distance.cast("bigint").alias("distance"))


def near_duplicates(prints: DataFrame, threshold: int = V.HAMMING_THRESHOLD, delta: float = 0.5, cutoff: int = V.PIXEL_CUTOFF) -> DataFrame:
    """seq, duplicate_of, distance: the nearest earlier candidate, of equals the earliest, that the cells confirm."""
    pairs = candidate_pairs(prints, threshold)
    left, right = prints.select("seq", F.col("vec").alias("va")), prints.select(F.col("seq").alias("cand"), F.col("vec").alias("vb"))
    sure = pairs.join(left, "seq").join(right, "cand").where(changed_cells(F.col("va"), F.col("vb"), delta) <= cutoff)
    best = sure.groupBy("seq").agg(F.min(F.struct("distance", "cand")).alias("best"))
    return best.select("seq", F.col("best.cand").alias("duplicate_of"), F.col("best.distance").alias("distance"))


def ranked_candidates(prints: DataFrame, threshold: int = V.HAMMING_THRESHOLD) -> DataFrame:
    w = W.partitionBy("seq").orderBy("distance", "cand")
    return candidate_pairs(prints, threshold).withColumn("rank", F.row_number().over(w).cast("bigint"))


def calibration(prints: DataFrame, same_band: int = V.HAMMING_THRESHOLD) -> DataFrame:
    """Least distance within ``same_band`` bits, and pairs, of equal and of different labels."""
    pairs = candidate_pairs(prints, same_band)
    label = prints.select("seq", "label")
    named = pairs.join(label.withColumnRenamed("label", "la"), "seq").join(label.withColumnsRenamed({"seq": "cand", "label": "lb"}), "cand")
    return named.groupBy((F.col("la") == F.col("lb")).alias("same_label")).agg(F.min("distance").alias("floor"), F.max("distance").alias("ceiling"), F.count("*").alias("pairs"))


def closest_pairs(prints: DataFrame, k: int = 6, threshold: int = V.HAMMING_THRESHOLD) -> DataFrame:
    return candidate_pairs(prints, threshold).orderBy("distance", "seq", "cand").limit(k)


def _few(prints: DataFrame, k: int) -> DataFrame:
    """Of documents with one fingerprint and label the k + 1 least seqs: no others are in the k first pairs."""
    by = ["fp", "label"]
    few = prints.select("seq", *by).withColumn("salt", F.pmod(F.xxhash64("seq"), F.lit(64)))
    for keys in ([*by, "salt"], by):
        few = few.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy("seq"))).where(F.col("nth") <= k + 1)
    return few.select("seq", *by)


def closest_by_label(prints: DataFrame, k: int = 6, bits: int = 64, wide: bool = False, told: dict | None = None) -> DataFrame:
    """same_label, rank, seq, cand, distance: the k closest of all pairs of equal and of different labels.

    Exact, by rings of blocks of bits or all pairs in squares (``closest``); ``wide`` fingerprints are arrays of four words.
    """
    value, distance = (C.wide_band, C.wide_hamming) if wide else (lambda fp, i, m: band(fp, i, m, bits), C.hamming)
    few, made = _few(prints, k), []
    for same in (True, False):
        seen: dict = {}
        found = closest(few, k, WIDE_BITS if wide else bits, value, distance, F.col("fp") if wide else F.array("fp"), same, seen)
        made += [(same, n + 1, seq, cand, far) for n, (far, seq, cand) in enumerate(found)]
        if told is not None:
            told[same] = seen
    return prints.sparkSession.createDataFrame(made, "same_label boolean, rank bigint, seq bigint, cand bigint, distance bigint")


def pairs_by_label(prints: DataFrame) -> DataFrame:
    """same_label, pairs: how many pairs of equal and of different labels there are, both rows always."""
    sizes = prints.groupBy("label").agg(F.count("*").cast("decimal(38, 0)").alias("n"))
    sums = sizes.agg(F.coalesce(F.sum(F.expr("n * (n - 1) / 2")), F.lit(0)).cast("bigint").alias("same"), F.coalesce(F.sum("n"), F.lit(0)).cast("decimal(19, 0)").alias("n"))
    return sums.selectExpr("stack(2, true, same, false, cast(n * (n - 1) / 2 AS bigint) - same) AS (same_label, pairs)")


def floors(prints: DataFrame, threshold: int = V.HAMMING_THRESHOLD) -> DataFrame:
    """same_label, floor, pairs over all pairs, and for different labels whether the threshold is below the floor.

    A floor is null where there is no pair. Equal labels have no such check: the hash can't separate them.
    """
    least = closest_by_label(prints, 1).select("same_label", F.col("distance").alias("floor"))
    out = pairs_by_label(prints).join(least, "same_label", "left")
    return out.select("same_label", "floor", "pairs", F.when(~F.col("same_label"), F.lit(threshold) < F.col("floor")).alias("threshold_below"))


def cleared_references(flags: DataFrame, deleted: DataFrame) -> DataFrame:
    """Flags (seq, duplicate_of) without those of deleted documents (id); references to them become null."""
    left = flags.join(deleted, F.col("seq") == F.col("id"), "left_anti")
    gone = deleted.select(F.col("id").alias("gone_id"))
    joined = left.join(gone, F.col("duplicate_of") == F.col("gone_id"), "left")
    return joined.select("seq", F.when(F.col("gone_id").isNull(), F.col("duplicate_of")).alias("duplicate_of"))


# --- whole fingerprints: 256 bits in four words ---------------------------------------------------


def wide_prints(vectors: DataFrame, hashed: Column | None = None) -> DataFrame:
    """``vectors`` with ``fp`` (array<bigint> of four words), by default of a 17-column grid of cells (``cells``)."""
    return vectors.withColumn("fp", C.grid_hash(F.col("cells")) if hashed is None else hashed)


def wide_links(prints: DataFrame, threshold: int = V.HAMMING_THRESHOLD, same_label: bool | None = None) -> DataFrame:
    """(seq, cand, distance) of distinct fingerprints within ``threshold`` of 256 bits, each by its least seq, the later one first.

    threshold + 1 bands (15 bits and more at 16): two such fingerprints agree in one at least. With
    ``same_label`` only those of equal labels, or of different ones, are linked.
    """
    bands = threshold + 1
    by = ["fp", *(["label"] if same_label is not None else [])]
    nodes = prints.groupBy(*by).agg(F.min("seq").alias("node"))
    banded = nodes.select("node", *by, F.posexplode(F.array(*[C.wide_band(F.col("fp"), k, bands) for k in range(bands)])).alias("band", "bits"))
    a, b = banded.alias("a"), banded.alias("b")
    first = F.expr("0")
    for k in range(bands - 1, -1, -1):
        first = F.when(C.wide_band(F.col("a.fp"), k, bands) == C.wide_band(F.col("b.fp"), k, bands), k).otherwise(first)
    distance = C.wide_hamming(F.col("a.fp"), F.col("b.fp"))
    on = (F.col("a.band") == F.col("b.band")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("b.node") < F.col("a.node")) & (distance <= threshold) & (F.col("a.band") == first)
    if same_label is not None:
        on = on & (F.col("a.label").eqNullSafe(F.col("b.label")) == F.lit(same_label))
    return a.join(b, on).select(F.col("a.node").alias("seq"), F.col("b.node").alias("cand"), distance.cast("bigint").alias("distance"))


def wide_nearest(prints: DataFrame, threshold: int = V.HAMMING_THRESHOLD) -> DataFrame:
    """seq, duplicate_of, distance: the nearest earlier document within ``threshold`` bits, of equals the earliest.

    The first document of a fingerprint has those of others, later ones have that first one: no pairs of copies.
    """
    nodes = prints.groupBy("fp").agg(F.min("seq").alias("node"))
    best = wide_links(prints, threshold).groupBy("seq").agg(F.min(F.struct("distance", "cand")).alias("best"))
    first = best.select("seq", F.col("best.cand").alias("duplicate_of"), F.col("best.distance").alias("distance"))
    later = prints.select("seq", "fp").join(nodes, "fp").where("seq > node").select("seq", F.col("node").alias("duplicate_of"), F.lit(0).cast("bigint").alias("distance"))
    return first.union(later)


def wide_floor(prints: DataFrame) -> DataFrame:
    """same_label, floor: the least distance of documents of equal and of different labels, over all pairs.

    A class without pairs has no row.
    """
    return closest_by_label(prints, 1, wide=True).select("same_label", F.col("distance").alias("floor"))


def calibration_checks(prints: DataFrame, variants: list[Callable[[Column], Column]], threshold: int = V.HAMMING_THRESHOLD, delta: float = 0.5, cutoff: int = V.PIXEL_CUTOFF, k: int = 6) -> DataFrame:
    """check, value, passes: whether threshold and cutoff part copies from different documents (seq, label, vec, fp).

    copies_band: the most bits in which a document's variants differ from it, at most the threshold.
    cross_floor: the least distance of different labels, over the threshold. copies_cells: the most
    cells that a variant changes by over ``delta``, at most the cutoff. distinct_cells: the least such
    cells of the k closest pairs of one label, over the cutoff. Without rows a value is null.
    """
    changed = prints.select("vec", "fp", F.explode(F.array(*[v(F.col("vec")) for v in variants])).alias("made"))
    told = changed.agg(F.max(C.hamming(F.col("fp"), C.difference_hash(F.col("made")))).cast("bigint").alias("copies_band"), F.max(changed_cells(F.col("vec"), F.col("made"), delta)).cast("bigint").alias("copies_cells"))
    closest_ = closest_by_label(prints, k)
    cross = closest_.where("NOT same_label").agg(F.min("distance").alias("cross_floor"))
    left, right = prints.select("seq", F.col("vec").alias("va")), prints.select(F.col("seq").alias("cand"), F.col("vec").alias("vb"))
    some = F.broadcast(closest_.where("same_label").select("seq", "cand"))  # k rows
    distinct = some.join(left, "seq").join(right, "cand").agg(F.min(changed_cells(F.col("va"), F.col("vb"), delta)).cast("bigint").alias("distinct_cells"))
    one = told.crossJoin(cross).crossJoin(distinct)  # single rows
    rows = one.selectExpr("stack(4, 'copies_band', copies_band, 'cross_floor', cross_floor, 'copies_cells', copies_cells, 'distinct_cells', distinct_cells) AS (check, value)")
    passes = F.when(F.col("check") == "copies_band", F.col("value") <= threshold).when(F.col("check") == "cross_floor", F.col("value") > threshold).when(F.col("check") == "copies_cells", F.col("value") <= cutoff).otherwise(F.col("value") > cutoff)
    return rows.withColumn("passes", passes)


def calibrated(floors: DataFrame, threshold: int = V.HAMMING_THRESHOLD) -> DataFrame:
    """floors with ``passes``: copies must be within the threshold, different documents beyond it."""
    return floors.withColumn("passes", F.when(F.col("same_label"), F.col("floor") <= threshold).otherwise(F.col("floor") > threshold))
