"""Scoring of extracted fields against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import fields as C


def field_scores(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """file, key, expected, predicted, verdict for each labelled field; a prediction may be missing."""
    joined = truth.join(predicted, ["file", "key"], "left")
    return joined.select("file", "key", "expected", "predicted", C.score_field(F.col("expected"), F.col("predicted")).alias("verdict"), *[c for c in ("low_confidence",) if c in joined.columns])


def summary(scores: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: counts of fields and documents, silent errors, how many of them were flagged, median latency.

    scores: file, key, verdict, low_confidence; runs: file, expected_type, predicted_type, latency_s.
    """
    wrong = F.col("verdict") == "wrong"
    flagged = F.coalesce("low_confidence", F.lit(False))
    f = scores.agg(
        F.count("*").alias("fields"), F.count_if(F.col("verdict") == "correct").alias("fields_correct"), F.count_if(wrong).alias("silent_wrong"),
        F.count_if(F.col("verdict") == "missing").alias("fields_missing"), F.count_if(wrong & flagged).alias("silent_wrong_flagged"),
        F.count_if((F.col("verdict") != "correct") & flagged).alias("errors_flagged"),
    )
    hand = F.lower("file").contains("hand")
    d = runs.agg(F.count("*").alias("docs"), F.count_if(F.col("expected_type") == F.col("predicted_type")).alias("types_correct"), F.percentile("latency_s", F.lit(0.5)).alias("median_latency_s"), F.count_if(hand).alias("hand_docs"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return f.crossJoin(F.broadcast(d)).select("*", ratio("fields_correct", "fields").alias("field_accuracy"), ratio("types_correct", "docs").alias("type_accuracy"))  # two single rows


def flag_coverage(scores: DataFrame) -> DataFrame:
    return scores.groupBy("verdict", F.coalesce("low_confidence", F.lit(False)).alias("flagged")).agg(F.count("*").alias("n"))


def ensemble_agreement(reads: DataFrame) -> DataFrame:
    """doc_id, agreed, disputed of two reads (key, a, b): a field is disputed unless the second read says the same."""
    agrees = C.fields_agree(F.col("key"), F.col("a"), F.col("b"))
    return reads.groupBy("doc_id").agg(F.count_if(agrees).alias("agreed"), F.count_if(~agrees).alias("disputed"))


def report(scores: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: everything an evaluation reports; rates to four places, null where there is nothing to divide.

    scores: file, verdict, low_confidence, disputed for each labelled field. runs: file, expected_type,
    predicted_type, latency_s, classify_only, hand, hand_ensemble for each document. Silent errors are
    fields that are there and wrong; the hand bucket is the documents marked ``hand``.
    """
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    field = scores.join(runs.select("file", "hand", "hand_ensemble"), "file").select(
        "verdict", (F.col("verdict") == "correct").alias("ok"), true("low_confidence").alias("flagged"), true("disputed").alias("disputed"), true("hand").alias("hand"), (true("hand") & true("hand_ensemble")).alias("read_twice"))
    n = lambda condition, name: F.count_if(F.expr(condition)).alias(name)
    f = field.agg(
        F.count("*").alias("field_total"), n("ok", "field_correct"), n("verdict = 'wrong'", "silent_wrong"), n("verdict = 'wrong' AND flagged", "silent_wrong_flagged"), n("NOT ok", "errors"), n("NOT ok AND flagged", "errors_flagged"),
        n("hand", "hand_field_total"), n("hand AND ok", "hand_field_correct"), n("hand AND NOT flagged", "hand_unflagged"),
        n("read_twice AND NOT disputed", "agreed"), n("read_twice AND NOT disputed AND ok", "agreed_correct"), n("read_twice AND disputed", "disputed"), n("read_twice AND disputed AND ok", "disputed_correct"))
    d = runs.agg(
        F.count("*").alias("docs"), F.count_if(F.col("expected_type") == F.col("predicted_type")).alias("types_correct"), F.count_if("classify_only").alias("classify_only_docs"),
        F.round(F.coalesce(F.percentile("latency_s", F.lit(0.5)), F.lit(0.0)), 2).alias("median_latency_s"), F.round(F.percentile(F.when(F.col("hand"), F.col("latency_s")), F.lit(0.5)), 2).alias("hand_median_latency_s"))
    rate = lambda a, b: F.round(F.try_divide(a, b), 4)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    both = f.crossJoin(F.broadcast(d))  # two single rows
    return both.select(
        "docs", "types_correct", zero(rate("types_correct", "docs")).alias("doc_type_accuracy"), "field_total", "field_correct", zero(rate("field_correct", "field_total")).alias("field_accuracy"), "classify_only_docs",
        "silent_wrong", "silent_wrong_flagged", rate("silent_wrong_flagged", "silent_wrong").alias("flag_coverage"), "errors", "errors_flagged", rate("errors_flagged", "errors").alias("flag_coverage_all"), "median_latency_s",
        "hand_field_total", "hand_field_correct", rate("hand_field_correct", "hand_field_total").alias("hand_field_accuracy"), F.when(F.col("hand_field_total") > 0, F.col("hand_unflagged") == 0).alias("hand_all_flagged"), "hand_median_latency_s",
        "agreed", "agreed_correct", rate("agreed_correct", "agreed").alias("agreement_precision"), "disputed", "disputed_correct", rate("disputed_correct", "disputed").alias("disputed_correct_rate"))
