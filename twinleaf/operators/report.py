"""Differences, quality, summary and recommendations of compared pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinleaf.config import DEFAULTS, Settings
from twinleaf.functions.text import ONLY_TEXTS, classify, severity, suggestions, verdict


def match_quality(pairs: DataFrame, matches: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Counts by class and mean similarity of the matches of every pair; zeros where it has none."""
    kind = classify(F.col("exact_match"), F.col("normalized_match"), F.col("similarity"), cfg)
    by_pair = (
        matches.withColumn("kind", kind)
        .groupBy("pair_id")
        .agg(
            F.count(F.lit(1)).alias("total_matches"),
            F.count_if(F.col("kind") == "exact_match").alias("exact_matches"),
            F.count_if(F.col("kind") == "minor_difference").alias("minor_differences"),
            F.count_if(F.col("kind") == "rewording").alias("rewordings"),
            F.count_if(F.col("kind") == "significant").alias("significant_differences"),
            F.avg("similarity").alias("avg_similarity"),
        )
    )
    return pairs.select("pair_id").join(by_pair, "pair_id", "left").na.fill(0)


def reorderings(matches: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Matches whose places lie more than twice the context window apart."""
    return matches.where(F.abs(F.col("index1") - F.col("index2")) > 2 * cfg.context_window).select(
        "pair_id", "match_rank", F.col("text1").alias("sentence"), F.col("index1").alias("expected_position"),
        F.col("index2").alias("actual_position"), (F.col("index2") - F.col("index1")).alias("displacement"),
    )


def differences(matches: DataFrame, only1: DataFrame, only2: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """All differences of the pairs, with their source (0 matches, 1 and 2 the sides) and order within it."""
    kind = classify(F.col("exact_match"), F.col("normalized_match"), F.col("similarity"), cfg)
    mismatch = matches.where(~F.col("exact_match")).select(
        "pair_id", F.lit(0).alias("source"), F.col("match_rank").alias("source_seq"), F.lit("mismatch").alias("type"),
        kind.alias("classification"), severity(kind).alias("severity"), (F.col("index1") + 1).alias("position1"),
        (F.col("index2") + 1).alias("position2"), F.col("text1").alias("sentence1"), F.col("text2").alias("sentence2"),
        "similarity", suggestions(F.col("text1"), F.col("text2")).alias("suggestions"),
    )

    def only(rows: DataFrame, side: int) -> DataFrame:
        place, nowhere = (F.col("sent_id") + 1), F.lit(None).cast("int")
        text, nothing = F.col("text"), F.lit(None).cast("string")
        return rows.select(
            "pair_id", F.lit(side).alias("source"), F.col("seq").alias("source_seq"),
            F.lit(f"missing_in_doc{3 - side}").alias("type"), F.lit("addition").alias("classification"),
            F.lit("high").alias("severity"), (place if side == 1 else nowhere).alias("position1"),
            (place if side == 2 else nowhere).alias("position2"), (text if side == 1 else nothing).alias("sentence1"),
            (text if side == 2 else nothing).alias("sentence2"), F.lit(0.0).alias("similarity"),
            F.array(F.lit(ONLY_TEXTS[side - 1])).alias("suggestions"),
        )

    return mismatch.unionByName(only(only1, 1)).unionByName(only(only2, 2))


def ordered_differences(rows: DataFrame) -> DataFrame:
    """``rows`` with ``place``: by first position, then second, unknown ones last; ties keep their source order."""
    w = Window.partitionBy("pair_id").orderBy(
        F.asc_nulls_last("position1"), F.asc_nulls_last("position2"), "source", "source_seq"
    )
    return rows.withColumn("place", F.row_number().over(w))


def match_score(sizes: DataFrame, matches: DataFrame) -> DataFrame:
    """Twice the matches over all units of both sides; 0 where both are empty."""
    n = matches.groupBy("pair_id").agg(F.count(F.lit(1)).alias("matched"))
    rows = sizes.join(n, "pair_id", "left").na.fill(0, ["matched"])
    total = F.col("n1") + F.col("n2")
    score = F.when(total > 0, (F.col("matched") * 2).cast("double") / total.cast("double")).otherwise(F.lit(0.0))
    return rows.withColumn("match_score", score)


def summary(scores: DataFrame, quality: DataFrame, moved: DataFrame) -> DataFrame:
    """One row of figures per pair. A sentence missing in one document is present only in the other."""
    m = moved.groupBy("pair_id").agg(F.count(F.lit(1)).alias("reorderings_detected"))
    only1, only2 = F.col("n1") - F.col("matched"), F.col("n2") - F.col("matched")
    rows = scores.join(quality, "pair_id").join(m, "pair_id", "left").na.fill(0, ["reorderings_detected"])
    return rows.select(
        "pair_id", F.bround(F.col("match_score") * 100, 2).alias("overall_match"),
        F.col("n1").alias("total_sentences_doc1"), F.col("n2").alias("total_sentences_doc2"),
        F.col("matched").alias("matched_sentences"), "exact_matches", "minor_differences",
        (F.col("significant_differences") + only1 + only2).alias("significant_differences"),
        only2.alias("missing_in_doc1"), only1.alias("missing_in_doc2"), "reorderings_detected",
        F.bround("avg_similarity", 3).alias("avg_similarity"),
    )


def verdicts(summaries: DataFrame) -> DataFrame:
    parts = verdict(F.col("overall_match"), F.col("matched_sentences"))
    return summaries.select("pair_id", *[c.alias(k) for k, c in parts.items()])


def recommendations(summaries: DataFrame, rows: DataFrame) -> DataFrame:
    """Advice for each pair, as an array in fixed order."""
    ocr = F.exists("suggestions", lambda s: F.contains(s, F.lit("OCR")))
    counted = rows.groupBy("pair_id").agg(F.count_if(ocr).alias("ocr"))
    s = summaries.join(counted, "pair_id", "left").na.fill(0, ["ocr"])

    def number(c: str) -> object:
        return F.col(c).cast("string")

    # Fixed values, compared output: the texts of the advice.
    rules = [
        (F.col("ocr") > 3, F.lit("Multiple potential OCR errors detected. Consider rescanning document with higher quality settings.")),
        (
            F.col("reorderings_detected") > 0,
            F.concat(F.lit("Detected "), number("reorderings_detected"), F.lit(" sentences that appear in different order. Verify if content was intentionally reorganized.")),
        ),
        (
            F.col("missing_in_doc1") > 0,
            F.concat(number("missing_in_doc1"), F.lit(" sentence(s) appear only in document 2. Check if content was added or if OCR missed these sections.")),
        ),
        (
            F.col("missing_in_doc2") > 0,
            F.concat(number("missing_in_doc2"), F.lit(" sentence(s) appear only in document 1. Check if content was removed or if OCR failed.")),
        ),
        (F.col("overall_match") < 90, F.lit("Documents have notable differences. Manual review recommended for important documents.")),
        (
            (F.col("overall_match") >= 95) & (F.col("minor_differences") > 0),
            F.lit("Documents are very similar. Differences appear to be minor (typos, punctuation). Verify if these are acceptable variations."),
        ),
    ]
    advice = F.array_compact(F.array(*[F.when(c, t) for c, t in rules]))
    fallback = F.array(F.lit("Documents match very closely. No significant issues detected."))
    any_rule = reduce(lambda a, b: a | b, [c for c, _ in rules])
    return s.select("pair_id", F.when(~any_rule & (F.col("overall_match") >= 98), fallback).otherwise(advice).alias("recommendations"))
