"""Queries of the training-data problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinleaf.llm.leakage import leaked_items
from twinleaf.llm.neighbours import nearest, neighbour_pairs, with_texts
from twinleaf.llm.normalizing import normalized_matches
from twinleaf.llm.packing import packed
from twinleaf.llm.residue import template_residue
from twinleaf.llm.scans import noise_found, paragraphs
from twinleaf.llm.sentences import sentence_units
from twinleaf.llm.splitting import split_oversized
from twinleaf.sources import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_oversized(table(spark, d, "sentence").select("doc_id", "seq", "text").distinct())
    return pieces.where("piece_no > 0").select("doc_id", "seq").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "sentence").select("doc_id", "seq", "text").dropDuplicates(["doc_id", "seq"])
    return split_oversized(units).drop("text")


def p1_rules(spark: SparkSession, d: str) -> DataFrame:
    """Every oversized unit, with what holds of its pieces: none above the limit, overlaps of 50, the text rebuilt."""
    units = table(spark, d, "sentence").select("doc_id", "seq", "text").dropDuplicates(["doc_id", "seq"])
    rows = split_oversized(units).where("is_oversized")
    piece = F.struct("piece_no", "piece_start", "piece_end", "piece_text")
    each = rows.groupBy("doc_id", "seq").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.first("text").alias("text"))
    after = F.slice("p", F.lit(2), F.size("p"))
    overlaps = F.forall(F.arrays_zip(F.slice("p", F.lit(1), F.size("p") - 1).alias("a"), after.alias("b")), lambda x: x["b"]["piece_start"] == x["a"]["piece_end"] - 50)
    rest = F.array_join(F.transform(after, lambda x: F.substring(x["piece_text"], F.lit(51), F.length(x["piece_text"]))), "")
    return each.select(
        "doc_id", "seq", F.forall("p", lambda x: F.length(x["piece_text"]) <= 500).alias("within_limit"), overlaps.alias("overlapping"),
        (F.concat(F.get("p", F.lit(0))["piece_text"], rest) == F.col("text")).alias("rebuilt"),
    )


def p2_rules(spark: SparkSession, d: str) -> DataFrame:
    """Every document with sentences: whether they lie in order and hold all of its text but white space."""
    docs = table(spark, d, "documents").select("doc_id", "text").where("text is not null").dropDuplicates(["doc_id"])
    s = F.struct("sent_no", "start_char", "end_char", "text")
    each = sentence_units(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(s)).alias("s"))
    after = F.slice("s", F.lit(2), F.size("s"))
    pairs = F.arrays_zip(F.slice("s", F.lit(1), F.size("s") - 1).alias("a"), after.alias("b"))
    blanks = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    held = F.regexp_replace(F.array_join(F.transform("s", lambda x: x["text"]), ""), blanks, "")
    return each.join(docs, "doc_id").select(
        "doc_id", F.forall(pairs, lambda x: x["b"]["start_char"] >= x["a"]["end_char"]).alias("in_order"),
        F.forall("s", lambda x: F.substring("text", x["start_char"] + 1, x["end_char"] - x["start_char"]) == x["text"]).alias("as_stored"),
        (held == F.regexp_replace("text", blanks, "")).alias("whole"),
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("source = 'gazette'")
    return sentence_units(docs).select("doc_id", "start_char", "end_char").distinct()


def p2_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentence_units(table(spark, d, "documents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = normalized_matches(table(spark, d, "sentence_match"))
    return rows.where("exact_match and not stored_exact").select("match_id").distinct()


def p3_matches(spark: SparkSession, d: str) -> DataFrame:
    return normalized_matches(table(spark, d, "sentence_match"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbour_pairs(nearest(table(spark, d, "sentence_vector")))


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "sentence_vector")
    return with_texts(nearest(vectors), vectors, table(spark, d, "sentence"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return noise_found(table(spark, d, "sentence"), table(spark, d, "doc_pair"))


def p5_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return paragraphs(table(spark, d, "sentence"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packed(table(spark, d, "documents"))


def p6_rules(spark: SparkSession, d: str) -> DataFrame:
    """Documents placed, and what must not be: containers above the capacity, tokens placed twice or not at all, needless divisions."""
    rows = packed(table(spark, d, "documents"))
    over = rows.where("container_id is not null").groupBy("container_id").agg(F.sum("tokens").alias("t")).where("t > 2048")
    by_doc = rows.groupBy("doc_id").agg(
        F.sum("tokens").alias("t"), F.max("end_token").alias("end"), F.count(F.lit(1)).alias("parts"), F.count_distinct("start_token").alias("starts")
    )
    figures = by_doc.agg(
        F.count(F.lit(1)).alias("documents"), F.count_if((F.col("t") != F.col("end")) | (F.col("parts") != F.col("starts"))).alias("miscounted"),
        F.count_if((F.col("parts") > 1) & (F.col("t") <= 2048)).alias("needless"),
    )
    return figures.withColumn("overfull", over.agg(F.count(F.lit(1))).scalar())


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "benchmark")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return template_residue(table(spark, d, "documents")).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        p1_found, p1_pieces, p1_rules, p2_found, p2_sentences, p2_rules, p3_found, p3_matches, p4_found, p4_neighbours, p5_found, p5_paragraphs, p6_containers,
        p6_rules, p7_found, p8_found,
    )}
