"""Sentence operators: chunking, statistics, context, paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinleaf.config import DEFAULTS, Settings
from twinleaf.functions.text import split_long, strip

#: A raw sentence: up to a stop and the white space behind it, or to the end.
_SENTENCE = r"(?s).*?[.!?]\s+|.+\z"


def sentence_chunks(docs: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Sentences of ``docs`` (``doc_id``, ``text``) by the rule: a stop followed by white space ends a sentence.

    Columns ``doc_id``, ``seq`` (from 0, no gaps), ``sent_id`` (number of the raw sentence; of a split part, ``seq``),
    ``text``, ``start_char``, ``end_char``, ``length``, ``is_split``. Sentences below the least length are left out, those
    above the greatest are split; the parts share the offsets of their sentence. Null and blank texts give no rows.
    """
    parts = F.regexp_extract_all("text", F.lit(_SENTENCE), F.lit(0))
    raw = docs.select("doc_id", F.posexplode(parts).alias("pos", "part"))
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = raw.withColumn("start_char", F.coalesce(F.sum(F.length("part")).over(before), F.lit(0)).cast("int"))
    tail = F.length(F.regexp_replace("part", r"\s+$", ""))
    kept = placed.withColumn("end_char", (F.col("start_char") + tail).cast("int")).withColumn("whole", strip(F.col("part")))
    kept = kept.where(F.length("whole") >= cfg.min_sentence_length)
    long = F.length("whole") > cfg.max_sentence_length
    rows = kept.select(
        "doc_id", "pos", "start_char", "end_char", long.alias("is_split"),
        F.posexplode(F.when(long, split_long(F.col("whole"), cfg.max_sentence_length)).otherwise(F.array("whole"))).alias("k", "text"),
    )
    seq = (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "k")) - 1).cast("int")
    return rows.withColumn("seq", seq).select(
        "doc_id", "seq", F.when(F.col("is_split"), F.col("seq")).otherwise(F.col("pos")).cast("int").alias("sent_id"),
        "text", "start_char", "end_char", F.length("text").alias("length"), "is_split",
    )


def latest_units(sentences: DataFrame) -> DataFrame:
    """Every unit once: ``doc_id``, ``seq``, ``sent_id``, ``text``, ``start_char``, ``end_char``, true ``length``.

    Rows sent twice have the same key and text. Rows without key or text are left out.
    """
    return (
        sentences.where("doc_id is not null and seq is not null and text is not null")
        .select("doc_id", "seq", "sent_id", "text", "start_char", "end_char")
        .dropDuplicates(["doc_id", "seq"])
        .withColumn("length", F.length("text"))
    )


def chunk_statistics(docs: DataFrame, units: DataFrame) -> DataFrame:
    """Number, mean, least, greatest and total length of the units of every document; zeros where it has none."""
    by_doc = units.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_sentences"), F.avg("length").alias("avg_length"), F.min("length").alias("min_length"),
        F.max("length").alias("max_length"), F.sum("length").alias("total_chars"),
    )
    return docs.select("doc_id").distinct().join(by_doc, "doc_id", "left").na.fill(0)


def sentence_context(units: DataFrame, window: int = 1) -> DataFrame:
    """Texts of up to ``window`` units before and after each unit of its document, as arrays in document order."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    return units.select(
        "doc_id", "seq",
        F.collect_list("text").over(w.rowsBetween(-window, -1)).alias("before"),
        F.col("text").alias("target"),
        F.collect_list("text").over(w.rowsBetween(1, window)).alias("after"),
    )


def paragraph_groups(units: DataFrame, gap: int = DEFAULTS.paragraph_gap) -> DataFrame:
    """``paragraph_id`` (from 0) of every unit: a new one where more than ``gap`` characters lie before the unit."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    new = F.when(F.col("start_char") - F.lag("end_char").over(w) > gap, 1).otherwise(0)
    return units.withColumn("new", new).select(
        "doc_id", "seq", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("paragraph_id")
    )
