"""Similarity joins of sentences within pairs of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinleaf.functions.text import tokens
from twinleaf.sources.work import written


def term_counts(units: DataFrame) -> DataFrame:
    """``doc_id``, ``seq``, ``token``, ``tf``: how often each word stands in each unit.

    The units are hashed by their key before their words are taken apart, so neither the counts nor the windows over a
    unit shuffle the words.
    """
    words = units.select("doc_id", "seq", "text").repartition("doc_id", "seq").select("doc_id", "seq", F.explode(tokens(F.col("text"))).alias("token"))
    return words.groupBy("doc_id", "seq", "token").agg(F.count(F.lit(1)).alias("tf"))


#: Words that are ordered by how many units hold them; all others are rarer and come first. It only sets the order in
#: which candidates are looked for, so the result does not depend on it.
COMMON_WORDS = 4096


def unit_words(units: DataFrame, least: float) -> DataFrame:
    """One row per unit: ``doc_id``, ``seq``, ``words`` (word to count), ``norm2`` and ``leads``, its leading words.

    Words stand rarest first, in one order for all units; a word leads if it and those behind it can still reach ``least``
    by themselves. Two units of cosine ``least`` or more share a leading word of both: if their first shared word led in
    one of them no more, all shared words would be behind it, and too light.
    """
    terms = term_counts(units)
    held = terms.groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    common = held.orderBy(F.desc("held"), "token").limit(COMMON_WORDS)
    ranked = terms.join(F.broadcast(common), "token", "left").withColumn("rank", F.coalesce("held", F.lit(0)))
    unit = Window.partitionBy("doc_id", "seq")
    square = F.col("tf") * F.col("tf")
    before = F.coalesce(F.sum(square).over(unit.orderBy("rank", "token").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = ranked.withColumn("before", before).withColumn("norm2", F.sum(square).over(unit))
    leads = F.col("norm2") - F.col("before") >= F.col("norm2") * F.lit(least * least - 1e-9)
    return rows.groupBy("doc_id", "seq").agg(
        F.map_from_entries(F.collect_list(F.struct("token", "tf"))).alias("words"), F.first("norm2").alias("norm2"),
        F.collect_list(F.when(leads, F.col("token"))).alias("leads"),
    )


def similarity_edges(pairs: DataFrame, units: DataFrame, least: float) -> DataFrame:
    """Unit pairs ``i``, ``j`` of each document pair whose word counts have a cosine of ``least`` or more.

    ``pairs`` has ``pair_id``, ``doc_id1``, ``doc_id2``. Exact: candidates share a leading word, and each is
    scored over all its words with integer sums, so the result does not depend on the order of rows. Units without
    words have no edges. Columns ``pair_id``, ``i``, ``j``, ``similarity``.
    """
    used = pairs.select(F.col("doc_id1").alias("doc_id")).union(pairs.select("doc_id2")).distinct()
    rows = written(unit_words(units.join(used, "doc_id", "left_semi"), least), "unit-words")
    first = rows.select("doc_id", "seq", F.explode("leads").alias("token"))
    one = pairs.join(first, pairs["doc_id1"] == first["doc_id"]).select("pair_id", "doc_id1", "doc_id2", "token", F.col("seq").alias("i"))
    two = pairs.join(first, pairs["doc_id2"] == first["doc_id"]).select("pair_id", "token", F.col("seq").alias("j"))
    candidates = one.join(two, ["pair_id", "token"]).select("pair_id", "doc_id1", "doc_id2", "i", "j").distinct()
    a = rows.select(F.col("doc_id").alias("doc_id1"), F.col("seq").alias("i"), F.col("words").alias("w1"), F.col("norm2").alias("a2"))
    b = rows.select(F.col("doc_id").alias("doc_id2"), F.col("seq").alias("j"), F.col("words").alias("w2"), F.col("norm2").alias("b2"))
    dot = F.aggregate(
        F.map_entries("w1"), F.lit(0).cast("long"), lambda s, x: s + x["value"] * F.coalesce(F.try_element_at("w2", x["key"]), F.lit(0).cast("long"))
    )
    scored = candidates.join(a, ["doc_id1", "i"]).join(b, ["doc_id2", "j"])
    cosine = dot.cast("double") / F.sqrt((F.col("a2") * F.col("b2")).cast("double"))
    return scored.select("pair_id", "i", "j", cosine.alias("similarity")).where(F.col("similarity") >= least)


#: Vectors of a block; pairs of blocks are compared as matrices.
VECTOR_BLOCK = 512
#: Decimals of a vector similarity, so that it does not depend on the order of sums.
VECTOR_DECIMALS = 9


def vector_edges(pairs: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """Unit pairs ``i``, ``j`` of each document pair whose vectors have a cosine of ``least`` or more: an own sentence model.

    ``vectors`` has ``doc_id``, ``seq`` and ``embedding``; of a unit given twice the first by its numbers counts. Exact: the
    vectors of a document lie in blocks, and every block of one side meets every block of the other as a matrix product,
    so a task holds two blocks at a time. Null vectors and those without length have no edges; vectors of different
    lengths do not meet. Columns ``pair_id``, ``i``, ``j``, ``similarity`` (rounded to 9 decimals).
    """
    usable = vectors.where("doc_id is not null and seq is not null and embedding is not null and size(embedding) > 0")
    numbers = F.transform("embedding", lambda x: x.cast("double"))
    rows = usable.select("doc_id", "seq", numbers.alias("v")).groupBy("doc_id", "seq").agg(F.min("v").alias("v"))
    member = F.struct("seq", "v")
    block = F.floor(F.col("seq") / VECTOR_BLOCK)
    blocks = written(rows.groupBy("doc_id", block.alias("block"), F.size("v").alias("dim")).agg(F.collect_list(member).alias("m")), "vector-blocks")
    one = pairs.join(blocks, pairs["doc_id1"] == blocks["doc_id"]).select("pair_id", "doc_id2", "dim", F.col("m").alias("m1"))
    both = one.join(blocks.withColumnRenamed("doc_id", "doc_id2"), ["doc_id2", "dim"]).select("pair_id", "m1", F.col("m").alias("m2"))

    def matrix(members: object) -> tuple[np.ndarray, np.ndarray]:
        seq = np.array([m["seq"] for m in members])
        x = np.array([np.nan_to_num(np.asarray(m["v"], dtype=np.float64), nan=np.inf) for m in members])
        ok = np.isfinite(x).all(axis=1) & (np.abs(x).sum(axis=1) > 0)
        x = x[ok]
        return seq[ok], x / np.linalg.norm(x, axis=1, keepdims=True)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pair, m1, m2 in zip(batch["pair_id"], batch["m1"], batch["m2"]):
                (i, x), (j, y) = matrix(m1), matrix(m2)
                sim = np.round(x @ y.T, VECTOR_DECIMALS)
                a, b = np.nonzero(sim >= least)
                yield pd.DataFrame({"pair_id": pair, "i": i[a], "j": j[b], "similarity": sim[a, b]})

    return both.mapInPandas(compare, "pair_id long, i int, j int, similarity double")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays of one length; null where one has no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def ranked_edges(edges: DataFrame) -> DataFrame:
    """``edges`` with their place in the pair: similarity, then ``i``, then ``j``, all descending."""
    w = Window.partitionBy("pair_id").orderBy(F.desc("similarity"), F.desc("i"), F.desc("j"))
    return edges.withColumn("place", F.row_number().over(w))
