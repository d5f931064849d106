"""The comparison of many document pairs as one plan."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinleaf.config import DEFAULTS, Settings
from twinleaf.functions.text import normalize_sentence
from twinleaf.operators import matching, report, similarity
from twinleaf.operators.sentences import sentence_chunks
from twinleaf.sources.work import written


class Comparison:
    """All results for ``pairs`` (``pair_id``, ``doc_id1``, ``doc_id2``) over ``units`` (``doc_id``, ``seq``, ``sent_id``, ``text``).

    Pairs with a null id are left out; a pair given twice counts once. With ``vectors`` (``doc_id``, ``seq``, ``embedding``,
    from a sentence model of one's own) units are compared by these, else by their words. The units of the pairs, edges,
    matches, differences and the summary are written once, when first asked for, and read by everything behind them.
    """

    def __init__(self, pairs: DataFrame, units: DataFrame, cfg: Settings = DEFAULTS, vectors: DataFrame | None = None):
        self.cfg = cfg
        self.vectors = vectors
        self.pairs = (
            pairs.select("pair_id", "doc_id1", "doc_id2")
            .where("pair_id is not null and doc_id1 is not null and doc_id2 is not null")
            .dropDuplicates(["pair_id"])
        )
        self._units = units.select("doc_id", "seq", "sent_id", "text")

    @classmethod
    def of_documents(
        cls, pairs: DataFrame, docs: DataFrame, cfg: Settings = DEFAULTS, segmenter: Callable[[DataFrame, Settings], DataFrame] = sentence_chunks
    ) -> Comparison:
        """For whole texts: ``docs`` has ``doc_id`` and ``text``; ``segmenter`` cuts them into sentences first."""
        return cls(pairs, segmenter(docs, cfg), cfg)

    @cached_property
    def units(self) -> DataFrame:
        """The units of the documents that are compared."""
        used = self.pairs.select(F.col("doc_id1").alias("doc_id")).union(self.pairs.select("doc_id2")).distinct()
        return written(self._units.join(used, "doc_id", "left_semi"), "units")

    @cached_property
    def refused(self) -> DataFrame:
        """``pair_id`` and ``reason`` of the pairs of which a document holds no text."""
        sides = [F.when(F.col(f"n{k}") == 0, F.lit(f"document {k} is empty")) for k in (1, 2)]
        return self.sizes.where("n1 = 0 or n2 = 0").select("pair_id", F.concat_ws(", ", *sides).alias("reason"))

    @cached_property
    def edges(self) -> DataFrame:
        """All unit pairs at or above the context similarity."""
        if self.vectors is not None:
            return written(similarity.vector_edges(self.pairs, self.vectors, self.cfg.context_similarity), "edges")
        return written(similarity.similarity_edges(self.pairs, self.units, self.cfg.context_similarity), "edges")

    @cached_property
    def sizes(self) -> DataFrame:
        """``pair_id``, ``n1``, ``n2``: units on both sides."""
        n = self.units.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
        one = n.select(F.col("doc_id").alias("doc_id1"), F.col("n").alias("n1"))
        two = n.select(F.col("doc_id").alias("doc_id2"), F.col("n").alias("n2"))
        both = self.pairs.join(one, "doc_id1", "left").join(two, "doc_id2", "left").na.fill(0, ["n1", "n2"])
        return both.select("pair_id", "n1", "n2")

    @cached_property
    def matches(self) -> DataFrame:
        """Matches with their texts and flags: ``pair_id``, ``match_rank``, ``index1``, ``index2``, ``similarity``, ``text1``, ``text2``, …"""
        bare = matching.greedy_match(self.edges, self.sizes, self.cfg).join(self.pairs, "pair_id")
        one = self.units.select(F.col("doc_id").alias("doc_id1"), F.col("seq").alias("i"), F.col("text").alias("text1"))
        two = self.units.select(F.col("doc_id").alias("doc_id2"), F.col("seq").alias("j"), F.col("text").alias("text2"))
        full = bare.join(one, ["doc_id1", "i"]).join(two, ["doc_id2", "j"])
        return written(
            full.select(
                "pair_id", "match_rank", F.col("i").alias("index1"), F.col("j").alias("index2"), "similarity", "text1", "text2",
                (F.col("text1") == F.col("text2")).alias("exact_match"),
                (normalize_sentence(F.col("text1")) == normalize_sentence(F.col("text2"))).alias("normalized_match"),
            ),
            "matches",
        )

    def unmatched(self, side: int) -> DataFrame:
        taken = self.matches.select("pair_id", F.col("index1").alias("i"), F.col("index2").alias("j"))
        return matching.unmatched(self.pairs, self.units, taken, side)

    @cached_property
    def quality(self) -> DataFrame:
        return report.match_quality(self.pairs, self.matches, self.cfg)

    @cached_property
    def scores(self) -> DataFrame:
        return report.match_score(self.sizes, self.matches)

    @cached_property
    def reorderings(self) -> DataFrame:
        return report.reorderings(self.matches, self.cfg)

    @cached_property
    def differences(self) -> DataFrame:
        return written(report.differences(self.matches, self.unmatched(1), self.unmatched(2), self.cfg), "differences")

    @cached_property
    def summary(self) -> DataFrame:
        return written(report.summary(self.scores, self.quality, self.reorderings), "summary")

    @cached_property
    def verdicts(self) -> DataFrame:
        return report.verdicts(self.summary)

    @cached_property
    def recommendations(self) -> DataFrame:
        return report.recommendations(self.summary, self.differences)

    def report(self) -> DataFrame:
        """The whole report of every pair as one nested row."""
        d = report.ordered_differences(self.differences)
        fields = ["type", "classification", "severity", "position1", "position2", "sentence1", "sentence2", "similarity", "suggestions"]
        listed = d.groupBy("pair_id").agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("place", F.struct(*fields).alias("d")))), lambda x: x["d"]
            ).alias("differences")
        )
        moves = ["sentence", "expected_position", "actual_position", "displacement"]
        moved = self.reorderings.groupBy("pair_id").agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("match_rank", F.struct(*moves).alias("r")))), lambda x: x["r"]
            ).alias("reorderings")
        )

        def packed(rows: DataFrame, name: str) -> DataFrame:
            return rows.select("pair_id", F.struct(*[c for c in rows.columns if c != "pair_id"]).alias(name))

        out = packed(self.summary, "summary").join(packed(self.verdicts, "verdict"), "pair_id")
        out = out.join(listed, "pair_id", "left").join(moved, "pair_id", "left")
        out = out.join(self.recommendations, "pair_id").join(packed(self.quality, "quality_analysis"), "pair_id")

        def filled(name: str, like: DataFrame) -> object:
            return F.coalesce(name, F.from_json(F.lit("[]"), like.schema[name].dataType))

        return out.withColumns({"differences": filled("differences", listed), "reorderings": filled("reorderings", moved)})
