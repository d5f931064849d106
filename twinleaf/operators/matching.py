"""Greedy one-to-one matching of sentences with an order-aware context rule."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinleaf.config import DEFAULTS, Settings


def supported_edges(edges: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Edges at the matching threshold with ``supports``: the ``i`` of near edges on the same diagonal above the context similarity."""
    diagonal = Window.partitionBy("pair_id", F.col("i") - F.col("j")).orderBy("i").rangeBetween(-cfg.context_window, cfg.context_window)
    near = F.collect_list(F.when(F.col("similarity") > cfg.context_similarity, F.col("i"))).over(diagonal)
    return edges.withColumn("supports", F.array_except(near, F.array("i"))).where(F.col("similarity") >= cfg.similarity_threshold)


def greedy_match(edges: DataFrame, sizes: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """One-to-one matches: ``pair_id``, ``match_rank`` (from 1), ``i``, ``j``, ``similarity``.

    ``edges`` holds all edges above the context similarity, ``sizes`` the numbers of units ``n1``, ``n2`` of each pair. Edges
    are taken by similarity, ``i``, ``j``, all descending. An edge is skipped if a side is taken; it is refused if two or
    more of its neighbours on the diagonal are still open on both sides and none of them is similar.
    The edges of a pair stream through in order; only the taken indexes are held.
    """
    rows = (
        supported_edges(edges, cfg)
        .join(sizes, "pair_id")
        .repartition("pair_id")
        .sortWithinPartitions("pair_id", F.desc("similarity"), F.desc("i"), F.desc("j"))
        .select("pair_id", "i", "j", "similarity", "supports", "n1", "n2")
    )
    offsets = [o for o in range(-cfg.context_window, cfg.context_window + 1) if o]

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, rank = None, 0
        left: set[int] = set()
        right: set[int] = set()
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.pair_id != pair:
                    pair, rank, left, right = r.pair_id, 0, set(), set()
                if r.i in left or r.j in right:
                    continue
                seen = set(r.supports)
                near = [
                    r.i + o
                    for o in offsets
                    if 0 <= r.i + o < r.n1 and 0 <= r.j + o < r.n2 and r.i + o not in left and r.j + o not in right
                ]
                if len(near) >= 2 and not any(x in seen for x in near):
                    continue
                rank += 1
                left.add(r.i)
                right.add(r.j)
                out.append((pair, rank, r.i, r.j, r.similarity))
            yield pd.DataFrame(out, columns=["pair_id", "match_rank", "i", "j", "similarity"])

    return rows.mapInPandas(match, "pair_id long, match_rank int, i int, j int, similarity double")


def context_checks(edges: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """The context rule of each edge with nothing taken yet: ``supports`` as a number."""
    return supported_edges(edges, cfg).select("pair_id", "i", "j", "similarity", F.size("supports").alias("supports"))


def unmatched(pairs: DataFrame, units: DataFrame, matches: DataFrame, side: int) -> DataFrame:
    """Units of document ``side`` (1 or 2) of each pair that no match holds."""
    index = "i" if side == 1 else "j"
    own = pairs.select("pair_id", F.col(f"doc_id{side}").alias("doc_id")).join(units, "doc_id")
    taken = matches.select("pair_id", F.col(index).alias("seq"))
    return own.join(taken, ["pair_id", "seq"], "left_anti").select("pair_id", "seq", "sent_id", "text")
