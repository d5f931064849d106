"""Problem 1: cut oversized texts at natural boundaries.

Dynamic programming over candidate cut positions: the pieces of one text are chosen so that the sum of cut
penalties and of the squared imbalance of piece sizes is least, under the length limit and with a fixed overlap.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinleaf.sources.tables import shuffle_width

#: Penalty of a cut by what ends before it; the strongest boundary at a position counts.
PENALTIES = (
    (re.compile(r"\n\s*\n\s*"), 0.0),
    (re.compile(r"(?:[.!?…؟۔]+[\"'”’»)\]]*\s+|[。！？।॥]+[」』”’）]*\s*)"), 0.4),
    (re.compile(r"\n"), 1.0),
    (re.compile(r"(?:[;؛]\s+|；\s*)"), 1.2),
    (re.compile(r"(?:[:,،]\s+|[，、：]\s*)"), 1.6),
    (re.compile(r"[)\]\"”»]\s+"), 2.0),
    (re.compile(r"\s+"), 2.5),
)
INSIDE_WORD = 12.0
IMBALANCE = 6.0
PER_PIECE = 4.0
#: Where no boundary lies within this share of a piece's advance, positions inside words become candidates.
STRIDE_SHARE = 8

PIECES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _candidates(text: str, advance: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(text)
    cost = np.full(n + 1, INSIDE_WORD)
    for pattern, penalty in reversed(PENALTIES):
        ends = np.fromiter((m.end() for m in pattern.finditer(text)), dtype=np.int64)
        cost[ends] = penalty
    cost[n] = 0.0
    natural = np.flatnonzero(cost < INSIDE_WORD)
    natural = natural[natural > 0]
    stride = max(1, advance // STRIDE_SHARE)
    extra = []
    previous = 0
    for at in natural:
        if at - previous > stride:
            for p in range(previous + stride, at, stride):
                while p > previous and p < n and unicodedata.combining(text[p]):
                    p -= 1
                if p > previous:
                    extra.append(p)
        previous = at
    positions = np.unique(np.concatenate([natural, np.array(extra, dtype=np.int64)])) if extra else natural
    return positions, cost[positions]


def cut(text: str, max_len: int = 500, overlap: int = 50) -> list[tuple[int, int]]:
    """Pieces ``(start, end)`` of ``text``: none is longer than ``max_len``, each begins ``overlap`` before the last ended.

    A text within the limit is one piece. Positions count code points.
    """
    n = len(text)
    if n <= max_len:
        return [(0, n)]
    advance = max_len - overlap
    positions, penalty = _candidates(text, advance)
    fewest = -(-(n - overlap) // advance)
    ideal = (n - overlap) / fewest
    m = len(positions)
    best = np.full(m, np.inf)
    back = np.full(m, -2, dtype=np.int64)
    low = np.searchsorted(positions, positions - advance, side="left")
    for j in range(m):
        here = positions[j]
        if here <= max_len:
            best[j] = IMBALANCE * ((here - overlap - ideal) / advance) ** 2 + PER_PIECE
            back[j] = -1
        a = low[j]
        if a < j:
            # A piece must reach beyond its overlap, else it would add nothing.
            gain = here - positions[a:j]
            total = best[a:j] + penalty[a:j] + IMBALANCE * ((gain - ideal) / advance) ** 2 + PER_PIECE
            total[positions[a:j] < overlap] = np.inf
            k = int(np.argmin(total))
            if total[k] < best[j]:
                best[j] = total[k]
                back[j] = a + k
    ends = []
    j = m - 1
    while j >= 0:
        ends.append(int(positions[j]))
        j = int(back[j])
    ends.reverse()
    starts = [0] + [e - overlap for e in ends[:-1]]
    return list(zip(starts, ends))


def split_oversized(
    df: DataFrame, text_col: str = "text", max_len: int = 500, overlap: int = 50, piece_prefix: str = "piece"
) -> DataFrame:
    """Every row of ``df`` whose text is longer than ``max_len`` as its pieces, every other row as one piece.

    Adds ``<prefix>_no`` (from 0), ``<prefix>_text``, ``<prefix>_start``, ``<prefix>_end``, ``<prefix>_length`` and
    ``is_oversized``; columns of ``df`` of these names are replaced. Null texts give one row with null piece
    columns and ``is_oversized`` false; empty texts one empty piece. Repeated rows are each cut.
    Only oversized texts go through Python.
    """
    if not 0 <= overlap < max_len / 2:
        raise ValueError("overlap must be at least 0 and below half of max_len")

    @F.pandas_udf(PIECES)
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [] if t is None else cut(t, max_len, overlap))

    made = [f"{piece_prefix}_{x}" for x in ("no", "text", "start", "end", "length")] + ["is_oversized"]
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c == text_col or c not in made])
    text: Column = F.col(f"`{text_col}`")
    over = F.coalesce(F.length(text) > max_len, F.lit(False))
    # posexplode keeps the order of the array; the struct holds start and end.
    # Oversized texts are few and heavy: without an own spreading few tasks would cut them all.
    long = (
        kept.where(over).repartition(shuffle_width(df.sparkSession), F.xxhash64(text))
        .select("*", F.posexplode(pieces(text)).alias("__no", "__p"))
        .select(
            *[F.col(f"`{c}`") for c in kept.columns],
            F.col("__no").alias(made[0]),
            F.substring(text, F.col("__p.start") + 1, F.col("__p.end") - F.col("__p.start")).alias(made[1]),
            F.col("__p.start").alias(made[2]),
            F.col("__p.end").alias(made[3]),
            (F.col("__p.end") - F.col("__p.start")).alias(made[4]),
            F.lit(True).alias(made[5]),
        )
    )
    whole = kept.where(~over).select(
        "*",
        F.when(text.isNotNull(), F.lit(0)).alias(made[0]),
        text.alias(made[1]),
        F.when(text.isNotNull(), F.lit(0)).alias(made[2]),
        F.length(text).alias(made[3]),
        F.length(text).alias(made[4]),
        F.lit(False).alias(made[5]),
    )
    return whole.unionByName(long)
