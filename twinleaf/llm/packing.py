"""Problem 6: fill containers of fixed capacity by sum-of-squares packing.

Documents are sized in tokens and placed one after another where the squared counts of open containers per residual
gap become smallest. Packers work side by side on hashed shares of the items; what their last containers leave open
is packed again by fewer packers.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinleaf.sources.tables import shuffle_width, spread
from twinleaf.sources.work import written

CAPACITY = 2048
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items of one packer.
SHARE = 50_000
#: Containers filled less than this are opened again for the next round.
WELL_FILLED = 0.97


@functools.lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: list[str], vocabulary: str) -> list[int]:
    encoding = _encoding(vocabulary)
    return [len(x) for x in encoding.encode_ordinary_batch(texts, num_threads=1)]


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Container number of each item, in the order given. Sizes are 1 to ``capacity``."""
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    counts = np.zeros(capacity + 1, dtype=np.int64)
    out = np.empty(len(sizes), dtype=np.int64)
    made = 0
    for i, s in enumerate(sizes):
        s = int(s)
        # Change of the sum of squares for each gap g >= s; the last entry stands for a new container.
        after = counts[: capacity - s + 1]
        before = counts[s:]
        change = 2 * after - 2 * before + 2
        change[0] = 1 - 2 * before[0]  # an exact fit closes a container
        change[-1] = 2 * after[-1] + 1 if s < capacity else 0
        usable = before > 0
        usable[-1] = True
        change[~usable] = np.iinfo(np.int64).max
        g = s + int(np.argmin(change))
        if g == capacity:
            container = made
            made += 1
        else:
            container = open_by_gap[g].pop()
            counts[g] -= 1
        if g - s > 0:
            open_by_gap[g - s].append(container)
            counts[g - s] += 1
        out[i] = container
    return out


def _sized(docs: DataFrame, capacity: int, vocabulary: str) -> DataFrame:
    """Items: whole documents, and the parts of those that exceed the capacity alone.

    Documents are sized where they are read; only ids and sizes are shuffled, to keep one of the rows sent twice.
    """
    rows = spread(docs.select("doc_id", "text").where("doc_id is not null"), "doc_id")

    def size(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": token_counts([t or "" for t in batch["text"]], vocabulary)})

    once = rows.mapInPandas(size, "doc_id long, n int").groupBy("doc_id").agg(F.min("n").alias("n"))
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(capacity))
    parts = once.select("doc_id", "n", F.posexplode(starts).alias("part", "start_token"))
    end = F.least(F.col("start_token") + capacity, F.col("n"))
    return parts.select("doc_id", "part", "start_token", end.alias("end_token"), (end - F.col("start_token")).alias("tokens"))


ITEM = ["doc_id", "part", "start_token", "end_token", "tokens"]


def _packer(number: int, capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Packs one share of the items of round ``number``."""

    def place(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["order", "doc_id", "part"], kind="stable")
        sizes = batch["tokens"].to_numpy()
        at = pack(sizes, capacity)
        fill = np.bincount(at, weights=sizes)[at].astype(np.int64)
        packer = batch["packer"].iloc[0]
        return batch[ITEM].assign(container_id=[f"{number}-{packer}-{c}" for c in at], fill=fill)

    return place


def packed(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, share: int = SHARE, rounds: int = 2
) -> DataFrame:
    """A container for every document: ``doc_id``, ``part``, ``start_token``, ``end_token``, ``tokens``, ``container_id``.

    A document is divided only if it alone exceeds ``capacity``; its full parts fill containers of their own. Documents
    without tokens (null or empty text) come out with container null. A document given twice is placed once; rows
    without id are left out; of rows of one id with different texts the shortest counts; extra columns are ignored. The result depends on ids and sizes only, not on partitions.
    """
    items = written(_sized(docs, capacity, vocabulary), "items")
    schema = "doc_id long, part int, start_token int, end_token int, tokens int, container_id string, fill int"
    empty = items.where("tokens = 0").select(*ITEM, F.lit(None).cast("string").alias("container_id"))
    todo = items.where("tokens > 0")
    done = [empty]
    for number in range(1, rounds + 1):
        packers = max(1, -(-todo.count() // share))

        hashed = todo.withColumn("order", F.xxhash64("doc_id", "part", F.lit(number))).withColumn(
            "packer", F.pmod(F.xxhash64(F.lit(number), "doc_id", "part"), F.lit(packers))
        )
        # A partition for every packer: rows are few and small, and would be read by one task otherwise.
        hashed = hashed.repartition(min(packers, 4 * shuffle_width(docs.sparkSession)), "packer")
        out = written(hashed.groupBy("packer").applyInPandas(_packer(number, capacity), schema), "packed")
        if number == rounds or packers == 1:
            done.append(out.select(*ITEM, "container_id"))
            break
        well = F.col("fill") >= int(WELL_FILLED * capacity)
        done.append(out.where(well).select(*ITEM, "container_id"))
        todo = out.where(~well).select(*ITEM)
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result
