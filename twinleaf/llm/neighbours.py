"""Problem 4: the k most similar vectors of every vector, by cross-polytope hashing.

Unit vectors are turned by fast Hadamard pseudo-rotations and hashed to the nearest signed axis. Each of a few tables
has its own rotation; a vector is indexed in one bucket of each table and asks for its neighbours there and in the
buckets of its next nearest axes (multiprobe). All candidates of a bucket are ranked by exact cosine.

Buckets of more than ``max_bucket`` vectors are parted by further rotations; what stays too large after the last one
is compared in blocks, so nothing is left out. Vectors of one direction are searched for once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinleaf.sources.tables import spread
from twinleaf.sources.work import written

TABLES = 3
PROBES = 2
MAX_BUCKET = 20_000
#: Rotations after the first, each to ``FINE`` signed axes, that part large buckets.
LEVELS = 5
FINE = 8
#: Below a parted bucket, further axes asked for in each rotation, and further paths followed for each rotation.
MORE_AXES = 2
MORE_PATHS = 8
SEED = 20_240_607
#: Digits by which directions count as equal.
EQUAL_DIGITS = 6
SALTS = 32


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows of ``x``; their length is a power of two."""
    x = x.copy()
    n, d = x.shape
    h = 1
    while h < d:
        v = x.reshape(n, d // (2 * h), 2, h)
        a, b = v[:, :, 0, :].copy(), v[:, :, 1, :].copy()
        v[:, :, 0, :], v[:, :, 1, :] = a + b, a - b
        h *= 2
    return x / np.float32(np.sqrt(d))


class Hashing:
    """The rotations of all tables and levels for vectors of ``dim`` numbers."""

    def __init__(self, dim: int, tables: int = TABLES, levels: int = LEVELS, seed: int = SEED):
        self.dim, self.tables, self.levels = dim, tables, levels
        self.width = 1 << max(1, (dim - 1).bit_length())
        rng = np.random.default_rng(seed)
        self.signs = rng.choice(np.array([-1, 1], dtype=np.float32), size=(tables, levels + 1, 3, self.width))

    def _turned(self, x: np.ndarray, table: int, level: int) -> np.ndarray:
        if x.shape[1] < self.width:
            x = np.pad(x, ((0, 0), (0, self.width - x.shape[1])))
        for s in self.signs[table, level]:
            x = hadamard(x * s)
        return x if level == 0 else x[:, : min(FINE, self.width)]

    def axes(self, x: np.ndarray, table: int, level: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row the ``probes`` nearest signed axes, nearest first, and how much farther each is than the first."""
        r = self._turned(x, table, level)
        size = np.abs(r)
        probes = min(probes, r.shape[1])
        order = np.argsort(-size, axis=1, kind="stable")[:, :probes]
        value = np.take_along_axis(size, order, axis=1)
        codes = order * 2 + (np.take_along_axis(r, order, axis=1) < 0)
        return codes, (value[:, :1] - value) ** 2


def _unit(vectors: pd.Series, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the usable rows, and which rows are usable: not null, finite, not all zero, of one length."""
    arrays = [None if v is None else np.asarray(v, dtype=np.float32) for v in vectors]
    ok = np.array([a is not None and a.ndim == 1 and len(a) == dim and bool(np.isfinite(a).all()) for a in arrays], dtype=bool)
    x = np.stack([a for a, k in zip(arrays, ok) if k]) if ok.any() else np.zeros((0, dim or 1), np.float32)
    norm = np.linalg.norm(x.astype(np.float64), axis=1)
    keep = norm > 0
    ok[np.flatnonzero(ok)[~keep]] = False
    return (x[keep] / norm[keep, None]).astype(np.float32), ok


def _matrix(packed: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype=np.float32).reshape(len(packed), dim)


def _keys(
    hashing: Hashing, x: np.ndarray, table: int, hot: set[tuple], probes: int, home: bool = False
) -> list[list[tuple[float, tuple]]]:
    """For each row the bucket keys to ask, nearest first. A key is a path of axes; it goes on below a hot path.

    Every rotation parts some near vectors, so more is asked for below a hot path; ``home``: only the nearest matters.
    """
    axes, paths = (probes, 1) if home else (probes + MORE_AXES, MORE_PATHS)
    codes, loss = hashing.axes(x, table, 0, probes)
    out = [[(float(c), (table, int(a))) for a, c in zip(cs, ls)] for cs, ls in zip(codes, loss)]
    if not hot:
        return out
    for level in range(1, hashing.levels + 1):
        todo = [i for i, keys in enumerate(out) if any(len(k) == level + 1 and k in hot for _, k in keys)]
        if not todo:
            break
        codes, loss = hashing.axes(x[todo], table, level, axes)
        for row, i in enumerate(todo):
            grown = []
            for c, k in out[i]:
                if len(k) == level + 1 and k in hot:
                    grown += [(c + float(ls), (*k, int(a))) for a, ls in zip(codes[row], loss[row])]
                else:
                    grown.append((c, k))
            grown.sort()
            out[i] = grown[: probes + level * paths]
    return out


def _hot_paths(reps: DataFrame, hashing: Hashing, max_bucket: int) -> tuple[set[tuple], dict[tuple, int]]:
    """Paths of more than ``max_bucket`` vectors, and the number of blocks of those that no rotation parts any more.

    There are at most (vectors / ``max_bucket``) such paths per table and level, so they may be sent to the workers.
    """
    hot: set[tuple] = set()
    blocks: dict[tuple, int] = {}
    for level in range(hashing.levels + 1):

        def count(batches: Iterator[pd.DataFrame], level=level, hot=frozenset(hot)) -> Iterator[pd.DataFrame]:
            held: dict[tuple, int] = {}
            for batch in batches:
                if not len(batch):
                    continue
                x = _matrix(batch["unit"], hashing.dim)
                for t in range(hashing.tables):
                    for keys in _keys(hashing, x, t, set(hot), 1, home=True):
                        k = keys[0][1]
                        if len(k) == level + 2:
                            held[k] = held.get(k, 0) + 1
            yield pd.DataFrame([(",".join(map(str, k)), n) for k, n in held.items()], columns=["path", "n"])

        counted = reps.mapInPandas(count, "path string, n long").groupBy("path").agg(F.sum("n").alias("n"))
        large = {tuple(map(int, r.path.split(","))): r.n for r in counted.where(F.col("n") > max_bucket).collect()}
        if not large:
            break
        if level < hashing.levels:
            hot |= set(large)
        else:
            blocks = {k: -(-n // max_bucket) for k, n in large.items()}
    return hot, blocks


def nearest(
    vectors: DataFrame,
    k: int = 5,
    dim: int = 64,
    tables: int = TABLES,
    probes: int = PROBES,
    max_bucket: int = MAX_BUCKET,
    levels: int = LEVELS,
) -> DataFrame:
    """The ``k`` vectors of highest cosine to every usable vector: ``vec_id``, ``other_id``, ``similarity``, ``place``.

    ``vectors`` has ``vec_id`` and ``embedding``; other columns are ignored. Rows sent twice count once. Null vectors,
    vectors with a null, infinite or missing number, all-zero vectors and vectors not of ``dim`` numbers take no part.
    Equal directions under different ids have similarity 1. Ties go to the smaller id. Fewer than ``k`` rows come out
    only where there are fewer other vectors in reach of the tables.
    """
    rows = spread(vectors.select("vec_id", "embedding").where("vec_id is not null and embedding is not null"), "vec_id")

    def units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, ok = _unit(batch["embedding"], dim)
            rounded = np.round(x, EQUAL_DIGITS) + np.float32(0)
            yield pd.DataFrame(
                {
                    "vec_id": batch["vec_id"][ok].to_numpy(),
                    "unit": [v.tobytes() for v in x],
                    "same": [v.tobytes() for v in rounded],
                }
            )

    usable = rows.mapInPandas(units, "vec_id long, unit binary, same binary").withColumn("same", F.xxhash64("same"))
    # Rows sent twice have the same id and vector. Ids and directions that stand more than once are found by their keys;
    # only the vectors of those are shuffled.
    held = written(usable, "usable")
    twice = written(held.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id"), "twice")
    once = held.join(twice, "vec_id", "left_anti").unionByName(held.join(twice, "vec_id", "left_semi").dropDuplicates(["vec_id"]))
    # The first k + 1 ids of a direction; the rank holds no more of them.
    ids = once.select("vec_id", "same")
    several = written(ids.groupBy("same").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("same"), "several")
    by_id = Window.partitionBy("same").orderBy("vec_id")
    ranked = ids.join(several, "same", "left_semi").withColumn("rank", F.row_number().over(by_id)).where(F.col("rank") <= k + 1)
    crowd = written(ranked.groupBy("same").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "crowds")
    single = once.join(several, "same", "left_anti")
    first = once.join(crowd.select(F.get("ids", F.lit(0)).alias("vec_id")), "vec_id", "left_semi")
    reps = single.unionByName(first).select("same", "unit")
    few = single.select("same", F.array("vec_id").alias("ids")).unionByName(crowd)

    hashing = Hashing(dim, tables, levels)
    hot, blocks = _hot_paths(reps, hashing, max_bucket)
    sent = vectors.sparkSession.sparkContext.broadcast((hashing, hot, blocks))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, hot, blocks = sent.value
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch["unit"], own.dim)
            same, unit = batch["same"].to_numpy(), batch["unit"].to_numpy()
            out: list[tuple] = []
            for t in range(own.tables):
                for i, keys in enumerate(_keys(own, x, t, hot, probes)):
                    for place, (_, key) in enumerate(keys):
                        n = blocks.get(key, 1)
                        path = ",".join(map(str, key))
                        home = int(same[i]) % n
                        for b in range(n):
                            out.append((f"{path}/{b}" if n > 1 else path, place == 0 and b == home, same[i], unit[i]))
            yield pd.DataFrame(out, columns=["bucket", "held", "same", "unit"])

    def ranked_in_bucket(batch: pd.DataFrame) -> pd.DataFrame:
        held = batch["held"].to_numpy(dtype=bool)
        names = batch["same"].to_numpy()
        x = _matrix(batch["unit"], dim)
        index, index_names = x[held], names[held]
        if not len(index):
            return pd.DataFrame({"same": [], "other": [], "similarity": []})
        order = np.argsort(index_names, kind="stable")
        index, index_names = index[order], index_names[order]
        out = []
        step = max(1, 4_000_000 // len(index))
        for a in range(0, len(x), step):
            sim = x[a : a + step] @ index.T
            sim[index_names[None, :] == names[a : a + step, None]] = -2.0
            m = min(k, sim.shape[1])
            best = np.argpartition(-sim, m - 1, axis=1)[:, :m] if m < sim.shape[1] else np.tile(np.arange(m), (len(sim), 1))
            value = np.take_along_axis(sim, best, axis=1)
            good = value > -1.5
            who = np.repeat(names[a : a + step], m).reshape(len(sim), m)
            out.append((who[good], index_names[best][good], value[good]))
        return pd.DataFrame(
            {
                "same": np.concatenate([o[0] for o in out]),
                "other": np.concatenate([o[1] for o in out]),
                "similarity": np.concatenate([o[2] for o in out]).astype(np.float64),
            }
        )

    near = (
        reps.mapInPandas(placed, "bucket string, held boolean, same long, unit binary")
        .groupBy("bucket")
        .applyInPandas(ranked_in_bucket, "same long, other long, similarity double")
        .repartition("same")  # one shuffle for the pairs and for the lists
        .groupBy("same", "other")
        .agg(F.max("similarity").alias("similarity"))
    )
    # A vector's list of k directions; at most tables x (probes + levels x MORE_PATHS) x k candidates each.
    by_sim = Window.partitionBy("same").orderBy(F.desc("similarity"), "other")
    lists = near.withColumn("r", F.row_number().over(by_sim)).where(F.col("r") <= k).drop("r")

    size = F.size("ids")
    # Members of a direction with more than k ids have their whole list there.
    crowded = few.where(size > k).select("same", "ids", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    members = ids
    in_crowd = (
        members.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
        .join(crowded, ["same", "salt"])
        .select("vec_id", F.explode("ids").alias("other_id"), F.lit(1.0).alias("similarity"))
    )
    sparse = few.where(size <= k)
    alone = sparse.select("same", F.explode("ids").alias("vec_id"), "ids")
    copies = alone.select("vec_id", F.explode("ids").alias("other_id"), F.lit(1.0).alias("similarity"))
    outside = (
        alone.select("same", "vec_id")
        .join(lists, "same")
        .join(few.select(F.col("same").alias("other"), "ids"), "other")
        .select("vec_id", F.explode("ids").alias("other_id"), "similarity")
    )
    all_ = in_crowd.unionByName(copies).unionByName(outside).where("vec_id <> other_id")
    place = Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "other_id")
    return all_.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)


def neighbour_pairs(lists: DataFrame) -> DataFrame:
    """Unordered pairs of the lists, once each: ``vec_a`` < ``vec_b``."""
    return lists.select(
        F.least("vec_id", "other_id").alias("vec_a"), F.greatest("vec_id", "other_id").alias("vec_b")
    ).distinct()


def with_texts(lists: DataFrame, vectors: DataFrame, sentences: DataFrame) -> DataFrame:
    """``lists`` with the text of both sides; null where the sentence is missing."""
    place = vectors.select("vec_id", "doc_id", "seq").where("vec_id is not null").dropDuplicates(["vec_id"])
    text = sentences.select("doc_id", "seq", "text").dropDuplicates(["doc_id", "seq"])
    named = place.join(text, ["doc_id", "seq"], "left").select("vec_id", "text")
    return (
        lists.join(named.withColumnRenamed("text", "text_a"), "vec_id", "left")
        .join(named.select(F.col("vec_id").alias("other_id"), F.col("text").alias("text_b")), "other_id", "left")
        .select("vec_id", "other_id", "place", "similarity", "text_a", "text_b")
    )
