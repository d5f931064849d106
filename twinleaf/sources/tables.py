"""Parquet tables of one data directory, and the partitioning of expensive work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the directory ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    """Partitions for work that is heavy per row: what the session sets, and two per core at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hashed by ``keys`` over the cluster when its scan has fewer partitions than the cluster has cores.

    ``df`` is a scan with filters and projections: its partitions are counted without running anything. A scan of
    enough splits is left as it is, so at scale this adds no shuffle. The hash is of values, so a recomputed partition
    after a lost executor holds the same rows.
    """
    spark = df.sparkSession
    if df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(shuffle_width(spark), *[F.col(k) for k in keys])
