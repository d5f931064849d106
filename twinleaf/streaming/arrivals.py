"""Pairs that arrive as a stream are compared batch by batch against a table of units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from twinleaf.config import DEFAULTS, Settings
from twinleaf.plans.compare import Comparison


def compare_arrivals(
    pairs: DataFrame, units: DataFrame, out: str, checkpoint: str, cfg: Settings = DEFAULTS
) -> StreamingQuery:
    """Writes the summary of every pair of the stream ``pairs`` to ``out``; a batch that is repeated replaces itself."""

    def batch(rows: DataFrame, number: int) -> None:
        Comparison(rows, units, cfg).summary.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return pairs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
