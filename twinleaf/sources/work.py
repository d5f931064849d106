"""Places for written intermediate results."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: list[list[str]] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Where none is set a local master takes a temporary one; on a
    cluster that is an error, since executors would not share it."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_.isDefined():
        return set_.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = os.path.join(tempfile.gettempdir(), "twinleaf-checkpoints")
    os.makedirs(folder, exist_ok=True)
    return folder


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    for folders in _FOLDERS:
        folders.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Removes what was written within the scope when it ends. Results must have been read or stored by then."""
    folders: list[str] = []
    _FOLDERS.append(folders)
    try:
        yield
    finally:
        _FOLDERS.remove(folders)
        jvm = spark.sparkContext._jvm
        for path in folders:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
