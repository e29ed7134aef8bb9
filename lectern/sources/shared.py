"""Tables in the folder that the driver and all executors share, which cut long plans and survive lost executors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: For each scope that is open, the folders of the tables that were written in it.
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, one of our own in local mode (tests);
    on a cluster that is an error, as executors don't see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or "/tmp/lectern-checkpoints"


def new_folder(spark: SparkSession, kind: str = "t") -> str:
    """A folder's name that nothing has yet; a scope removes what is in it."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    for scope in _OPEN[-1:]:
        scope.append(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: later steps survive the loss of any executor and don't
    compute it again."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written within are removed at the end. Results must have been written or collected by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
