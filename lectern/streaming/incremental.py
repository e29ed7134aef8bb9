"""Keeping derived tables up to date: new files are read once, upserts are written as new versions, state has a lifetime."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_new(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def index_new(source: DataFrame, derive: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Derived rows of what came since the last run are added to out, once each; returns when all that is there is done.

    A failed batch is done again by the checkpoint's offsets; its rows go to a folder of the batch's number, which is
    written over, so nothing is there twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        derive(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


STATE = "at timestamp"
CHOSEN = "key string, at timestamp"


def first_in_lifetime(events: DataFrame, key: str, at: str, days: int = 7, late: str = "1 day") -> DataFrame:
    """key, at of the events that come when none of their key was let through in so many days (of event time).

    Events older than the watermark (late behind the newest) are left out. A key's state goes when the watermark is a day
    past its lifetime, so what is held is bounded by the keys of the last days.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(t for pdf in batches for t in pdf["at"]):
            if last is None or t - last > pd.Timedelta(days=days):
                out.append((k[0], t))
                last = t
        ends = None if last is None else int((last + pd.Timedelta(days=days + 1)).timestamp() * 1000)
        if state.hasTimedOut or ends is None or ends <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
        else:
            state.update((last,))
            state.setTimeoutTimestamp(ends)
        yield pd.DataFrame(out, columns=["key", "at"])

    keyed = events.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at")).withWatermark("at", late)
    return keyed.groupBy("key").applyInPandasWithState(run, CHOSEN, STATE, "append", "EventTimeTimeout")


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """An extension: events by window and type; what is later than the watermark is left out."""
    counted = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "total")
