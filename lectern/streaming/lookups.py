"""Questions to services: no faster than they allow, each row by itself, so that one failure stops nothing."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: seconds between two questions to a service.
GAP = 1.2


def paced(rows: DataFrame, lookup: Callable[[dict], dict | None], found: str, gap: float = GAP, lanes: int = 1) -> DataFrame:
    """rows with the columns of found (DDL), and error: what lookup says of each row (a dict), nulls where it says nothing.

    An exception becomes the row's error. Rows go through lanes; each waits gap * lanes seconds between two questions, so
    all together ask once in gap seconds, however many executors there are. A lane that is lost asks again.
    """
    names = [x.split()[0] for x in found.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            said = []
            for row in batch.to_dict("records"):
                wait = 0 if last is None else last + gap * lanes - time.monotonic()
                if wait > 0:
                    time.sleep(wait)
                last = time.monotonic()
                try:
                    got = lookup(row) or {}
                    said.append([got.get(n) for n in names] + [None])
                except Exception as e:
                    said.append([None] * len(names) + [f"{type(e).__name__}: {e}"])
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(said, columns=[*names, "error"], dtype=object)], axis=1)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), found, "error string"])
    return rows.repartition(lanes).mapInPandas(run, schema)


def run_lookups(source: DataFrame, lookup: Callable[[dict], dict | None], found: str, out: str, checkpoint: str, gap: float = GAP, lanes: int = 1) -> None:
    """Ask about all rows that the stream source has had since the last run: answers to out/found, rows that failed with
    their errors to out/failed. A batch that is done again writes over its own folders, so nothing is there twice."""

    def write(batch: DataFrame, number: int) -> None:
        where = f"{out}/asked/batch={number}"
        paced(batch, lookup, found, gap, lanes).write.mode("overwrite").parquet(where)  # each question once, for both tables
        asked = batch.sparkSession.read.parquet(where)
        asked.where("error IS NULL").drop("error").write.mode("overwrite").parquet(f"{out}/found/batch={number}")
        asked.where("error IS NOT NULL").drop(*[x.split()[0] for x in found.split(",")]).write.mode("overwrite").parquet(f"{out}/failed/batch={number}")

    source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def answered(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/found").drop("batch")


def failed(spark: SparkSession, out: str, key: str) -> DataFrame:
    """The rows that failed the last time, and weren't answered since: what is to be asked again."""
    done = answered(spark, out).select(key).distinct()
    rows = spark.read.parquet(f"{out}/failed")
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "batch").alias("r")).select(key, "r.*").drop("batch").join(done, key, "left_anti")
