"""Numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Values of the order that are looked at to find where to divide it, and stretches that it is divided into. They decide
#: only how even the stretches are.
SAMPLED, STRETCHES = 4096, 64


def numbered(df: DataFrame, key: str, order: str, out: str = "_k") -> DataFrame:
    """df with each row's number (from 1) among the rows of its key, by order.

    The order is divided into stretches, the same for all keys. Rows are numbered within a key's stretch and stretches
    start where the counts of those before them end, so no task numbers a whole key. A null key is a key; null orders come
    first; rows equal in both get numbers in any order.
    """
    n = df.count()
    sampled = df.select(order).where(F.col(order).isNotNull())
    sampled = sampled.sample(min(1.0, SAMPLED / n), seed=1) if n else sampled
    found = sorted({r[0] for r in sampled.limit(2 * SAMPLED).collect()})
    bounds = found[:: max(1, len(found) // STRETCHES)][1:]
    kind = df.schema[order].dataType
    ends = F.array(*[F.lit(b).cast(kind) for b in bounds]) if bounds else F.array().cast(f"array<{kind.simpleString()}>")
    at = F.coalesce(F.size(F.filter(ends, lambda b: b <= F.col(order))), F.lit(-1))
    rows = df.withColumn("_at", F.when(F.col(order).isNull(), -1).otherwise(at))
    counts = rows.groupBy(F.col(key).alias("_key"), F.col("_at").alias("_s")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_key").orderBy("_s").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    counts = counts.select("_key", "_s", before.alias("_before"))
    rows = rows.withColumn("_within", F.row_number().over(W.partitionBy(key, "_at").orderBy(order)))
    rows = rows.join(counts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_at") == F.col("_s")))
    return rows.withColumn(out, (F.col("_before") + F.col("_within")).cast("int")).drop("_key", "_s", "_before", "_within", "_at")
