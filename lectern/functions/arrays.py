"""Arrays cut into stretches, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import bound


def divided_at(items: Column, starts: Column) -> Column:
    """items as the stretches that begin at starts (places from 1, rising)."""
    return bound(starts, lambda at: F.transform(at, lambda s, i: F.slice(items, s, F.coalesce(F.get(at, i + 1), F.size(items) + 1) - s)))


def filled_starts(sizes: Column, most: int) -> Column:
    """Where stretches begin that are filled in order up to most each: at the first, and where the running sum of a stretch
    would go beyond. What is larger than most stands alone."""
    none = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("starts"))
    placed = F.transform(sizes, lambda n, i: F.struct(n.cast("long").alias("n"), (i + 1).alias("i")))
    new = lambda s, x: (x["i"] == 1) | (s["used"] + x["n"] > most)
    step = lambda s, x: F.when(new(s, x), F.struct(x["n"].alias("used"), F.array_append(s["starts"], x["i"]).alias("starts"))).otherwise(F.struct((s["used"] + x["n"]).alias("used"), s["starts"].alias("starts")))
    return F.aggregate(placed, none, step, lambda s: s["starts"])


def summed(items: Column, size) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + size(x))
