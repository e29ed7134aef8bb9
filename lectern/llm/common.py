"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.sources.shared import materialise, new_folder, scratch, shared_dir  # noqa: F401  used by the operators

#: ASCII white space: what separates words in the contracts.
BLANKS = " \t\n\x0b\x0c\r"
MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def others(df: DataFrame, *named: str) -> list[str]:
    """The columns of df but those."""
    return [c for c in df.columns if c not in named]


def packed(df: DataFrame, columns: list[str], name: str = "_row") -> Column:
    """Those columns of df as one struct, so that no name of theirs meets another."""
    return F.struct(*[F.col(f"`{c}`") for c in columns]).alias(name) if columns else F.struct(F.lit(None).alias("_none")).alias(name)


def unpacked(df: DataFrame, columns: list[str], *more: Column | str, name: str = "_row") -> DataFrame:
    """The columns that packed() took, then more."""
    return df.select(*[F.col(name).getField(c).alias(c) for c in columns], *more)


def map_rows(df: DataFrame, column: str, added: str, work: Callable[[pa.Array], Iterator[tuple[int, int, list[pa.Array]]]]) -> DataFrame:
    """The rows of df with further columns (DDL in added; columns of df with such names are replaced), from Arrow batches.

    work gets a batch's values of one column and gives from, to and the new values for stretches of it, in order. Inside,
    columns are known by place, so their names don't matter.
    """
    kinds = StructType.fromDDL(added)
    columns = others(df, *kinds.names)
    own = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.col(f"`{column}`").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*(f"c{i}" for i in range(len(columns))), *(f"new{i}" for i in range(len(kinds)))]
        for batch in batches:
            for a, b, new in work(batch.column(len(columns))):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:-1], *new], names=names)

    schema = StructType(own.schema.fields[:-1])
    for i, field in enumerate(kinds):
        schema = schema.add(f"new{i}", field.dataType)
    return own.mapInArrow(run, schema).toDF(*columns, *kinds.names)


def word_array(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, in order; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))
