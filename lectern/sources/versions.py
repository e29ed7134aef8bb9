"""Tables in versions: a new version is written beside the old one, and readers see it when its manifest is there.

A manifest is a small file with a rising number, put in place by a rename; the highest one holds. A run that is cancelled or
fails leaves no manifest, so what was complete before stays readable.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _manifests(spark: SparkSession, root: str) -> list[int]:
    fs, folder = _fs(spark, f"{root}/_manifests")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def manifest(spark: SparkSession, root: str) -> dict | None:
    """version, stamp, tables of the version that holds; null before the first."""
    numbers = _manifests(spark, root)
    if not numbers:
        return None
    text = spark.read.option("wholetext", True).text(f"{root}/_manifests/{numbers[-1]:08d}.json").first()
    return json.loads(text[0])


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the version that holds."""
    found = manifest(spark, root)
    if found is None or name not in found["tables"]:
        raise FileNotFoundError(f"{root} has no table {name}")
    return spark.read.parquet(f"{root}/{found['version']}/{name}")


def publish(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], stamp: Mapping[str, str] | None = None) -> dict:
    """Write tables as a new version and let it hold. Where another run came first with the same number, this one fails and
    its version never holds. Returns the manifest."""
    numbers = _manifests(spark, root)
    version = f"v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    said = {"version": version, "stamp": dict(stamp or {}), "tables": sorted(tables)}
    fs, draft = _fs(spark, f"{root}/_manifests/.{version}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(said).encode()))
    out.close()
    number = (numbers or [0])[-1] + 1
    _, place = _fs(spark, f"{root}/_manifests/{number:08d}.json")
    if fs.exists(place) or not fs.rename(draft, place):
        fs.delete(draft, False)
        raise RuntimeError(f"another run has published version {number} of {root}")
    return said


def rebuilt(spark: SparkSession, root: str, wanted: Mapping[str, str], build: Callable[[], Mapping[str, DataFrame]]) -> bool:
    """Publish what build gives if no version was made for what is wanted (sizes, versions and names of models and parsers).
    Whether it was done. Everything derived is made anew then; nothing of another stamp is kept beside it."""
    found = manifest(spark, root)
    if found is not None and found["stamp"] == dict(wanted):
        return False
    publish(spark, root, build(), wanted)
    return True


def clear_old(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Remove all versions but the last ones, and what cancelled runs have left; how many folders went. Not for use while
    another run writes."""
    numbers = _manifests(spark, root)
    held = set()
    for n in numbers[-keep:]:
        held.add(json.loads(spark.read.option("wholetext", True).text(f"{root}/_manifests/{n:08d}.json").first()[0])["version"])
    fs, folder = _fs(spark, root)
    gone = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("v-") and s.getPath().getName() not in held]
    for path in gone:
        fs.delete(path, True)
    for n in numbers[:-keep]:
        fs.delete(_fs(spark, f"{root}/_manifests/{n:08d}.json")[1], False)
    return len(gone)


def memoised(spark: SparkSession, root: str, listing: DataFrame, derive: Callable[[DataFrame], DataFrame], name: str = "derived", key: Sequence[str] = ("path",)) -> DataFrame:
    """The derived rows of files (listing: key, mtime and what derive needs), where only new and changed files are derived.

    derive gives rows with key. What is held of a file counts as long as its key and mtime are the same; files that are no
    longer listed go. A key that is listed twice counts with its latest mtime. The result is a new version of root.
    """
    own = [*key, "mtime"]
    latest = listing.groupBy(*key).agg(F.max_by(F.struct(*[c for c in listing.columns if c not in key]), "mtime").alias("l")).select(*key, "l.*")
    if manifest(spark, root) is None:
        held, due = None, latest
    else:
        held = current(spark, root, name).join(latest.select(*own), own, "left_semi")
        done = current(spark, root, "files").join(latest.select(*own), own, "left_semi")
        due = latest.join(done, own, "left_anti")
    new = derive(due).join(due.select(*own), list(key))
    publish(spark, root, {name: new if held is None else held.unionByName(new), "files": latest.select(*own)})
    return current(spark, root, name)
