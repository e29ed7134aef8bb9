"""A folder of papers as tables: which files there are, and what their notes say."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import title_from_slug
from lectern.operators.numbering import numbered
from lectern.sources.shared import materialise


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to root), size, modified of all files below root; only listings are read, not contents."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.instr("path", root.rstrip("/").removeprefix("file:")) + len(root.rstrip("/").removeprefix("file:")) + 1
    return found.select(F.col("path").substr(at, F.length("path")).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def scan(files: DataFrame) -> DataFrame:
    """path, category, slug of one PDF for each folder <category>/<slug>/: paper.pdf, else the first by name. A folder
    papers/ on top is passed over, hidden folders are left out, numbers before a category's name are taken off."""
    inner = files.withColumn("p", F.regexp_replace("path", "^papers/", ""))
    parts = F.split("p", "/")
    pdf = inner.where((F.size(parts) == 3) & F.lower("p").endswith(".pdf") & ~F.col("p").rlike(r"(^|/)\."))
    named = pdf.select("path", F.regexp_replace(parts[0], r"^\d+-", "").alias("category"), parts[1].alias("slug"), parts[0].alias("folder"), parts[2].alias("name"))
    best = named.groupBy("folder", "category", "slug").agg(F.min_by("path", F.struct(F.lower("name") != "paper.pdf", "name")).alias("path"))
    return best.select("path", "category", "slug")


def scan_flat(files: DataFrame, root_name: str = "") -> DataFrame:
    """PDFs that lie directly in the root; their category is the root's name, or inbox."""
    flat = files.where(F.lower("path").endswith(".pdf") & ~F.col("path").contains("/") & ~F.col("path").startswith("."))
    return flat.select("path", F.lit(root_name or "inbox").alias("category"), F.regexp_replace("path", r"(?i)\.pdf$", "").alias("slug"))


def collect_imports(files: DataFrame, library: str, limit: int = 800) -> DataFrame:
    """PDFs to import: up to three folders deep, none of the library itself, equal paths (but for case) once, limit at most."""
    pdf = files.where(F.lower("path").endswith(".pdf") & (F.size(F.split("path", "/")) <= 4) & ~F.col("path").startswith(library.rstrip("/") + "/"))
    once = pdf.groupBy(F.lower("path").alias("low")).agg(F.min("path").alias("path"))
    return once.orderBy("low").limit(limit).select("path")


_BLOCK = re.compile(r"^[|>][+-]?$")


def parse_note(text: str | None) -> dict[str, str]:
    """The front matter of a note: key: value lines between two --- lines, lists as a,b, block scalars joined by spaces;
    without a title the first heading is it."""
    out: dict[str, str] = {}
    m = re.match(r"---\n(.*?)\n---", text or "", re.S)
    if m:
        key = None
        for line in m[1].split("\n"):
            found = re.match(r"([A-Za-z_][\w-]*):\s*(.*)$", line)
            if found and not line[:1].isspace():
                name, value = found[1], found[2].strip()
                key = name if _BLOCK.match(value) else None
                if key:
                    out[key] = ""
                elif value.startswith("[") and value.endswith("]"):
                    out[name] = ",".join(x.strip().strip("\"'") for x in value[1:-1].split(","))
                else:
                    out[name] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
            elif key and line.strip():
                out[key] = f"{out[key]} {line.strip()}".strip()
    if not out.get("title") and (h := re.search(r"^#\s+(.+)$", text or "", re.M)):
        out["title"] = h[1].strip()
    return out


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def note_fields(text: pd.Series) -> pd.Series:
    return text.map(parse_note)


def described(found: DataFrame, notes: DataFrame) -> DataFrame:
    """found with title, authors, year, venue from the folder's note (path, content), else from its slug."""
    said = notes.select(F.regexp_replace("path", r"[^/]*$", "").alias("folder"), note_fields("content").alias("note"))
    own = found.withColumn("folder", F.regexp_replace("path", r"[^/]*$", ""))
    joined = own.join(said.groupBy("folder").agg(F.first("note").alias("note")), "folder", "left")
    said_year = F.expr("try_cast(note['year'] AS int)")
    return joined.select(
        "path", "category", "slug",
        F.coalesce(F.expr("nullif(note['title'], '')"), title_from_slug(F.col("slug"))).alias("title"),
        F.coalesce(F.expr("note['authors']"), F.lit("")).alias("authors"),
        F.nullif(F.coalesce(said_year, year_of_slug(F.col("slug"))), F.lit(0)).alias("year"),
        F.coalesce(F.expr("note['venue']"), F.lit("")).alias("venue"),
    )


def year_of_slug(slug: Column) -> Column:
    return F.when(F.substring(slug, 1, 4).rlike(r"^\d{4}$"), F.substring(slug, 1, 4).try_cast("int"))


def unique_slugs(df: DataFrame, slug: str = "slug", order: str = "path") -> DataFrame:
    """Each slug once: the k-th of equal ones gets -k, the first by order keeps it. Where that meets a slug that was there
    from the start, it is done again. Each round is written to the shared folder."""
    done = df
    while True:
        done = numbered(done, slug, order)
        done = done.withColumn(slug, F.when(F.col("_k") > 1, F.concat(slug, F.lit("-"), F.col("_k").cast("string"))).otherwise(F.col(slug))).drop("_k")
        done = materialise(done)
        if not done.groupBy(slug).count().where("count > 1").limit(1).count():
            return done
