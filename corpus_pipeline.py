"""From raw documents to a training mixture: quality rules, near-duplicates, benchmark passages, secrets, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A
stage's result is written and read again before the next one starts, so a lost executor costs one stage at most.

In all stages a null text is an empty one, nulls in other columns are values like others, columns beside those of
documents stay whatever their names, and an empty table gives an empty one. Texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import materialise, others, packed, table
from lectern.llm.decontamination import find_contamination
from lectern.llm.mixing import mix_sources
from lectern.llm.near_dedup import near_duplicates
from lectern.llm.quality_rules import quality_rules
from lectern.llm.secret_scans import redacted, secret_scans


#: The other columns of a document while an operator is at work, so that no name of theirs meets a result's.
ROW = "_document"


def _apart(docs: DataFrame, *needed: str) -> DataFrame:
    return docs.select(*needed, packed(docs, others(docs, *needed), ROW))


def _together(docs: DataFrame, changed: DataFrame, *needed: str, **new) -> DataFrame:
    """The columns of docs out of what _apart() has made of them, some of them new."""
    own = lambda c: new[c] if c in new else F.col(c) if c in needed else F.col(ROW).getField(c)
    return changed.select(*[own(c).alias(c) for c in docs.columns])


def _with_text(docs: DataFrame, changed: DataFrame, text, *needed: str) -> DataFrame:
    """The columns of docs, with another text; n_chars follows it."""
    size = {"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return _together(docs, changed, *needed, text=text, **size)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule are taken out; documents that are rejected go, those without words among them. Repeated rows are
    judged each by itself."""
    judged = quality_rules(_apart(docs, "text")).where("kept")
    return _with_text(docs, judged, F.when(F.size("line_faults") > 0, F.col("cleaned_text")).otherwise(F.col("text")), "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the least doc_id. Of rows with equal doc_id and text one stays; where
    their other columns differ, the one that is first when they are written as JSON."""
    first = near_duplicates(_apart(docs, "doc_id", "text")).where("is_first")
    one = first.where("n_equal > 1").groupBy("doc_id", "text").agg(F.min_by(ROW, F.to_json(ROW)).alias(ROW))
    return _together(docs, first.where("n_equal = 1").select("doc_id", "text", ROW).unionByName(one), "doc_id", "text")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, repeated rows together; those without words stay."""
    found = find_contamination(_apart(docs, "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return _together(docs, found.where("NOT contaminated"), "doc_id", "text")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay, repeated rows too."""
    found = secret_scans(_apart(docs, "doc_id", "text"))
    return _with_text(docs, found, redacted(F.col("text"), F.col("all_spans")), "doc_id", "text")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' uses in the mixture, with their places. Documents without words have none; ties in places go by doc_id."""
    return mix_sources(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scans", secrets),
    ("mixing", mixing),
]

#: Near-duplicates by similarity and components can't be put in SQL. tests/llm holds each stage's operator against a plain
#: version or SQL, and the stages one after the other against what they may change.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
