import importlib.util

import pytest
from tests.llm.plain import SF

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < sizes[0]
    last = {r["doc_id"]: r for r in docs.collect()}
    assert len(last) == sizes[-1] and all(len(r["text"]) == r["n_chars"] for r in last.values())
    assert any(before[i] == r["text"] for i, r in last.items())
    mixed = {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert mixed and mixed <= set(last)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == mixed


def test_equal_rows_stay_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert stage(spark, docs.union(docs).union(docs), SF).count() == stage(spark, docs, SF).count()


def test_entry_lists_all():
    spec = importlib.util.find_spec("__spark_entry__")
    assert spec
    import __spark_entry__ as e

    names = set(e.queries())
    assert {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(e.oracle_sql()) <= names


def test_stages_at_the_edges(spark):
    """Nulls in every column, empty and repeated rows, no rows at all, and columns named as results are."""
    from pyspark.sql import functions as F
    from tests.llm.plain import EDGES, docs_of

    good = " ".join(f"word{i}" for i in range(60)) + "."
    docs = docs_of(spark, [*EDGES, good, good, (None, good), (77, good), (77, good)]).withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang"))).withColumn("source", F.when(F.col("doc_id") % 4 != 0, F.col("source"))).withColumn("n_chars", F.lit(None).cast("long"))
    docs = docs.unionByName(docs.where("doc_id = 77").withColumn("lang", F.lit("zz")))
    docs = docs.withColumns({c: F.lit(1) for c in ("kept", "is_first", "n_equal", "contaminated", "all_spans", "_row", "id")}).withColumnRenamed("id", "a.b")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        first, again = sorted(out.collect(), key=str), sorted(stage(spark, docs.repartition(7), SF).collect(), key=str)
        assert first == again, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        if name == "near_dedup":
            assert [r["lang"] for r in first if r["doc_id"] == 77] in ([], ["en"]) and sum(r["text"] == good for r in first) == 1
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert mixed.count() > 0 and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
