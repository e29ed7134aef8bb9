"""Hybrid search as one plan: vectors and text ranked, fused, guarded, boosted, capped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.operators import retrieval as R


def hybrid_search(
    chunks: DataFrame, papers: DataFrame, questions: DataFrame, section: list[str], cap_by: str,
    intent: str = "semantic", recall: int = 50, fused: int = 240, cap: int = 4, most: int = 10, scope=None, score_pairs=None, head: int = 40,
) -> DataFrame:
    """query_id, id, what cap_by names, score of each question's hits.

    score_pairs: a model for the first head hits of each question (rows with query_id and id; it adds model_score), whose
    order then comes before the scores'.

    chunks: id, paper_id, vec. papers: id, text and what section and cap_by name. questions: query_id, vec, terms. Both
    lists are cut before the scope (a condition on papers) is looked at, unless it is given to the callers' own tables.
    """
    by = ["query_id"]
    vectors = R.nearest(chunks, questions.where("vec IS NOT NULL"), recall)
    texts = R.text_search(papers, questions, recall)
    by_vector, by_text = R.weights(intent)
    fused_ = R.fuse([(vectors, by_vector), (texts, by_text)], ["query_id", "id"])
    ranked = R.top(fused_, fused, "seen", "id", by=by).drop("pos")
    own = papers if scope is None else papers.where(scope)
    guarded = ranked.join(own.select("id", *dict.fromkeys([*section, cap_by])), "id")
    boosted = R.section_boost(guarded, [*by, *section])
    order = [F.desc("boosted"), F.col("seen"), F.col("id")]
    if score_pairs is not None:
        placed = boosted.withColumn("pos", (F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1).cast("long"))
        boosted, order = R.rerank(placed, score_pairs, head, by), [F.col("pos")]
    kept = R.capped(boosted, [*by, cap_by], cap, order)
    return R.capped(kept, by, most, order).select("query_id", "id", cap_by, F.round("boosted", 6).alias("score"))


def recalled(chunks: DataFrame, paper_vectors: DataFrame, questions: DataFrame, title_hits: DataFrame, covered: DataFrame, room: int, most_covered: int) -> DataFrame:
    """query_id, paper_id, score: the room best papers that a search (which kept most_covered rows at most) left out.

    chunks, paper_vectors: id, paper_id, vec. Of each question only the best papers by chunks and by their own vectors are
    looked at, and those whose titles are hit, whose scores are asked for one by one; no list holds all papers.
    """
    k = room + most_covered
    by_chunk = R.nearest_of_group(chunks, questions, k).select("query_id", "paper_id", "score")
    by_own = R.nearest_of_group(paper_vectors, questions, k).select("query_id", "paper_id", "score")
    has_chunks = by_own.join(chunks.select("paper_id").distinct(), "paper_id", "left_semi").withColumn("score", F.lit(-1.0))
    best = by_chunk.unionByName(R.scores_of(chunks, questions, title_hits)).unionByName(has_chunks)
    own = by_own.unionByName(R.scores_of(paper_vectors, questions, title_hits))
    return R.recall(best, own, title_hits, covered, room, F.col("chunk_score").isNotNull(), by=["query_id"])


def with_context(hits: DataFrame, texts: DataFrame, most: int = 4500) -> DataFrame:
    """hits (query_id, id and what else) with context: each hit's text with its neighbours of the same section, as far as most
    characters reach. texts: id, paper_id, section, ord, text. Neighbours are looked up only for sections that were hit."""
    hit = texts.join(hits.select("id").distinct(), "id", "left_semi").select("paper_id", "section").distinct()
    around = R.expanded(R.neighbours(texts.join(hit, ["paper_id", "section"], "left_semi")), most)
    return hits.join(around.select("id", "context"), "id", "left")
