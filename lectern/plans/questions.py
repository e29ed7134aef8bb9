"""Questions made ready for a search: rules, and what a model says of them where it says it in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import intent, keywords, loose_json, search_terms

# Fixed value: the longest question that is passed on as it is.
SHORT = 1
REPLY = "query string, intent string, keywords array<string>"


def prepared(questions: DataFrame, replies: DataFrame | None = None, title_hits: DataFrame | None = None) -> DataFrame:
    """query_id, query, terms, fts, intent of questions (query_id, q).

    Rules give keywords and intent (a title in title_hits (query_id) makes it exact). replies (query_id, reply): what a model
    has answered in time, JSON with query, intent and keywords, maybe among other text; what of it is usable comes before
    the rules, and nothing else is lost if it isn't. terms are what to search for, fts the same as one expression; without
    any, the question itself. A null question is empty; one of a character is passed on as it is. Of several replies to a
    question the first in their order counts.
    """
    known = questions.select("query_id", F.trim(F.coalesce("q", F.lit(""))).alias("q"))
    said = F.lit(None).cast("string")
    if replies is not None:
        first = replies.groupBy("query_id").agg(F.min("reply").alias("reply"))
        known, said = known.join(first, "query_id", "left"), F.col("reply")
    hit = F.lit(False)
    if title_hits is not None:
        known, hit = known.join(title_hits.select("query_id", F.lit(True).alias("hit")).distinct(), "query_id", "left"), F.coalesce("hit", F.lit(False))
    known = known.select("query_id", "q", intent(F.col("q"), hit).alias("rule"), keywords(F.col("q")).alias("own"), F.from_json(loose_json(said), REPLY).alias("r"))
    given = F.filter(F.transform(F.coalesce("r.keywords", F.array().cast("array<string>")), lambda k: F.trim(k)), lambda k: F.length(k) >= 2)
    query = F.coalesce(F.nullif(F.trim("r.query"), F.lit("")), F.col("q"))
    wanted = F.when(F.col("r.intent").isin("exact", "semantic"), F.col("r.intent")).otherwise(F.col("rule"))
    terms = search_terms(F.array_distinct(F.concat(given, "own")))
    full = known.select("query_id", "q", query.alias("query"), terms.alias("terms"), wanted.alias("intent"))
    fts = F.array_join(F.transform("terms", lambda k: F.when(F.contains(k, F.lit(" ")), F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k)), " OR ")
    short = F.length("q") <= SHORT
    none = F.array().cast("array<string>")
    return full.select(
        "query_id", F.when(short, F.col("q")).otherwise(F.col("query")).alias("query"), F.when(short, none).otherwise(F.col("terms")).alias("terms"),
        F.when(short | (F.size("terms") == 0), F.col("q")).otherwise(fts).alias("fts"), F.when(short, "semantic").otherwise(F.col("intent")).alias("intent"),
    )
