"""Upkeep of a library's tables, and what is counted over them. Tables are rewritten, never changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, overwrite: list[str]) -> DataFrame:
    """old with the rows of new: for keys that new has, the columns to overwrite come from new, nulls and all; others
    stay. state tells added, updated or kept."""
    n = new.select(F.col(key).alias("_key"), F.struct(*overwrite).alias("_new"))
    joined = old.withColumn("_old", F.lit(True)).join(n, old[key] == n["_key"], "full")
    pick = [F.coalesce(key, "_key").alias(c) if c == key else (F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in overwrite else F.col(c)) for c in old.columns]
    state = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNotNull(), "updated").otherwise("kept")
    return joined.select(*pick, state.alias("state"))


def guarded_upsert(old: DataFrame, new: DataFrame, key: str, overwrite: list[str], guard: Column) -> DataFrame:
    """As upsert, but rows of old for which guard holds stay as they are."""
    fixed = old.where(guard).select(key)
    return upsert(old, new.join(fixed, key, "left_anti"), key, overwrite)


def drop_stale(papers: DataFrame, listing: DataFrame, root: str) -> DataFrame:
    """Papers under root whose path is still listed."""
    return papers.where(F.col("path").startswith(root)).join(listing.select("path").distinct(), "path", "left_semi")


def drop_orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return children.join(parents.select(F.col(parent_key).alias("_p")).distinct(), F.col(child_key) == F.col("_p"), "left_semi")


def without(tables: dict[str, tuple[DataFrame, str]], doomed: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table (and its column that refers to the doomed) without the doomed rows."""
    gone = doomed.select(F.col(key).alias("_gone")).distinct()
    return {name: df.join(gone, F.col(c) == F.col("_gone"), "left_anti") for name, (df, c) in tables.items()}


def fill_missing(df: DataFrame, found: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Empty or null columns of df filled from found; what is there stays."""
    f = found.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_f_{c}") for c in columns])
    joined = df.join(f, df[key] == f["_key"], "left")
    fill = lambda c: F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.coalesce(f"_f_{c}", c)).otherwise(F.col(c)).alias(c)
    return joined.select(*[fill(c) if c in columns else F.col(c) for c in df.columns])


def due(items: DataFrame, tried: DataFrame, key: str, now: Column, days: int = 7) -> DataFrame:
    """Items never tried, or tried longer ago than so many days. tried: key, at."""
    t = tried.groupBy(F.col(key).alias("_key")).agg(F.max("at").alias("_at"))
    joined = items.join(t, items[key] == t["_key"], "left")
    return joined.where(F.col("_at").isNull() | (F.col("_at") < now - F.expr(f"INTERVAL {days} DAYS"))).drop("_key", "_at")


def needs_rebuild(papers: DataFrame, chunks: DataFrame, built: dict, wanted: dict) -> bool:
    """Whether derived tables are of another version, or rows are missing in them."""
    if any(built.get(k) != v for k, v in wanted.items()):
        return True
    return papers.where("NOT indexed").limit(1).count() > 0 or chunks.join(papers.select("id"), F.col("paper_id") == F.col("id"), "left_anti").limit(1).count() > 0


def category_counts(papers: DataFrame) -> DataFrame:
    return papers.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def categories_with_empty(papers: DataFrame, manual: DataFrame) -> DataFrame:
    """category, n of all names that papers or the manual list have."""
    counts = papers.where(F.coalesce("category", F.lit("")) != "").groupBy("category").agg(F.count("*").alias("n"))
    return manual.select("category").distinct().join(counts, "category", "full").select("category", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def latest_titles(papers: DataFrame, most: int = 8) -> DataFrame:
    """category, n, titles: the latest so many, one to a line."""
    ranked = papers.withColumn("_k", F.row_number().over(W.partitionBy("category").orderBy(F.desc("id")))).where(F.col("_k") <= most)
    titles = ranked.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "title"))), lambda s: s["title"]), "\n").alias("titles"))
    return category_counts(papers).join(titles, "category")


def recents(papers: DataFrame, most: int = 60) -> DataFrame:
    """By when they were opened, else added."""
    return papers.orderBy(F.desc(F.coalesce("opened_at", "added_at")), "id").limit(most)


def matching(papers: DataFrame, words: str) -> DataFrame:
    """Title or authors contain the words, whatever the case, or the slug as it is. No words: all."""
    if not words:
        return papers
    low = words.lower()
    return papers.where(F.lower("title").contains(low) | F.lower("authors").contains(low) | F.col("slug").contains(words))


def palette(commands: DataFrame, papers: DataFrame, words: str, most: int = 30) -> DataFrame:
    """kind, label: commands first, then at most so many papers, where title, category or year has the words."""
    low = words.lower()
    cmd = commands.where(F.lower("label").contains(low)).select(F.lit("command").alias("kind"), "label")
    hit = F.lower("title").contains(low) | F.lower("category").contains(low) | F.coalesce(F.col("year").cast("string"), F.lit("")).contains(low)
    return cmd.unionByName(papers.where(hit).orderBy("id").limit(most).select(F.lit("paper").alias("kind"), F.col("title").alias("label")))


def title_keywords(papers: DataFrame, stop: list[str], k: int, least: int = 2) -> DataFrame:
    """word, df: words of titles by the number of papers that have them; where fewer than k are in least papers, the
    longest of the most frequent."""
    words = F.array_distinct(F.transform(F.regexp_extract_all("title", F.lit("[A-Za-z][A-Za-z0-9-]{2,}"), F.lit(0)), F.lower))
    df = papers.select(F.explode(words).alias("word")).where(~F.col("word").isin(stop)).groupBy("word").agg(F.count("*").alias("df"))
    first = df.orderBy(F.desc("df"), "word").limit(max(4 * k, 12))
    strong = F.count_if(F.col("df") >= least).over(W.partitionBy())  # over max(4k, 12) rows
    ranked = first.withColumn("_strong", strong)
    order = W.orderBy(F.when(F.col("_strong") >= k, F.lit(0)).otherwise(-F.length("word")), F.desc("df"), "word")
    return ranked.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).select("word", "df")


def next_category_number(categories: DataFrame) -> DataFrame:
    """prefix: one above the largest number that starts a name, two digits at least."""
    number = F.regexp_extract("category", r"^(\d+)-", 1).try_cast("int")
    return categories.agg(F.lpad((F.coalesce(F.max(number), F.lit(0)) + 1).cast("string"), 2, "0").alias("prefix"))


def ranked_urls(candidates: DataFrame, most: int = 5) -> DataFrame:
    """key, url, rank: http urls, each once whatever its case; an open-access index first, then .pdf, arxiv, others."""
    c = candidates.withColumn("url", F.trim("url")).where(F.lower("url").rlike("^https?://")).withColumn("_low", F.lower("url"))
    once = c.groupBy("key", "_low").agg(F.min_by(F.struct("url", "open", "ord"), "ord").alias("s")).select("key", "_low", "s.*")
    w = F.when(F.col("open"), 0).when(F.col("_low").endswith(".pdf"), 1).when(F.col("_low").contains("arxiv"), 2).otherwise(3)
    out = once.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(w, "ord")).cast("long"))
    return out.where(F.col("rank") <= most).select("key", "url", "rank")


def extended_schema(df: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """df with the columns that it lacks, at their defaults: name -> (type, value)."""
    return df.select("*", *[F.lit(v).cast(t).alias(c) for c, (t, v) in defaults.items() if c not in df.columns])


def category_names(papers: DataFrame, more: DataFrame) -> DataFrame:
    """category: the names that papers or more (category) have, each once, in the order of a reader's language; empty and
    null ones aren't names."""
    named = papers.select("category").unionByName(more.select("category")).where("category <> ''").distinct()
    return named.orderBy(F.collate("category", "UNICODE"))
