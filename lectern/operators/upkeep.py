"""Changes that users make to a library, what is derived from metadata, and what a model is given to read.

Every change takes tables and gives new ones: a change list is a table too, so any number of changes is one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import bigrams, category_label, dice, norm_title
from lectern.operators.bibliography import parsed

#: Titles and venues of services that only point at other works.
AGGREGATORS = "(?i)faculty opinions|post-publication peer review"
POINTERS = AGGREGATORS + "|recommendation of"


# ---- Papers and categories ------------------------------------------------------------------------------------------


def renamed(papers: DataFrame, changes: DataFrame, size: int = 300) -> DataFrame:
    """papers (id, title, pvec) with the titles of changes (id, title), white space collapsed, size characters at most. The
    paper's own vector goes, so that only it is made again. Blank titles change nothing."""
    new = F.substring(F.trim(F.regexp_replace("title", "\\s+", " ")), 1, size)
    said = changes.select(F.col("id").alias("_id"), new.alias("_title")).where("_title <> ''")
    joined = papers.join(said, papers["id"] == F.col("_id"), "left")
    new = {"title": F.coalesce("_title", "title"), "pvec": F.when(F.col("_id").isNull(), F.col("pvec"))}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in papers.columns])


def moved(papers: DataFrame, changes: DataFrame) -> DataFrame:
    """papers with the categories of changes (id, category); all else of a row stays."""
    said = changes.select(F.col("id").alias("_id"), F.col("category").alias("_to"))
    joined = papers.join(said, papers["id"] == F.col("_id"), "left")
    return joined.select(*[F.coalesce("_to", "category").alias(c) if c == "category" else F.col(c) for c in papers.columns])


def category_slug(name: Column) -> Column:
    """A category's new name: small letters, digits and dashes; null where nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9-]+", "-"), "^-+|-+$", "")
    return F.nullif(plain, F.lit(""))


def deletable(categories: DataFrame, papers: DataFrame) -> DataFrame:
    """category, n, ok: only a category without papers may go."""
    n = papers.groupBy(F.col("category").alias("_c")).agg(F.count("*").alias("n"))
    joined = categories.select("category").distinct().join(n, F.col("category") == F.col("_c"), "left")
    return joined.select("category", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.col("n").isNull().alias("ok"))


def catalogue(papers: DataFrame) -> DataFrame:
    """By category, year (unknown first), slug."""
    return papers.orderBy("category", F.asc_nulls_first("year"), "slug")


def without_venue(papers: DataFrame) -> DataFrame:
    """Papers that lack a venue, the newest first."""
    return papers.where(F.coalesce("venue", F.lit("")) == "").orderBy(F.desc("id"))


def indexed(papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """papers with indexed and n_pages, as their chunks (paper_id, page) tell."""
    found = chunks.groupBy(F.col("paper_id").alias("_p")).agg(F.max("page").alias("_n"))
    kept = [c for c in papers.columns if c not in ("indexed", "n_pages")]
    return papers.join(found, papers["id"] == F.col("_p"), "left").select(*kept, F.col("_p").isNotNull().alias("indexed"), F.coalesce("_n", F.lit(0)).alias("n_pages"))


def paper_header(first_page: Column, size: int = 1400) -> Column:
    """The text that a paper's own vector is made of."""
    lines = [F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit(""))) for name, c in (("Title", F.col("title")), ("Authors", F.col("authors")), ("Venue", F.col("venue")), ("Category", category_label(F.col("category"))))]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n\n"), F.substring(F.regexp_replace(F.coalesce(first_page, F.lit("")), "\\s+", " "), 1, size))


def lacking_derived(papers: DataFrame, derived: DataFrame) -> DataFrame:
    """Papers without a row in derived (id): those that only need that."""
    return papers.join(derived.select("id").distinct(), "id", "left_anti")


def with_category(text: Column, category: Column) -> Column:
    """A chunk's text as it is embedded: its category in front."""
    return F.concat(F.lit("【"), category_label(category), F.lit("】"), text)


# ---- Chats and highlights -------------------------------------------------------------------------------------------


def chats_named(chats: DataFrame, words: str) -> DataFrame:
    """Chats whose titles hold the words, whatever the case."""
    return chats.where(F.contains(F.lower("title"), F.lit(words.lower())))


def chats_renamed(chats: DataFrame, changes: DataFrame, default: str = "New chat", size: int = 60) -> DataFrame:
    said = changes.select(F.col("id").alias("_id"), F.coalesce(F.nullif(F.substring("title", 1, size), F.lit("")), F.lit(default)).alias("_title"))
    joined = chats.join(said, chats["id"] == F.col("_id"), "left")
    return joined.select(*[F.coalesce("_title", "title").alias(c) if c == "title" else F.col(c) for c in chats.columns])


def messages_replaced(messages: DataFrame, new: DataFrame) -> DataFrame:
    """messages (chat_id, turn, role, text) where each chat that new has is new's: blank ones are passed over, turns count
    from 0 again, and whoever isn't the user is the assistant."""
    kept = messages.join(new.select("chat_id").distinct(), "chat_id", "left_anti").select("chat_id", "turn", "role", "text")
    order = W.partitionBy("chat_id").orderBy("turn")
    said = new.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    said = said.select("chat_id", (F.row_number().over(order) - 1).cast("long").alias("turn"), F.when(F.col("role") == "user", "user").otherwise("assistant").alias("role"), "text")
    return kept.unionByName(said)


def touched(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """chats with updated_at: when the last of their messages (chat_id, created_at) came, if there are any."""
    last = messages.groupBy(F.col("chat_id").alias("_c")).agg(F.max("created_at").alias("_at"))
    joined = chats.join(last, chats["id"] == F.col("_c"), "left")
    return joined.select(*[F.coalesce("_at", "updated_at").alias(c) if c == "updated_at" else F.col(c) for c in chats.columns])


def highlighted(marks: DataFrame, size: int = 500) -> DataFrame:
    """marks (paper_id, page, rects, text) as they are kept: rects as JSON, texts cut."""
    return marks.select("paper_id", "page", F.to_json("rects").alias("rects"), F.substring("text", 1, size).alias("text"))


def marks_of(marks: DataFrame, paper_id: int, rects: str = "array<struct<x: double, y: double, w: double, h: double>>") -> DataFrame:
    """A paper's marks (as highlighted() keeps them, with id and created_at) in reading order, rects read back."""
    own = marks.where(F.col("paper_id") == paper_id)
    return own.withColumn("rects", F.from_json("rects", rects)).orderBy("page", "created_at", "id")


def marks_without(marks: DataFrame, doomed: DataFrame) -> DataFrame:
    """marks without those of doomed (id)."""
    return marks.join(doomed.select("id").distinct(), "id", "left_anti")


# ---- Metadata -------------------------------------------------------------------------------------------------------


def author_names(authors: Column) -> Column:
    """Names of an array of (given, family), with commas between; blank ones go."""
    names = F.transform(authors, lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"])))
    return F.array_join(F.filter(names, lambda n: n != ""), ", ")


def open_access(records: DataFrame) -> DataFrame:
    """key, ord, url of records (key, best, locations): the best place first, then all places, blanks left out."""
    places = F.concat(F.array("best"), F.coalesce("locations", F.array().cast("array<string>")))
    urls = records.select("key", F.posexplode(places).alias("ord", "url")).select("key", "ord", F.trim("url").alias("url"))
    return urls.where("url <> ''")


def direct_pdf(url: Column) -> Column:
    """The url if it leads to the file itself, else null."""
    return F.when(F.lower(url).endswith(".pdf") | F.contains(F.lower(url), F.lit("arxiv")), url)


def is_pdf(content: Column, most: int = 150 * 1024 * 1024) -> Column:
    """The mark of the format is in the first 1024 bytes, and the file isn't too large."""
    return (F.length(content) <= most) & F.contains(F.hex(F.substring(content, 1, 1024)), F.lit("25504446"))


def stale(papers: DataFrame, cache: DataFrame, now: Column, force: bool = False, days: int = 7) -> DataFrame:
    """Papers (id, title) to look up: never looked up, too long ago, or under another title. cache: id, title, at."""
    c = cache.select(F.col("id").alias("_id"), F.col("title").alias("_title"), F.col("at").alias("_at"))
    joined = papers.join(c, papers["id"] == F.col("_id"), "left")
    old = F.col("_id").isNull() | (F.col("_at") < now - F.expr(f"INTERVAL {days} DAYS")) | ~F.col("_title").eqNullSafe(F.col("title"))
    return joined.where(F.lit(force) | old).select(*[papers[c] for c in papers.columns])


def clean_title(title: Column) -> Column:
    """Without markup; null for what only points at another work."""
    plain = F.trim(F.regexp_replace(title, "<[^>]+>", ""))
    return F.when((plain != "") & ~plain.rlike(POINTERS), plain)


def gated_fills(papers: DataFrame, found: DataFrame, least: float = 0.6, years: int = 2) -> DataFrame:
    """id, venue, authors, year: what the found record (id, title, venue, authors, year) fills of a paper's gaps, where its
    title is alike and its year near. Papers without anything to fill are left out."""
    f = found.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in ("title", "venue", "authors", "year")])
    joined = papers.join(f, papers["id"] == F.col("_id"))
    alike = dice(bigrams(F.lower("title")), bigrams(F.lower("_title"))) >= least
    near = F.col("year").isNull() | F.col("_year").isNull() | (F.abs(F.col("year") - F.col("_year")) <= years)
    gap = lambda c: F.coalesce(c, F.lit("")) == ""
    given = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    fills = joined.where(alike & near).select(
        "id", F.when(gap("venue") & ~F.coalesce(F.col("_venue"), F.lit("")).rlike(AGGREGATORS), given("_venue")).alias("venue"),
        F.when(gap("authors"), given("_authors")).alias("authors"), F.when(F.col("year").isNull(), F.col("_year")).alias("year"),
    )
    return fills.where("venue IS NOT NULL OR authors IS NOT NULL OR year IS NOT NULL")


def in_library(titles: DataFrame, papers: DataFrame, longer_than: int = 8) -> DataFrame:
    """titles (title and what else) with paper_id: the first paper with the same normalised title, if that is long enough."""
    own = papers.select(norm_title(F.col("title")).alias("_n"), "id").where(F.length("_n") > longer_than).groupBy("_n").agg(F.min("id").alias("paper_id"))
    return titles.withColumn("_key", norm_title(F.col("title"))).join(own, F.col("_key") == F.col("_n"), "left").drop("_key", "_n")


def bib_file(entries: DataFrame, day: str) -> tuple[DataFrame, DataFrame]:
    """line, text of the file that holds the entries (ord, title, key, bibtex, source), header first; and ord, error of what
    is wrong: entries that don't parse back (they are left out) and keys that came before."""
    read = entries.select("*", parsed("bibtex")["key"].alias("_back"))
    good = F.coalesce(F.col("_back") == F.col("key"), F.lit(False))
    again = F.row_number().over(W.partitionBy("key").orderBy("ord")) > 1
    repeated = read.where(good).withColumn("_again", again).where("_again")
    said = F.coalesce("title", F.lit(""))
    errors = read.where(~good).select("ord", F.concat(said, F.lit(": does not parse")).alias("error"))
    errors = errors.unionByName(repeated.select("ord", F.concat(said, F.lit(": key repeated ("), F.col("key"), F.lit(")")).alias("error")))
    counts = entries.agg(F.count("*").alias("n"), *[F.count_if(F.col("source") == s).alias(s) for s in ("official", "web", "local")])
    head = F.concat(F.lit(f"% BibTeX export, {day}\n% "), "n", F.lit(" entries, official "), "official", F.lit(", web "), "web", F.lit(", local "), "local")
    lines = counts.select(F.lit(-1).cast("long").alias("line"), head.alias("text"))
    return lines.unionByName(read.where(good).select(F.col("ord").cast("long").alias("line"), F.rtrim("bibtex", F.lit(" \n\t")).alias("text"))), errors


# ---- What a model reads ---------------------------------------------------------------------------------------------


def source_labels(hits: DataFrame) -> DataFrame:
    """n, label, text of hits (n, title, category, year, page, section_no, section_title, text)."""
    place = F.concat(category_label(F.col("category")), F.coalesce(F.concat(F.lit(" · "), F.col("year").cast("string")), F.lit("")))
    named = F.concat_ws(" ", F.nullif("section_no", F.lit("")), F.nullif("section_title", F.lit("")))
    section = F.when(named != "", F.concat(F.lit(" §"), named)).otherwise("")
    label = F.concat(F.lit("《"), "title", F.lit("》("), place, F.lit(") p."), F.col("page").cast("string"), section)
    return hits.select("n", label.alias("label"), "text")


def source_cards(groups: DataFrame, papers: DataFrame) -> DataFrame:
    """n, slug, title, page, venue, authors, year of the papers that were cited (n, paper_id); a card leads to page 1."""
    blank = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit("")).alias(c)
    return groups.join(papers, groups["paper_id"] == papers["id"]).select("n", "slug", "title", F.lit(1).alias("page"), blank("venue"), blank("authors"), "year")


def paper_contexts(hits: DataFrame, size: int = 12_000) -> DataFrame:
    """n, text: a paper's hits (n, pos, text) in order, a blank line between, cut. Only hits that the cut reaches are put
    together, and of each no more than the cut."""
    order = W.partitionBy("n").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    known = hits.select("n", "pos", F.coalesce("text", F.lit("")).alias("text"))
    before = F.coalesce(F.sum(F.length("text") + 2).over(order) - 2, F.lit(0))
    near = known.withColumn("before", before).where(F.col("before") < size)
    near = near.select("n", "pos", F.substring("text", 1, size).alias("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda h: h["text"]), "\n\n")
    return near.groupBy("n").agg(F.substring(joined, 1, size).alias("text"))
