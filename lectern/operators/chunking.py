"""Documents into chunks: structural blocks of markdown pages, packed by section to a budget of tokens.

Lines, fences, headings and paragraphs are found by windows over a document's lines. A section's pieces are one row, and
where chunks begin follows from running sums of the pieces' sizes; all of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.arrays import divided_at, filled_starts, summed
from lectern.functions.text import bound, estimate_tokens, split_sentences
from lectern.sources.shared import materialise

# Budgets in tokens, and the headings that are told apart.
TARGET, HARD, LEAST, OVERLAP = 1024, 1400, 40, 128
BACK_MATTER = r"(?i)^(references?(\s+cited)?|bibliography|acknowledg?ments?|author\s+biographies?|biograph(y|ies)|参考文献|致\s*谢|作者简介)"
APPENDIX = r"(?i)^(appendix|appendices|supplementary|附\s*录)"
ABSTRACT = r"(?iU)^(abstract|summary|摘\s*要)\b"
CAPTION = r"(?i)^(figure|fig\.|table|图|表)\s*\d+"
NUMBERED = (r"^(\d+(?:\.\d+)*)[.)]?\s+(.*)$", r"(?i)^(ix|iv|v?i{1,3})\.\s+(.*)$", r"^第([一二三四五六七八九十百\d]+)章\s*(.*)$")
HEADING_LINE = r"^#{1,6}\s+(.*)$"
IMAGE_LINE = r"^!\[[^\]]*\]\([^)]*\)$"
BLANK = " \t\n\x0b\x0c\r"
BACK_LINE = "(?i)^\\s*(references?|bibliography|acknowledg?ments?|参考文献|致\\s*谢)\\s*:?\\s*$"


# ---- Blocks ---------------------------------------------------------------------------------------------------------


def _short(title: Column) -> Column:
    return F.when(F.length(title) <= 120, title).otherwise(F.concat(F.substring(title, 1, 120), F.lit("…")))


def _numbered(title: Column) -> tuple[Column, Column]:
    """Number and title of a heading."""
    arabic, roman, chapter = NUMBERED
    part = lambda pattern, i: F.regexp_extract(title, pattern, i)
    number = F.when(title.rlike(arabic), part(arabic, 1)).when(title.rlike(roman), F.upper(part(roman, 1))).when(title.rlike(chapter), part(chapter, 1)).otherwise("")
    rest = F.when(title.rlike(arabic), F.trim(part(arabic, 2))).when(title.rlike(roman), F.trim(part(roman, 2)))
    named = F.trim(part(chapter, 2))
    rest = rest.when(title.rlike(chapter), F.when(named != "", named).otherwise(F.concat(F.lit("第"), part(chapter, 1), F.lit("章"))))
    return number, _short(rest.otherwise(title))


def blocks_of(pages: DataFrame) -> DataFrame:
    """doc_id, seq (rising in a document), page, text, number, title, kind: paragraphs, captions and fenced pieces of pages
    (doc_id, page, text in markdown) with their sections. Back matter is left out.

    Every line is a row. What holds until something else comes (a fence, a heading, whether a heading has been at all) is a
    running value over a document's lines, and lines that belong together share the number of breaks before them.
    """
    rows = pages.select("doc_id", "page", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line", "raw"))
    rows = rows.select("*", F.btrim("raw", F.lit(BLANK)).alias("s"), F.rtrim(F.col("raw"), F.lit(BLANK)).alias("r"))
    order = W.partitionBy("doc_id").orderBy("page", "line")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select("*", F.col("s").rlike("^(```|~~~)").alias("mark"))
    rows = rows.select("*", F.sum(F.col("mark").cast("int")).over(upto).alias("marks"))
    fenced = F.col("mark") | (F.col("marks") % 2 == 1)
    head = ~fenced & F.col("r").rlike(HEADING_LINE)
    title = F.trim(F.regexp_replace(F.regexp_extract("r", HEADING_LINE, 1), "[*_`#]", ""))
    rows = rows.select("*", fenced.alias("fenced"), head.alias("head"), F.when(head, title).alias("named"))
    back = F.col("named").rlike(BACK_MATTER)
    plain = ~F.col("fenced") & ~F.col("head") & (F.col("s") != "") & ~F.col("s").rlike(IMAGE_LINE)
    rows = rows.select("*", plain.alias("plain"), F.last(back, True).over(upto).alias("back"), F.last(F.when(~back, F.col("named")), True).over(upto).alias("section"))
    rows = rows.select("*", F.max("plain").over(upto).alias("begun"))
    first = F.row_number().over(W.partitionBy("doc_id", "page").orderBy("line")) == 1
    ends = F.col("mark") | F.col("head") | ((F.col("s") == "") & ~F.col("fenced")) | (first & ~F.col("fenced"))
    rows = rows.select("*", F.sum(ends.cast("int")).over(upto).alias("breaks"))
    kept = rows.where((F.col("plain") | F.col("fenced")) & ~F.coalesce("back", F.lit(False)))
    # A closing mark has counted itself, an opening one too; both have the number of their pair.
    pair = F.floor((F.col("marks") + 1) / 2)
    place = F.when(F.col("fenced"), pair).otherwise(F.col("breaks"))
    grouped = kept.groupBy("doc_id", "fenced", place.alias("place")).agg(
        F.array_sort(F.collect_list(F.struct("page", "line", F.when(F.col("mark") | ~F.col("fenced"), F.col("s")).otherwise(F.col("r")).alias("t")))).alias("lines"),
        F.sum(F.col("mark").cast("int")).alias("ends"), F.max(F.struct("page", "line", "section", "begun")).alias("at"),
    )
    grouped = grouped.where(~F.col("fenced") | (F.col("ends") == 2))  # a fence that is never closed holds nothing
    texts = F.transform("lines", lambda x: x["t"])
    text = F.when(F.col("fenced"), F.btrim(F.array_join(texts, "\n"), F.lit(BLANK))).otherwise(F.btrim(F.regexp_replace(F.array_join(texts, " "), "(?U)\\s+", " "), F.lit(BLANK)))
    found = grouped.select("doc_id", "fenced", text.alias("text"), "at.*").where(F.length("text") > 8)
    section = F.col("section")
    number, named = _numbered(section)
    appendix = section.rlike(APPENDIX)
    kind = F.when(section.isNull(), F.when(F.col("begun"), "abstract").otherwise("body")).when(~appendix & section.rlike(ABSTRACT), "abstract").otherwise("body")
    caption = ~F.col("fenced") & (kind == "body") & F.col("text").rlike(CAPTION)
    return found.select(
        "doc_id", F.struct("page", "line").alias("seq"), "page", "text",
        F.when(section.isNull(), "").when(appendix, "Appendix").otherwise(number).alias("number"),
        F.when(section.isNull(), "").when(appendix, section).otherwise(named).alias("title"),
        F.when(caption, "caption").otherwise(kind).alias("kind"),
    )


# ---- Packing --------------------------------------------------------------------------------------------------------

#: What is never divided: a paragraph or a line, or a part of one that is too long, which knows its topic and the end of the
#: part before it.
PIECE = "struct<text: string, size: bigint, topic: string, before: string>"


def tail(text: Column, size: int = OVERLAP) -> Column:
    """The last sentences, about so many tokens: all that fit together, one at least. Without sentences the last characters."""
    end = lambda n: F.substring(text, F.greatest(F.length(text) - n + 1, F.lit(1)), F.lit(n))
    fits = lambda found: F.aggregate(F.reverse(found), F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n")), lambda s, x: F.struct((s["used"] + estimate_tokens(x)).alias("used"), (s["n"] + F.when(s["used"] + estimate_tokens(x) <= size, 1).otherwise(0)).alias("n")), lambda s: F.greatest(s["n"], F.lit(1)))
    last = lambda found: F.when(F.size(found) == 0, F.lit("")).otherwise(F.array_join(F.slice(found, -F.least(fits(found), F.size(found)), F.size(found)), " "))
    return F.coalesce(F.nullif(bound(split_sentences(end(6 * size)), last), F.lit("")), end(3 * size))


def _piece(text: Column, size: Column, topic: Column | None = None, before: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(text.alias("text"), size.alias("size"), (none if topic is None else topic).alias("topic"), (none if before is None else before).alias("before")).cast(PIECE)


def _divided(text: Column) -> Column:
    """The pieces of a text that is too long: its sentences up to the target; a last one that is too short joins the one
    before."""
    run = lambda r: F.struct(F.array_join(F.transform(r, lambda x: x["text"]), " ").alias("text"), summed(r, lambda x: x["size"]).alias("size"))

    def joined(parts: Column) -> Column:
        n, last, other = F.size(parts), F.element_at(parts, -1), F.element_at(parts, -2)
        both = F.struct(F.concat(other["text"], F.lit(" "), last["text"]).alias("text"), (other["size"] + last["size"]).alias("size"))
        return F.when((n > 1) & (last["size"] < LEAST), F.concat(F.slice(parts, 1, n - 2), F.array(both))).otherwise(parts)

    def pieces(found: Column) -> Column:
        sized = F.transform(found, lambda s: F.struct(s.alias("text"), estimate_tokens(s).alias("size")))
        runs = bound(sized, lambda z: F.transform(divided_at(z, filled_starts(F.transform(z, lambda x: x["size"]), TARGET)), run))
        parts = F.when(F.size(found) == 0, F.array().cast("array<struct<text: string, size: bigint>>")).otherwise(bound(runs, joined))
        topic = F.get(found, 0)
        return bound(parts, lambda p: F.transform(p, lambda x, i: _piece(x["text"], x["size"], F.when(i > 0, topic), F.when(i > 0, tail(F.get(p, i - 1)["text"])))))

    return bound(split_sentences(text), pieces)


def _packed(pieces: Column) -> Column:
    """Chunks (text, own) of pieces in order: as many in one as the target takes; what is too short joins the chunk before,
    or is lost where there is none."""
    runs = divided_at(pieces, filled_starts(F.transform(pieces, lambda p: p["size"]), TARGET))

    def kept(found: Column) -> Column:
        long = F.filter(F.transform(found, lambda r, i: F.when(summed(r, lambda p: p["size"]) >= LEAST, i + 1)), lambda i: i.isNotNull())
        return F.transform(divided_at(found, long), F.flatten)

    said = lambda p: F.array(p["before"], F.concat(F.lit("Topic: "), p["topic"]), p["text"])
    text = lambda c: F.struct(F.array_join(F.transform(c, lambda p: p["text"]), "\n").alias("text"), F.array_join(F.flatten(F.transform(c, said)), "\n").alias("own"))
    return F.transform(bound(runs, kept), text)


def section_parts(blocks: DataFrame) -> DataFrame:
    """blocks with part and long: blocks with the same part are packed together. A block that is too long is one by itself
    and ends the section around it. Captions aren't in it."""
    text = blocks.where("kind <> 'caption'").select("*", (estimate_tokens(F.col("text")) > HARD).alias("long"))
    order = W.partitionBy("doc_id").orderBy("seq")
    section = F.struct("page", "number", "title", "kind", "long")
    new = F.col("long") | (F.lag(section).over(order) != section)
    return text.withColumn("part", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))


def chunk_documents(pages: DataFrame) -> DataFrame:
    """doc_id, page, ord, text, embed_text, section_no, section_title, kind: the chunks of pages (doc_id, page, text), by
    structure, or by lines where that gives none.

    Blocks are found once and written to the shared folder. A section and a page are a row each; a null text is empty, and
    a document without text has no chunks. embed_text begins with the end of the chunk before.
    """
    blocks = materialise(blocks_of(pages))
    # The outer form, as the other makes the optimiser ask for the arrays' sizes first, which computes them twice.
    chunk = "doc_id", "seq", "page", F.posexplode_outer("chunks").alias("sub", "c"), "number", "title", "kind"
    parts = section_parts(blocks).groupBy("doc_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("seq", "text", "long"))).alias("own"), F.max("seq").alias("seq"), *[F.first(c).alias(c) for c in ("page", "number", "title", "kind")]
    )
    pieces = F.flatten(F.transform("own", lambda b: F.when(b["long"], _divided(b["text"])).otherwise(F.array(_piece(b["text"], estimate_tokens(b["text"]))))))
    structured = parts.withColumn("chunks", bound(pieces, _packed)).select(*chunk)
    captions = blocks.where("kind = 'caption'").where(estimate_tokens(F.col("text")) >= 10)
    captions = captions.withColumn("chunks", F.array(F.struct("text", F.col("text").alias("own")))).select(*chunk)
    bare = pages.select("doc_id", F.col("page").cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text")).join(blocks.select("doc_id").distinct(), "doc_id", "left_anti")
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(BLANK))), lambda x: x != "")
    taken = lambda x, n: F.when(n > HARD, _divided(x)).when(n >= 8, F.array(_piece(x, n))).otherwise(F.array().cast(f"array<{PIECE}>"))
    pieces = F.flatten(F.transform(lines, lambda x: taken(x, estimate_tokens(x))))
    none = F.lit("")
    plain = bare.select("doc_id", F.struct("page", F.lit(0).alias("line")).alias("seq"), "page", bound(pieces, _packed).alias("chunks"), none.alias("number"), none.alias("title"), F.lit("body").alias("kind")).select(*chunk)
    order = W.partitionBy("doc_id").orderBy("seq", "sub")
    found = structured.unionByName(captions).unionByName(plain).where("c IS NOT NULL")
    found = found.select("doc_id", "page", "c.text", "c.own", F.col("number").alias("section_no"), F.col("title").alias("section_title"), "kind", (F.row_number().over(order) - 1).alias("ord"), F.lag("c.text").over(order).alias("last"))
    embed_text = F.when(F.col("last").isNull(), F.col("own")).otherwise(F.concat_ws("\n", tail(F.col("last")), F.col("own")))
    return found.select("doc_id", "page", "ord", "text", embed_text.alias("embed_text"), "section_no", "section_title", "kind")


def without_back_matter(pages: DataFrame, heading: str = BACK_LINE) -> DataFrame:
    """pages (doc_id, page, text) cut at the first short line that is a back-matter heading; later pages are blank."""
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    first = lines.where((F.length("s") <= 48) & F.col("s").rlike(heading)).groupBy("doc_id").agg(F.min(F.struct("page", "line")).alias("cut"))
    joined = pages.join(first, "doc_id", "left")
    cut = F.array_join(F.slice(F.split("text", "\n"), 1, F.col("cut.line")), "\n")
    text = F.when(F.col("cut").isNull() | (F.col("page") < F.col("cut.page")), F.col("text")).when(F.col("page") == F.col("cut.page"), cut).otherwise("")
    return joined.select("doc_id", "page", text.alias("text"))


def lines_of(items: DataFrame, gap: float = 3.0) -> DataFrame:
    """doc_id, page, line, text from positioned runs (doc_id, page, ord, str, y): a new line where y moves by more."""
    order = W.partitionBy("doc_id", "page").orderBy("ord")
    starts = F.when(F.abs(F.col("y") - F.lag("y").over(order)) > gap, 1).otherwise(0)
    grouped = items.withColumn("_s", starts).withColumn("line", F.sum("_s").over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = grouped.groupBy("doc_id", "page", "line").agg(F.array_sort(F.collect_list(F.struct("ord", "str"))).alias("r"))
    return runs.select("doc_id", "page", F.col("line").cast("int").alias("line"), F.array_join(F.transform("r", lambda x: x["str"]), " ").alias("text"))
