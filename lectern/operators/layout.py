"""From placed runs of text to reading order, reference lists, rectangles and matches: column expressions, windows, joins.

A run is what a page's text layer holds: doc_id, page, ord, str, x, y (from the bottom), w, h, page_w, page_h. A page is
one group, as it is one sheet; documents are never groups of Python code. Who has pages with arrays of their runs (doc_id,
page, page_w, page_h, runs) gives those to lines_of(), prompts_of() and rects_of(), and nothing is exchanged; a table of
runs is gathered to such pages first. Empty tables give empty results. Null texts are empty, null places are 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.arrays import divided_at
from lectern.functions.text import bound, full_width
from lectern.operators.pages import ROW_LEAST, lines_of, places_of

# What a reference list looks like.
HEADINGS = ["references", "reference", "bibliography", "参考文献"]
BRACKETED = r"^[\[(]\s*(\d{1,4})\s*[\])]\s*(.*)$"
DOTTED = r"^(\d{1,3})[.)]\s+(?=[A-Z\[(“\"])(.+)$"
AUTHOR = r"^[A-Z][A-Za-z'’\-]+ [A-Z]"
SENTENCE_END = r"[.?!][\"'”’)]?$"
BOUNDARY = r"(?i)^(appendix|appendices|acknowledg|supplementary|supporting information)"
WATERMARKS = ["authorizedlicenseduse", "downloadedon"]
WATERMARK_RUN = r"(?i)licensed\s+use\s+limited\s+to|downloaded\s+on\s+\d"
INDENT_LEAST, INDENT_SHARE = 3.0, 0.008
PAGE_LINES, PAGE_STARTS, PAGE_INDENTED = 250, 3, 0.15


def _number(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)


def anchored_rows(runs: Column, alike: Callable[[Column, Column], Column]) -> Column:
    """runs (an array of structs with y, from the top down) cut into rows: a run is of a row if it is alike to the row's
    first. alike gets that first run and the other."""
    first = F.get(runs, 0)
    none = F.struct(first.alias("anchor"), F.array().cast("array<int>").alias("starts"))
    place = F.transform(runs, lambda r, i: F.struct(r.alias("r"), (i + 1).alias("i")))
    step = lambda s, p: F.when((p["i"] > 1) & alike(s["anchor"], p["r"]), s).otherwise(F.struct(p["r"].alias("anchor"), F.array_append(s["starts"], p["i"]).alias("starts")))
    starts = F.aggregate(place, none, step, lambda s: s["starts"])
    return divided_at(runs, starts)


def gathered(runs: DataFrame) -> DataFrame:
    """doc_id, page, page_w, page_h, runs of a table of runs: its pages, each with an array of its runs."""
    has = lambda *names: [c for c in names if c in runs.columns]
    sizes = has("page_w", "page_h")
    eol = [F.coalesce(c, F.lit(False)).alias(c) for c in has("eol")]
    run = F.struct("ord", F.coalesce("str", F.lit("")).alias("str"), *map(_number, has("x", "y", "w", "h")), *eol)
    known = runs.select("doc_id", "page", *map(_number, sizes), run.alias("r"))
    return known.groupBy("doc_id", "page").agg(*[F.max(c).alias(c) for c in sizes], F.array_sort(F.collect_list("r")).alias("runs"))


def page_lines(runs: DataFrame) -> DataFrame:
    """doc_id, page, line (from 1, in reading order), text, x0, col (0 left, 1 right), page_w of runs.

    Runs are put into visual rows (a row takes what is as high as its first run, within half the larger height), rows are
    cut at the gap between columns, and where both sides have some segments the left side is read before the right. Of
    runs at the same place the first by ord comes first. Blank runs and watermarks are left out.
    """
    said = F.coalesce("str", F.lit(""))
    return lines_of(gathered(runs.where((F.regexp_replace(said, r"\s+", "") != "") & ~said.rlike(WATERMARK_RUN))))


# Where a page's margins are.
MARGIN_LEFT, MARGIN_RIGHT = 0.03, 0.965


def without_margin_junk(runs: DataFrame) -> DataFrame:
    """runs without the blanks and line numbers (up to four digits) that begin in a page's outer margins. Runs of a page
    without a width stay."""
    bare = F.trim(F.regexp_replace(F.coalesce("str", F.lit("")), r"\s+", " "))
    place = F.col("x") / F.nullif(F.col("page_w"), F.lit(0.0))
    junk = ((bare == "") | bare.rlike(r"^\d{1,4}$")) & ((place < MARGIN_LEFT) | (place > MARGIN_RIGHT))
    return runs.where(~F.coalesce(junk, F.lit(False)))


def prompts_of(pages: DataFrame) -> DataFrame:
    """doc_id, page, text of pages (whose runs have eol): their runs as they come, a line end where one says so, no blanks
    before it."""
    piece = lambda r: F.concat(F.coalesce(r["str"], F.lit("")), F.when(F.coalesce(r["eol"], F.lit(False)), "\n").otherwise(""))
    joined = F.array_join(F.transform(F.array_sort(F.transform("runs", lambda r: F.struct(r["ord"].alias("ord"), piece(r).alias("t")))), lambda r: r["t"]), "")
    return pages.select("doc_id", "page", F.regexp_replace(joined, "[ \t]+\n", "\n").alias("text"))


def prompt_text(runs: DataFrame) -> DataFrame:
    """As prompts_of(), of a table of runs."""
    return prompts_of(gathered(runs.select("doc_id", "page", "ord", "str", "eol")))


# ---- Reference lists ------------------------------------------------------------------------------------------------


def line_key(text: Column) -> Column:
    """What stays of a line when it is looked up: lower case, letters, digits and CJK."""
    return F.regexp_replace(F.lower(full_width(text)), "[^a-z0-9\\u4e00-\\u9fff]", "")


def is_heading(text: Column) -> Column:
    said = F.trim(F.regexp_replace(F.lower(full_width(text)), r"[\s:：.。]+$", ""))
    return said.isin(HEADINGS) | (said.startswith("references ") & (F.length(said) <= 24))


def _after_heading(lines: DataFrame) -> DataFrame:
    """The lines (with text in one form) behind each document's last heading, and what each looks like by itself.

    The first window puts a document's lines in order; all windows behind it, here and in those who call this, take a
    document or a page in that order, so lines are sorted once and no task holds them several times."""
    place = F.struct("page", "line")
    known = lines.select("doc_id", "page", "line", F.coalesce("text", F.lit("")).alias("given"), _number("x0"), F.coalesce("col", F.lit(0)).alias("col"), _number("page_w"))
    last = F.max(F.when(is_heading(F.col("given")), place)).over(W.partitionBy("doc_id").orderBy("page", "line").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    raw = F.trim(F.regexp_replace(full_width(F.col("given")), r"\s+", " "))
    known = known.select("*", last.alias("heading"), raw.alias("raw")).where(place > F.col("heading")).drop("heading")
    key = line_key(F.col("given"))
    junk = F.trim(F.col("given")).rlike(r"^\d{1,4}$") | key.startswith(WATERMARKS[0]) | key.startswith(WATERMARKS[1])
    number = lambda p: F.nullif(F.regexp_extract("raw", p, 1), F.lit(""))
    found = F.coalesce(number(BRACKETED), number(DOTTED)).cast("int")
    return known.select("*", junk.alias("junk"), found.alias("number"), F.greatest(F.lit(INDENT_LEAST), F.col("page_w") * INDENT_SHARE).alias("slack"))


def _edge(of: Column | None = None) -> Column:
    """The least left edge in a page's column (0, or another), of all lines or of some."""
    x = F.col("x0") if of is None else F.when(of, F.col("x0"))
    left, page = F.col("col") == 0, W.partitionBy("doc_id", "page")
    return F.when(left, F.min(F.when(left, x)).over(page)).otherwise(F.min(F.when(~left, x)).over(page))


def _gated(region: DataFrame) -> DataFrame:
    """The region's lines with page statistics, and whether the page is in the document's first run of list pages.

    A page is one if it has few enough lines, and enough starts of entries or enough indented lines; one after another
    such page needs only one start. The run ends before the first page that isn't.
    """
    by_page = W.partitionBy("doc_id", "page")
    starts = F.count_if(F.col("number").isNotNull() & ~F.col("junk"))
    region = region.select("*", (F.col("x0") > _edge() + F.col("slack")).alias("indented"))
    region = region.select("*", F.count("*").over(by_page).alias("n_lines"), starts.over(by_page).alias("n_starts"), F.count_if("indented").over(by_page).alias("n_indented"))
    short, share = F.col("n_lines") <= PAGE_LINES, F.col("n_indented") / F.col("n_lines") >= PAGE_INDENTED
    opens, goes_on = short & ((F.col("n_starts") >= PAGE_STARTS) | share), short & ((F.col("n_starts") >= 1) | share)
    doc = W.partitionBy("doc_id")
    region = region.select("*", goes_on.alias("goes_on"), F.min(F.when(opens, F.col("page"))).over(doc).alias("first_page"))
    stop = F.min(F.when(~F.col("goes_on") & (F.col("page") > F.col("first_page")), F.col("page"))).over(doc)
    region = region.select("*", stop.alias("stop_page"))
    kept = (F.col("page") >= F.col("first_page")) & (F.col("stop_page").isNull() | (F.col("page") < F.col("stop_page")))
    return region.select("*", F.coalesce(kept, F.lit(False)).alias("is_list")).drop("goes_on", "first_page", "stop_page")


def list_pages(lines: DataFrame) -> DataFrame:
    """doc_id, page, n_lines, n_starts, n_indented, is_list of each page behind a document's last heading.

    lines: doc_id, page, line, text, x0, col, page_w. A document without a heading has no rows."""
    gated = _gated(_after_heading(lines))
    return gated.groupBy("doc_id", "page").agg(*[F.first(c).alias(c) for c in ("n_lines", "n_starts", "n_indented", "is_list")])


def entry_lines(lines: DataFrame) -> DataFrame:
    """The lines of reference lists with entry (from 1 in a document), num, opens, page, line, raw, rest, key.

    Numbered lists: an entry begins where the number is higher than all before, unless the line stands where entries go on
    (a citation that was wrapped to the front of a line). Where that leaves too few entries, rising numbers decide alone.
    Lists without numbers: an entry begins with an author's name at the margin behind the end of a sentence, if enough
    lines are indented. A running maximum and edges of page columns say all that; no document is walked through.
    """
    region = _gated(_after_heading(lines))
    doc = W.partitionBy("doc_id")
    order = doc.orderBy("page", "line")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    region = region.select("*", F.count("number").over(doc).alias("n_numbers"), _edge(F.col("number").isNotNull()).alias("start_edge")).where("is_list AND NOT junk").drop("indented")
    stop = F.min(F.when(F.col("given").rlike(BOUNDARY), F.struct("page", "line"))).over(doc)
    kept = region.select("*", stop.alias("stop")).where("stop IS NULL OR struct(page, line) < stop").where("raw <> ''").drop("stop")
    numbered = F.col("n_numbers") >= 3

    cont = _edge(F.col("number").isNull())
    wrapped = (F.col("x0") > F.coalesce("start_edge", "x0") + F.col("slack")) & F.coalesce(F.abs(F.col("x0") - cont) <= F.col("slack"), F.lit(False))
    kept = kept.select("*", wrapped.alias("wrapped"), F.count("number").over(before).alias("earlier"))
    kept = kept.select("*", F.when(~F.col("wrapped") | (F.col("earlier") == 0), F.col("number")).alias("eligible"))
    rises = lambda c: F.coalesce(F.col(c) > F.coalesce(F.max(c).over(before), F.lit(-1)), F.lit(False))
    kept = kept.select("*", rises("eligible").alias("strict"), rises("number").alias("loose"))
    kept = kept.select("*", F.count_if("strict").over(doc).alias("n_strict"))
    by_number = F.when(F.col("n_strict") < F.least(F.lit(3), F.col("n_numbers") * 0.5), F.col("loose")).otherwise(F.col("strict"))

    named, at_edge = F.col("raw").rlike(AUTHOR), F.col("x0") <= _edge() + F.col("slack")
    ended = F.coalesce(F.lag("raw").over(order).rlike(SENTENCE_END), F.lit(True))
    kept = kept.select("*", named.alias("named"), at_edge.alias("at_edge"), ended.alias("ended"))
    kept = kept.select("*", F.count_if("named").over(before).alias("named_before"), (F.count_if(~F.col("at_edge")).over(doc) / F.count("*").over(doc)).alias("share"))
    by_name = F.col("named") & ((F.col("named_before") == 0) | (F.col("at_edge") & F.col("ended"))) & (F.col("share") >= PAGE_INDENTED)

    kept = kept.select("*", F.when(numbered, by_number).otherwise(by_name).alias("opens"))
    kept = kept.select("*", F.count_if("opens").over(order.rowsBetween(W.unboundedPreceding, 0)).cast("int").alias("entry")).where("entry > 0")
    num = F.when(F.col("opens"), F.when(numbered, F.col("number")).otherwise(F.col("entry")))
    kept = kept.select("*", F.last(num, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("num"))
    # Only lines of entries are taken apart, and behind all windows, which would carry the parts.
    rest = F.trim(F.when(F.col("raw").rlike(BRACKETED), F.regexp_extract("raw", BRACKETED, 2)).otherwise(F.regexp_extract("raw", DOTTED, 2)))
    return kept.select("doc_id", "entry", "num", "opens", "page", "line", "raw", F.when(F.col("opens") & numbered, rest).otherwise(F.col("raw")).alias("rest"), line_key(F.col("given")).alias("key"))


def _joined(parts: Column) -> Column:
    """Lines as one text: a word that a hyphen divides is put together, others get a space between."""
    divided = lambda t, after: t.rlike("[a-zA-Z]-$") & after.rlike("^[a-z]")

    def part(t: Column, i: Column) -> Column:
        after = F.get(parts, i + 1)
        return F.when(after.isNull() | (t == ""), t).when(divided(t, after), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(F.concat(t, F.lit(" ")))

    return F.array_join(F.transform(parts, part), "")


def reference_entries(lines: DataFrame) -> DataFrame:
    """doc_id, num, raw, page (of the first line), keys (of all lines) of the entries of reference lists."""
    own = F.array_sort(F.collect_list(F.struct("page", "line", "rest", "key")))
    grouped = entry_lines(lines).groupBy("doc_id", "entry").agg(F.first("num").alias("num"), own.alias("l"))
    keys = F.filter(F.transform("l", lambda x: x["key"]), lambda k: k != "")
    return grouped.select("doc_id", "num", bound(F.transform("l", lambda x: x["rest"]), _joined).alias("raw"), F.get("l", F.lit(0))["page"].alias("page"), keys.alias("keys"))


# ---- Matches and rectangles -----------------------------------------------------------------------------------------


def rects_of(pages: DataFrame, needle: str) -> DataFrame:
    """doc_id, page, hit (from 1 on its page), ord, x, y, w, h of each run's part of each match, as shares of the page.

    A page's text is its runs in their order, lower case, with a line end where the next is higher or lower by a share of
    its height, or where a run says so (eol). Matches may overlap; an empty needle has none. A part is as wide as its
    characters' share of the run.
    """
    low = needle.lower()
    # Lower case in Spark, as it is elsewhere; the order is that of ord, then of the text.
    run = lambda r: F.struct(r["ord"].alias("ord"), F.lower(F.coalesce(r["str"], F.lit(""))).alias("low"), *[r[c].alias(c) for c in ("x", "y", "w", "h", "eol")])
    known = pages.select("doc_id", "page", "page_w", "page_h", F.array_sort(F.transform("runs", run)).alias("runs"))
    met = places_of(known if low else known.where("false"), low or " ")
    part = lambda c: F.col("w") * F.col(c) / F.col("n")
    return met.select(
        "doc_id", "page", "hit", "ord", ((F.col("x") + part("left")) / F.col("page_w")).alias("x"), (1 - (F.col("y") + F.col("h") * 0.85) / F.col("page_h")).alias("y"),
        (part("size") / F.col("page_w")).alias("w"), (F.col("h") * 1.12 / F.col("page_h")).alias("h"),
    )


def find_rects(runs: DataFrame, needle: str, width: int = 256) -> DataFrame:
    """As rects_of(), of a table of runs. width is left for callers and changes nothing: pages are no longer cut."""
    return rects_of(gathered(runs), needle)


def hits_by_page(rects: DataFrame, current: Column | None = None) -> DataFrame:
    """doc_id, page, n_hits, rects and current_rects (in the order of hits): what a page has to draw. current: which hits
    are the one that the reader is at."""
    r = F.struct("hit", "ord", "x", "y", "w", "h")
    of = lambda c: F.array_sort(F.collect_list(c))
    now = F.lit(False) if current is None else current
    return rects.groupBy("doc_id", "page").agg(F.count_distinct("hit").alias("n_hits"), of(r).alias("rects"), of(F.when(now, r)).alias("current_rects"))


def row_rects(runs: DataFrame, share: float = 0.45, least: float = 0.002) -> DataFrame:
    """doc_id, page, rects (x, y, w, h of each visual row, as shares of the page), top, height of all together.

    runs: those that a passage touches. A row takes what is as high as its first run, within a share of the run's own
    height. A run without height has 8, one without width half its height for each character. Rectangles next to nothing
    are left out; a page that has no others has no row.
    """
    near = lambda a, r: F.abs(a["y"] - r["y"]) <= F.greatest(F.lit(ROW_LEAST), r["tall"] * share)
    known = runs.select("doc_id", "page", "ord", F.length(F.coalesce("str", F.lit(""))).alias("n"), *map(_number, ("x", "y", "w", "h", "page_w", "page_h")))
    tall = F.when(F.col("h") == 0, 8.0).otherwise(F.col("h")).alias("tall")
    known = known.select("*", tall).withColumn("wide", F.when(F.col("w") == 0, F.col("n") * F.col("tall") * 0.5).otherwise(F.col("w")))
    pages = known.groupBy("doc_id", "page").agg(F.max("page_w").alias("pw"), F.max("page_h").alias("ph"), F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("down"), "ord", "x", "y", "tall", "wide"))).alias("runs"))
    low, high = (lambda row, f: F.array_min(F.transform(row, f))), (lambda row, f: F.array_max(F.transform(row, f)))
    boxes = F.transform(anchored_rows(F.col("runs"), near), lambda row: F.struct(low(row, lambda r: r["x"]).alias("x0"), high(row, lambda r: r["x"] + r["wide"]).alias("x1"), low(row, lambda r: r["y"]).alias("y0"), high(row, lambda r: r["y"] + r["tall"]).alias("y1")))
    x, y = (lambda b: F.greatest(F.lit(0.0), b["x0"] / F.col("pw"))), (lambda b: F.greatest(F.lit(0.0), (F.col("ph") - b["y1"]) / F.col("ph")))
    rects = F.transform(F.filter(boxes, lambda b: b["x1"] > b["x0"]), lambda b: F.struct(x(b).alias("x"), y(b).alias("y"), F.least(1 - x(b), (b["x1"] - b["x0"]) / F.col("pw")).alias("w"), F.least(1 - y(b), (b["y1"] - b["y0"]) / F.col("ph")).alias("h")))
    pages = pages.select("doc_id", "page", F.filter(rects, lambda r: (r["w"] > least) & (r["h"] > least)).alias("rects")).where(F.size("rects") > 0)
    top = F.array_min(F.transform("rects", lambda r: r["y"]))
    return pages.select("doc_id", "page", "rects", top.alias("top"), (F.array_max(F.transform("rects", lambda r: r["y"] + r["h"])) - top).alias("height"))
