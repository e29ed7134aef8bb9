"""Places in texts: finding words, snippets and passages that are only alike; entries of reference lists and their markers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import bigrams, bound, dice, full_width, norm_title
from lectern.sources.shared import materialise


def find_count(text: Column, needle: str) -> Column:
    """Places where needle stands, whatever the case; they may overlap."""
    pattern = "(?=" + "".join(f"\\x{{{ord(c):x}}}" for c in needle.lower()) + ")"
    return F.regexp_count(F.lower(text), F.lit(pattern))


def with_offsets(items: DataFrame) -> DataFrame:
    """items (doc_id, page, ord, str) with start and end of each run in its page's text."""
    w = W.partitionBy("doc_id", "page").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.length("str")).over(w)
    return items.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.length("str"))


def overlapping(runs: DataFrame, spans: DataFrame) -> DataFrame:
    """Runs that a span (doc_id, page, span_start, span_end) touches."""
    touch = (F.col("end") > F.col("span_start")) & (F.col("start") < F.col("span_end"))
    return runs.join(spans, ["doc_id", "page"]).where(touch)


def snippet_place(text: Column, snippet: Column) -> Column:
    """Where the longest probe of a snippet stands (from 1), else null: 200, 120, 70, 40 characters from three starts."""
    tries = []
    for size in (200, 120, 70, 40):
        for part in (0.0, 0.25, 0.5):
            start = F.floor(F.length(snippet) * part).cast("int")
            probe = F.substring(snippet, start + 1, F.lit(size))
            tries.append(F.when(F.length(probe) >= 20, F.nullif(F.instr(text, probe), F.lit(0))))
    return F.coalesce(*tries)


def best_windows(pages: DataFrame, words: list[str], target: int, step: int = 48, width: int = 240) -> DataFrame:
    """doc_id, page, start, hits: the window of the target page and its neighbours that holds most words; enough of them,
    or none. Of equals the target page's, then the first. width is a multiple of step.

    A page is cut into pieces of step characters once; a window is some neighbouring pieces. All of a page's windows are
    looked at within its row, and one of them leaves it.
    """
    need = max(2, -(-18 * len(words) // 100))
    near = pages.where(F.abs(F.col("page") - target) <= 1)
    pieces = F.regexp_extract_all(F.lower("text"), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    said = lambda w: sum((F.when(F.contains(w, F.lit(x.lower())), 1).otherwise(0) for x in words), F.lit(0))
    window = lambda p, i: F.array_join(F.slice(p, i + 1, width // step), "")
    scored = lambda p: F.array_max(F.transform(p, lambda _, i: F.struct(bound(window(p, i), said).alias("hits"), (-i * step).alias("before"))))
    best = near.select("doc_id", "page", bound(pieces, scored).alias("b"))
    best = best.groupBy("doc_id").agg(F.max_by(F.struct("page", (-F.col("b.before")).alias("start"), "b.hits"), F.struct("b.hits", F.col("page") == target, -F.col("page"))).alias("b"))
    return best.select("doc_id", "b.*").where(F.col("hits") >= need)


def _overlap(piece: str, step: int) -> Callable[[str | None], tuple[int, float]]:
    """Where a text's window begins whose pairs of characters overlap most with piece's, and by how much."""
    asked = Counter(piece[i : i + 2] for i in range(len(piece) - 1))
    number = {g: i for i, g in enumerate(asked)}
    wanted = np.array([*asked.values(), 0])
    size, total = len(piece) - 1, max(1, sum(asked.values()))

    def best(text: str | None) -> tuple[int, float]:
        text = text or ""
        ids = np.array([number.get(text[i : i + 2], len(number)) for i in range(len(text) - 1)], dtype=np.int64)
        if not len(ids):
            return 0, 0.0
        ids = np.concatenate([ids, np.full(size, len(number))])  # the last windows are short
        found = (0, -1)
        starts = np.arange(0, max(len(text) - len(piece), 0) + 1, step)
        for block in np.array_split(starts, -(-len(starts) // 4096)):
            rows = ids[block[:, None] + np.arange(size)] + (np.arange(len(block)) * len(wanted))[:, None]
            shared = np.minimum(np.bincount(rows.ravel(), minlength=len(block) * len(wanted)).reshape(len(block), -1), wanted).sum(1)
            i = int(shared.argmax())
            if shared[i] > found[1]:
                found = int(block[i]), int(shared[i])
        return found[0], found[1] / total

    return best


def alike_windows(texts: DataFrame, snippet: str, step: int = 10, width: int = 200, least: float = 0.66) -> DataFrame:
    """id, start, overlap: the first window of text whose pairs of characters (with repeats) overlap most with snippet's.

    Each text is folded within its row: the pairs become numbers, and a block of windows is counted at a time.
    """
    best = _overlap(snippet[:width], step)

    @F.pandas_udf(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("overlap", T.DoubleType())]))
    def folded(c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best(t) for t in c], columns=["start", "overlap"])

    return texts.select("id", folded("text").alias("b")).select("id", "b.*").where(F.col("overlap") >= least)


PLACE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("overlap", T.DoubleType())])


@F.pandas_udf(PLACE)
def _alike_place(text: pd.Series, snippet: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_overlap((s or "")[:200], 10)(t) for t, s in zip(text, snippet)], columns=["start", "overlap"])


def jumps(pages: DataFrame, asks: DataFrame, step: int = 48, width: int = 240, least: float = 0.66) -> DataFrame:
    """ask_id, doc_id, page, how, start: where a citation leads. pages: doc_id, page, text. asks: ask_id, doc_id, page, snippet,
    words.

    First the snippet is looked for on its page, letter by letter (how: exact; start in the page's letters and digits);
    where it isn't there, what is only alike (alike); then the words around the citation, on the page and its neighbours
    (words; start in the text); else it leads to the top of the page (top). Each of these searches is dearer than the one
    before and sees only what that left open. A page beyond a document's last is its last; an ask of a document without
    pages has no row. A null snippet is none, null words are none.
    """
    last = pages.groupBy("doc_id").agg(F.max("page").alias("_last"))
    known = asks.select("ask_id", "doc_id", F.col("page").cast("int").alias("page"), norm_title(F.coalesce("snippet", F.lit(""))).alias("snippet"), F.filter(F.coalesce("words", F.array().cast("array<string>")), lambda w: F.length(w) > 0).alias("words"))
    known = known.join(last, "doc_id").withColumn("page", F.greatest(F.lit(1), F.least("page", "_last"))).drop("_last")
    own = pages.select("doc_id", F.col("page").cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    done = lambda df, how: df.select("ask_id", "doc_id", "page", F.lit(how).alias("how"), (F.col("place") - 1).cast("int").alias("start"))

    exact = F.when(F.length("snippet") >= 20, snippet_place(norm_title(F.col("text")), F.col("snippet")))
    one = materialise(known.join(own, ["doc_id", "page"], "left").select(*known.columns, exact.alias("place")))
    found = done(one.where("place IS NOT NULL"), "exact")

    left = one.where("place IS NULL").drop("place")
    seen = left.where(F.length("snippet") >= 30).join(own, ["doc_id", "page"]).select("ask_id", _alike_place(norm_title(F.col("text")), F.col("snippet")).alias("p"))
    two = materialise(left.join(seen.where(F.col("p.overlap") >= least).select("ask_id", (F.col("p.start") + 1).alias("place")), "ask_id", "left"))
    found = found.unionByName(done(two.where("place IS NOT NULL"), "alike"))

    left = two.where("place IS NULL").drop("place")
    near = left.where(F.size("words") > 0).withColumn("at", F.explode(F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1)))
    near = near.join(own.withColumnRenamed("page", "at"), ["doc_id", "at"])
    pieces = F.regexp_extract_all(F.lower("text"), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    low = F.transform("words", lambda w: F.lower(w))
    said = lambda w: F.size(F.filter(low, lambda x: F.contains(w, x)))
    window = lambda p, i: F.array_join(F.slice(p, i + 1, width // step), "")
    scored = lambda p: F.array_max(F.transform(p, lambda _, i: F.struct(bound(window(p, i), said).alias("hits"), (-i * step).alias("before"))))
    best = near.select("ask_id", "page", "at", F.size("words").alias("n"), bound(pieces, scored).alias("b")).where("b IS NOT NULL")
    best = best.groupBy("ask_id", "n").agg(F.max_by(F.struct("at", (1 - F.col("b.before")).alias("place"), "b.hits"), F.struct("b.hits", F.col("at") == F.col("page"), -F.col("at"))).alias("b"))
    enough = F.col("b.hits") >= F.greatest(F.lit(2), F.ceil(F.col("n") * 18 / 100))
    three = materialise(left.join(best.where(enough).select("ask_id", "b.at", "b.place"), "ask_id", "left"))
    found = found.unionByName(done(three.where("place IS NOT NULL").drop("page").withColumnRenamed("at", "page"), "words"))
    return found.unionByName(three.where("place IS NULL").select("ask_id", "doc_id", "page", F.lit("top").alias("how"), F.lit(0).alias("start")))


# ---- Reference lists ------------------------------------------------------------------------------------------------

def looked_up(index: DataFrame, asked: DataFrame, least: float = 0.65) -> DataFrame:
    """asked (ask_id, doc_id, num, key) with entry (number) and how: by number, by a line's key, or by the most similar
    line of the same document. index: doc_id, num, keys, as layout.reference_entries() gives them."""
    keys = index.select("doc_id", "num", F.explode("keys").alias("k")).groupBy("doc_id", "k").agg(F.min("num").alias("e"))
    numbers = index.select(F.col("doc_id").alias("_d"), F.col("num").alias("_n")).distinct()
    a = asked.join(numbers, (F.col("doc_id") == F.col("_d")) & (F.col("num") == F.col("_n")), "left").withColumnRenamed("_n", "by_number").drop("_d")
    exact = keys.select(F.col("doc_id").alias("_d"), F.col("k").alias("_k"), F.col("e").alias("by_key"))
    a = a.join(exact, (F.col("doc_id") == F.col("_d")) & (F.col("key") == F.col("_k")), "left").drop("_d", "_k")
    open_ = a.where("by_number IS NULL AND by_key IS NULL").select("ask_id", "doc_id", "key").join(keys, "doc_id")
    scored = open_.withColumn("s", dice(bigrams(F.col("key")), bigrams(F.col("k")))).where(F.col("s") > least)
    alike = scored.groupBy(F.col("ask_id").alias("_a")).agg(F.max_by("e", F.struct("s", -F.col("e"))).alias("by_likeness"))
    out = a.join(alike, F.col("ask_id") == F.col("_a"), "left")
    how = F.when(F.col("by_number").isNotNull(), "number").when(F.col("by_key").isNotNull(), "key").when(F.col("by_likeness").isNotNull(), "likeness")
    return out.select("ask_id", "doc_id", F.coalesce("by_number", "by_key", "by_likeness").alias("entry"), how.alias("how"))


def markers(text: Column) -> Column:
    """Numbers in brackets, of lists like [1,3] too; ranges give the two that are printed."""
    found = F.regexp_extract_all(full_width(text), F.lit("\\[([\\d,;\\s–-]+)\\]"), F.lit(1))
    return F.array_distinct(F.transform(F.flatten(F.transform(found, lambda m: F.regexp_extract_all(m, F.lit("\\d{1,4}"), F.lit(0)))), lambda n: n.cast("int")))
