"""Benchmark decontamination by winnowing.

Of the hashes of GRAM words in a row, the least of every WINDOW neighbours is kept as a fingerprint (the last of equal
ones). Two texts that share GRAM + WINDOW - 1 = 10 words in a row thus share a fingerprint in them. Documents'
fingerprints are held against the items' in the tasks that read the documents, through a bitmap of bounded size; each
hit is extended to the windows of 10 words that hold it, and those meet the items' windows in a join on the words
themselves, so a hash never decides. Items of fewer than 10 words are one window of their own length; for those lengths
every gram of a document is a fingerprint.

A window that a text holds many times is one row with its places, so repeated words cost no more than others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import map_rows, materialise, others, packed, table, unpacked
from lectern.llm.tokens import Words, chunks

#: Words in a shared window; fixed by the contract.
SPAN = 10
GRAM, WINDOW = 5, 6
#: Bits of a bitmap: 32 MB at most, whatever the benchmark's size.
MOST_BITS = 1 << 28
#: A word, for counting: A-Z are letters before they are lower-cased.
WORD = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"


def winnowed(w: Words) -> np.ndarray:
    """Numbers of the grams that are fingerprints, for all texts of w together, and their hashes."""
    grams, _ = w.grams(GRAM)
    n = len(w.hash) - SPAN + 1
    if n <= 0:
        return np.zeros(0, int), grams[:0]
    inside = np.flatnonzero(w.doc[:n] == w.doc[SPAN - 1 :])
    least, at = grams[inside], inside.copy()
    for j in range(1, WINDOW):
        other = grams[inside + j]
        later = other <= least
        least = np.where(later, other, least)
        at[later] = inside[later] + j
    at = np.unique(at)
    return at, grams[at]


class Filter:
    """A bitmap of 64-bit hashes. It lets some others through; what it saves is work, not a decision."""

    def __init__(self, bits: int, words: np.ndarray):
        self.mask, self.words = np.uint64(bits - 1), words

    def __call__(self, h: np.ndarray) -> np.ndarray:
        slot = h & self.mask
        return ((self.words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)


def filter_of(hashes: DataFrame) -> Filter:
    """The bitmap of the column hash, of 16 bits a hash, MOST_BITS at most; its words meet on the driver."""
    n = hashes.count()
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * n).bit_length()))
    slot = F.pmod("hash", F.lit(bits))
    words = hashes.groupBy(F.floor(slot / 64).cast("int").alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))).alias("w"))
    held = np.zeros(bits // 64, np.int64)
    for r in words.toLocalIterator():
        held[r["i"]] = r["w"]
    return Filter(bits, held.view(np.uint64))


def _window_texts(w: Words, first: np.ndarray, k: np.ndarray) -> list[str]:
    """The k words from first on, A-Z lower-cased, one space between."""
    low, out = w.data.tobytes().lower(), []
    for i, n in zip(first.tolist(), k.tolist()):
        out.append(b" ".join(low[w.start[j] : w.end[j]] for j in range(i, i + n)).decode())
    return out


def item_marks(items: DataFrame) -> DataFrame:
    """item_id, windows and prints: every window of each item with its hash, and the hashes of the fingerprints. items:
    item_id, item_text."""

    def work(column: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        for a, b, w in chunks(column):
            n = w.counts()
            first, size = [], []
            for i in np.flatnonzero(n):
                k = min(SPAN, int(n[i]))
                first.append(np.arange(w.first[i], w.first[i] + n[i] - k + 1))
                size.append(np.full(n[i] - k + 1, k))
            first, size = (np.concatenate(x or [np.zeros(0, int)]) for x in (first, size))
            h = np.zeros(len(first), np.uint64)
            for k in set(size.tolist()):
                h[size == k] = w.grams(k)[0][first[size == k]]
            at, prints = winnowed(w)
            windows = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(_window_texts(w, first, size), pa.string()), pa.array(size.astype(np.int32))], ["hash", "window", "size"])
            yield a, b, [_lists(w.doc[first], b - a, windows), _lists(w.doc[at], b - a, pa.array(prints.view(np.int64)))]

    return map_rows(items, "item_text", "windows array<struct<hash:bigint,window:string,size:int>>, prints array<bigint>", work)


def _lists(doc: np.ndarray, n_docs: int, values: pa.Array) -> pa.Array:
    """doc doesn't fall."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n_docs + 1)).astype(np.int32)), values)


def met_windows(w: Words, prints: Filter, windows: Filter, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where windows begin that items may have, their sizes and hashes. A window of SPAN words holds a fingerprint; each
    that is known is extended to the windows around it. For shorter items every gram of their length is looked at."""
    at, h = winnowed(w)
    at = at[prints(h)]
    last = len(w.hash) - SPAN
    first = np.unique((at[:, None] - np.arange(SPAN - GRAM + 1)).ravel())
    first = first[(first >= 0) & (first <= last)]
    first = first[w.doc[first] == w.doc[first + SPAN - 1]]
    found = [(first, SPAN, w.grams(SPAN)[0][first])]
    for k in lengths:
        g, inside = w.grams(k)
        i = np.flatnonzero(inside)
        found.append((i, k, g[i]))
    keep = [windows(g) for _, _, g in found]
    return (
        np.concatenate([i[c] for (i, _, _), c in zip(found, keep)]),
        np.concatenate([np.full(c.sum(), k) for (_, k, _), c in zip(found, keep)]),
        np.concatenate([g[c] for (_, _, g), c in zip(found, keep)]),
    )


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each row of docs with: n_words, n_hit (words inside any occurrence of a window), items (their item_ids, distinct,
    as strings, sorted), contaminated.

    A null text has no words, and so is clean; an item without words never occurs. Items with equal ids count as one.
    Repeated rows each get the same. Columns of docs with the name of a result are replaced; others stay, whatever their
    names. Texts are looked through whole; the longest bounds a task's memory. A word inside several windows is hit once, an
    item found several times is listed once. No documents, no rows; no items, nobody is contaminated.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", F.col("text").alias("item_text")).where("item_text IS NOT NULL").distinct()
    marks = materialise(item_marks(items).select(F.col("item_id").cast("string").alias("item"), "windows", "prints"))
    inside = materialise(marks.select("item", F.inline("windows")).distinct())  # item, hash, window, size
    lengths = sorted(r[0] for r in inside.where(F.col("size") < SPAN).select("size").distinct().collect())  # 9 at most
    held = spark.sparkContext.broadcast((filter_of(marks.select(F.explode("prints").alias("hash"))), filter_of(inside.select("hash"))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, windows = held.value
        for batch in batches:
            for a, _, w in chunks(batch.column("text")):
                first, size, h = met_windows(w, prints, windows, lengths)
                doc = w.doc[first] if len(first) else first
                order = np.lexsort((first, h, size, doc))  # each different window of a text once, with its places
                first, size, h, doc = first[order], size[order], h[order], doc[order]
                new = np.ones(len(first), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (size[1:] != size[:-1]) | (h[1:] != h[:-1])
                begin = np.flatnonzero(new)
                places = pa.ListArray.from_arrays(pa.array(np.append(begin, len(first)).astype(np.int32)), pa.array((first - w.first[doc]).astype(np.int32)))
                rows = pa.array(doc[begin] + a)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("hash").take(rows), pa.array(_window_texts(w, first[begin], size[begin]), pa.string()), pa.array(size[begin].astype(np.int32)), places], names=["id", "hash", "window", "size", "at"])

    kind = docs.schema[key].dataType.simpleString()
    id_, text_ = F.col(f"`{key}`"), F.col(f"`{text}`")
    version = F.xxhash64(text_, F.length(text_))
    scanned = docs.select(id_.alias("id"), version.alias("hash"), text_.alias("text")).mapInArrow(scan, f"id {kind}, hash bigint, window string, size int, at array<int>")
    # Here the words themselves are compared. Equal rows give the same windows, of which one is kept.
    asked = materialise(scanned.join(inside.select("window").distinct(), "window", "left_semi").dropDuplicates(["id", "hash", "window"]))
    spans = F.array_sort(F.flatten(F.collect_list(F.transform("at", lambda i: F.struct(i.alias("from"), (i + F.col("size")).alias("to"))))))
    begin = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    covered = lambda a, s: F.struct(F.greatest(a["upto"], s["to"]).alias("upto"), (a["n"] + F.greatest(F.lit(0), s["to"] - F.greatest(a["upto"], s["from"]))).alias("n"))
    n_hit = asked.groupBy("id", "hash").agg(spans.alias("spans")).select("id", "hash", F.aggregate("spans", begin, covered)["n"].alias("n_hit"))
    found = asked.join(inside.select("window", "item"), "window").groupBy("id", "hash").agg(F.array_sort(F.collect_set("item")).alias("items"))
    same = F.expr("h.id <=> f.id AND h.hash = f.hash")
    checked = materialise(n_hit.alias("h").join(found.alias("f"), same).select(F.col("h.id").alias("_id"), F.col("h.hash").alias("_hash"), "n_hit", "items"))

    own = others(docs, "n_words", "n_hit", "items", "contaminated")
    n_words = F.regexp_count(F.coalesce(text_, F.lit("")), F.lit(WORD)).cast("long")
    left = docs.select(packed(docs, own), n_words.alias("n_words"), id_.alias("_d_id"), version.alias("_d_hash"))
    joined = left.join(checked, F.expr("_d_id <=> _id AND _d_hash = _hash"), "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return unpacked(joined, own, "n_words", hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (hit > 0).alias("contaminated"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
ip AS (SELECT item_id, least(len(w), 10) AS k, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS j FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[j:j + k - 1], ' ') AS g FROM ip),
dp AS (SELECT rid, k, w, unnest(range(1, len(w) - k + 2)) AS j FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k),
hits AS (SELECT rid, dp.k, j, item_id FROM dp JOIN iw ON iw.k = dp.k AND iw.g = array_to_string(w[j:j + dp.k - 1], ' ')),
words AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(j, j + k)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
