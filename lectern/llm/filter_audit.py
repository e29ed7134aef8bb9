"""How filters of documents interact: what each removes, and would remove, in every order of them.

One table holds the ids that fail a filter. The documents' ids are split by one table after the other: a left-semi join
gives those that fail the filter too, a left-anti join those that survive it. After the last table each piece holds the ids
that fail one set of filters and no other. A prefix of an order removes whole pieces, so the survivors, removals,
redundancies and lost labels of all prefixes are sums of the pieces' counts: two joins a filter, however many orders there
are. Only ids are joined; texts are read once.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.functions.text import bound
from lectern.llm.common import materialise, new_folder, table, word_array

#: A document in the id tables: its doc_id, and a hash of its text, which tells rows with equal doc_id apart.
ID = ["id", "text_hash"]


@dataclass(frozen=True)
class AuditRules:
    least_words: int = 50
    distinct_percent: int = 65
    capitals_percent: int = 5
    marks: str = "[#$%&*|]"


def _identity(doc_id: Column, text: Column) -> list[Column]:
    return [F.coalesce(doc_id.cast("long"), F.lit(0).cast("long")).alias("id"), F.xxhash64(text, doc_id.isNull()).alias("text_hash")]


def failed_conditions(text: Column, p: AuditRules) -> Column:
    """The letters of the conditions on a text alone that fail it."""
    words, size, capitals = word_array(text), F.length(text), F.regexp_count(text, F.lit("[A-Z]"))
    counts = bound(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    return bound(counts, lambda c: F.array_compact(F.array(
        F.when(c["n"] < p.least_words, F.lit("A")),
        F.when(100 * c["distinct"] < p.distinct_percent * c["n"], F.lit("B")),
        F.when(100 * capitals > p.capitals_percent * size, F.lit("C")),
        F.when(text.rlike(p.marks), F.lit("D")),
    )))


def later_copies(ids: DataFrame) -> DataFrame:
    """The ids (id, text_hash, doc_id, digest) whose text some smaller doc_id has: all but each text's first."""
    firsts = ids.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    return ids.where("doc_id IS NOT NULL").join(firsts, ["digest", "doc_id"], "left_anti").select(*ID)


def failing_tables(docs: DataFrame, p: AuditRules = AuditRules()) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The documents' ids (id, text_hash, doc_id, part), and for each filter A to E the table of the ids that fail it."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    base = base.select(*_identity(F.col("doc_id"), F.col("text")), "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), failed_conditions(F.col("text"), p).alias("failed"))
    base = materialise(base)
    alone = base.select(*ID, F.explode("failed").alias("filter"))
    copies = later_copies(base).withColumn("filter", F.lit("E"))
    path = new_folder(docs.sparkSession, "failing")
    alone.unionByName(copies).write.partitionBy("filter").parquet(path)
    stored = docs.sparkSession.read.schema("id long, text_hash long, filter string").parquet(path)
    return base.select(*ID, "doc_id", "part"), {f: stored.where(F.col("filter") == f).select(*ID) for f in "ABCDE"}


def split_by_filters(ids: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """ids with failed: the bits of the filters in whose tables they are, in the order of the tables."""
    pieces = ids.withColumn("failed", F.lit(0))
    for i, found in enumerate(failing.values()):
        removed = pieces.join(found, ID, "left_semi").withColumn("failed", F.col("failed") + (1 << i))
        pieces = removed.unionByName(pieces.join(found, ID, "left_anti"))
        if i + 1 < len(failing):
            pieces = materialise(pieces)
    return pieces


def filter_audit(ids: DataFrame, failing: dict[str, DataFrame], labels: DataFrame, orders: list[str] | None = None) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: for each part and
    each step of each order.

    ids: id, text_hash, doc_id, part. failing: for each filter (one letter) the ids that fail it. labels: doc_id, quality,
    toxic; a document is good (toxic) if some label says so. orders: of all filters' letters; all there are by default, so
    the number of filters should be small. shapley sums a filter's removals over all orders, whichever are asked for.

    Each row of ids counts for itself, repeated rows too; rows with a null doc_id are never copies and have no labels. A
    part without failing ids has its rows with zeros; no ids, no rows. Columns of the inputs other than those named here
    aren't read, so their names don't matter. The only texts are those that failing_tables() reads, whole, one at a time.
    """
    names = "".join(failing)
    k = len(names)
    orders = orders or ["".join(o) for o in permutations(names)]
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("l_doc")).agg(F.max(F.expr("quality = 1")).alias("good"), F.max(F.expr("toxic = 1")).alias("toxic"))
    known = ids.join(said, F.col("doc_id") == F.col("l_doc"), "left")
    flag = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c)
    pieces = split_by_filters(known.select(*ID, "part", flag("good"), flag("toxic")), failing)
    counts = pieces.groupBy("part", "failed").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))

    # Steps with the same filters before them and the same filter are one: k * 2^(k-1) of them, for k! * k steps.
    places = [(before, f) for f in range(k) for before in range(1 << k) if not before >> f & 1]
    steps = F.explode(F.array(*[F.struct(F.lit(b).alias("before"), F.lit(f).alias("filter")) for b, f in places]))
    each = counts.select("*", steps.alias("s")).select("part", "failed", "n", "good", "toxic", "s.before", "s.filter")
    bit = F.call_function("shiftleft", F.lit(1), F.col("filter"))
    fails, earlier = F.col("failed").bitwiseAND(bit) != 0, F.col("failed").bitwiseAND(F.col("before")) != 0
    total = lambda what, c="n": F.sum(F.when(what, F.col(c)).otherwise(0)).alias
    summed = each.groupBy("part", "before", "filter").agg(
        total(~fails & ~earlier)("kept"), total(fails & ~earlier)("removed"), total(fails & earlier)("redundant"), total(F.col("failed") == bit)("unique_fails"),
        total(fails & ~earlier, "good")("good_lost"), total(fails & ~earlier, "toxic")("toxic_lost"),
    )
    ways = F.get(F.array(*[F.lit(factorial(s) * factorial(k - 1 - s)) for s in range(k)]), F.bit_count("before").cast("int")).cast("long")
    summed = summed.withColumn("shapley", F.sum(F.col("removed") * ways).over(W.partitionBy("part", "filter")))
    rows = [(o, i + 1, sum(1 << names.index(c) for c in o[:i]), names.index(o[i])) for o in orders for i in range(k)]
    asked = ids.sparkSession.createDataFrame(rows, "filter_order string, step int, before int, filter int")
    found = summed.join(F.broadcast(asked), ["before", "filter"])  # as many rows as steps are asked for, whatever the input
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, failing = failing_tables(table(spark, sf_dir, "documents"))
    return filter_audit(ids, failing, table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM t),
d AS (SELECT part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM w),
f AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS f,
    count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM d GROUP BY 1, 2),
l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, unnest(range(1, 6)) AS step FROM o),
p AS (SELECT part, o, step, substr(o, step, 1) AS x, n, good, toxic, f, contains(f, substr(o, step, 1)) AS fails, len(translate(f, substr(o, 1, step - 1), '')) < len(f) AS earlier FROM f, s),
r AS (SELECT part, o, step, any_value(x) AS x, sum(n) FILTER (WHERE NOT fails AND NOT earlier) AS kept, sum(n) FILTER (WHERE fails AND NOT earlier) AS removed, sum(n) FILTER (WHERE fails AND earlier) AS redundant,
    sum(n) FILTER (WHERE f = x) AS unique_fails, sum(good) FILTER (WHERE fails AND NOT earlier) AS good_lost, sum(toxic) FILTER (WHERE fails AND NOT earlier) AS toxic_lost FROM p GROUP BY 1, 2, 3)
SELECT part, o AS filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM r
"""
