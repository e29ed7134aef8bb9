"""URL rules by a sort-merge range join, with DataFrame functions only.

A rule (host, path) fits its host and all subdomains where the path starts with the rule's. Each url gives one key for
every suffix of its host: the suffix's labels in reverse order, a NUL, the path. A rule has one such key, and it fits
exactly the keys that start with it: an interval of the sorted keys. Intervals of prefixes nest or are disjoint, so one
sweep over the sorted keys with a stack of active rules finds the longest for each. The stack needs no state of its
own: an opening pushes the rule, a closing uncovers the rule that encloses it, and the last event before a key tells
the top.

The key space is cut at quantiles of a hash-chosen sample of keys into as many ranges as there are shuffle
partitions; rules that reach over a cut open again in each range. Equal keys are swept once, so a host with a third of
all urls, or very many home pages of one top-level domain, are cut as any other stretch of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import materialise, others, packed, table, unpacked

#: Fixed values of the contract: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Above every byte of UTF-8.
LAST = b"\xff"
#: Keys looked at for each cut between ranges; they are all that the driver sees.
SAMPLE_PER_RANGE = 64


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("\0"), path)


def _range_of(key: Column, cuts: list[str]) -> Column:
    """How many cuts are at or below key (bytes), by halving steps."""
    if not cuts:
        return F.lit(0)
    held = F.array(*[F.lit(c.encode()) for c in cuts])
    steps = [1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(F.get(held, at + s - 1) <= key, at + s).otherwise(at))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """Each row of pages with: host, path, rule (host + path of the longest rule that fits, else null), verdict.

    rules: verdict, host, path. Of two equal rules a block holds; of two rules as long, the one with the longer host.
    A null url has an empty host and path, which no rule fits. Repeated rows stay. No rules: every url gets the default.
    Columns of pages with the name of a result are replaced; others stay, whatever their names. Urls are compared whole,
    however long. No pages, no rows.
    """
    spark = pages.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rules = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).groupBy(lower_ascii(F.col("host")).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.select(canonical(F.col("host"), F.col("path")).alias("key"), "host", "path", "verdict", F.concat("host", "path").alias("rule"))

    own = others(pages, "host", "path", "rule", "verdict")
    rows = pages.select(packed(pages, own), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    # What is asked about is each different host and path once; rules know nothing of the rest of a url.
    places = materialise(rows.select("host", "path").distinct())
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = places.select("host", "path", F.explode(suffixes).alias("suffix")).select("host", "path", canonical(F.col("suffix"), F.col("path")).alias("key"))
    # Of equal keys one is swept: all hosts of one ending with the same path share one.
    swept = materialise(keys.select("key").distinct())
    total = swept.count()
    every = max(1, total // (n * SAMPLE_PER_RANGE))
    seen = sorted(r[0] for r in swept.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).collect())  # about n * SAMPLE_PER_RANGE
    cuts = sorted({seen[i * len(seen) // n] for i in range(1, n)}) if len(seen) >= n > 1 else []

    # The rule that encloses another: the longest proper prefix of its key that is a rule of the same host.
    prefixes = rules.select(F.col("key").alias("inner"), F.explode(F.sequence(F.lit(0), F.length("path"))).alias("i"), "host", "path").where("i < length(path)")
    prefixes = prefixes.select("inner", canonical(F.col("host"), F.expr("left(path, i)")).alias("key"))
    parents = prefixes.join(rules.select("key"), "key").groupBy("inner").agg(F.max_by("key", F.length("key")).alias("outer"))
    # A rule ends behind every key that starts with its own.
    closed = rules.select("key", F.encode("key", "UTF-8").alias("from"), F.concat(F.encode("key", "UTF-8"), F.lit(LAST)).alias("end"))
    closed = closed.join(parents.withColumnRenamed("inner", "key"), "key", "left").select("*", _range_of(F.col("from"), cuts).alias("lo"), _range_of(F.col("end"), cuts).alias("hi"))
    null = F.lit(None).cast("string")
    opens = closed.select(F.explode(F.sequence("lo", "hi")).alias("range"), "key", "lo", "from").select("range", F.when(F.col("range") == F.col("lo"), F.col("from")).otherwise(F.lit(b"")).alias("at"), F.length("key").alias("turn"), F.col("key").alias("top"), null.alias("key"))
    closes = closed.select(F.col("hi").alias("range"), F.col("end").alias("at"), F.lit(0).alias("turn"), F.coalesce("outer", F.lit("")).alias("top"), null.alias("key"))
    at = F.encode("key", "UTF-8")
    asked = swept.select(_range_of(at, cuts).alias("range"), at.alias("at"), F.lit(1 << 30).alias("turn"), null.alias("top"), "key")
    sweep = W.partitionBy("range").orderBy("at", "turn").rowsBetween(W.unboundedPreceding, 0)
    answered = opens.unionByName(closes).unionByName(asked).select("key", F.last("top", ignorenulls=True).over(sweep).alias("top"))
    hits = answered.where("key IS NOT NULL AND top <> ''").join(rules.withColumnRenamed("key", "top").select("top", "rule", "verdict", F.length("host").alias("size")), "top")
    # Written first, so that both joins below read tables: there Spark can split a key with very many rows.
    hits = materialise(hits.select("key", "rule", "verdict", "size"))
    best = keys.join(hits, "key").groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "size")).alias("hit"))
    best = materialise(best)
    joined = rows.join(best, ["host", "path"], "left")
    return unpacked(joined, own, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join("(" + ", ".join(f"'{x}'" for x in rule) + ")" for rule in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS t(verdict, host, path)")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


OP5_SQL = r"""
WITH p AS (SELECT page_id, row_number() OVER () AS rid,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
f AS (SELECT p.rid, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY p.rid ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
  FROM p JOIN r ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath))
SELECT page_id, host, path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM p LEFT JOIN f ON p.rid = f.rid AND f.k = 1
"""
