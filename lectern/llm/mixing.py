"""Mixing sources to target weights by temperature, with DataFrame functions only.

The token share of each source is raised to an exponent between 0 (all sources alike) and 1 (as they are). Entropy and
the most repeated source both move in one direction with the exponent, so it is found by bisection: every round
evaluates evenly spaced exponents in one pass over the table of sources and keeps the interval that holds the answer.
The weights give each source a budget of tokens. A source is cut into blocks of about as many tokens each; an epoch is
a permutation of its blocks and of the documents within each. Whole epochs fit the budget first, then the first blocks
of one more, then the first documents of the block where the budget ends. No step needs the documents of a source
together: only the sums of its blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import materialise, table

#: Exponents looked at in one round, and rounds: 16 ** 7 intervals.
GRID, ROUNDS = 16, 7


#: First digits of a block's turn that make its stretch of the order: 4096 stretches.
HEX_DIGITS = 3


@dataclass(frozen=True)
class MixRules:
    #: Entropy to reach, as a part of the logarithm of the number of sources.
    target_entropy: float = 0.98
    #: No source is repeated more often, where any exponent can give that.
    max_repeats: float = 4.0
    #: Tokens of the mixture; None: as many as there are.
    budget: int | None = None
    block_tokens: int = 200_000
    seed: int = 17


def exponent(sources: DataFrame, tokens: int, n_sources: int, p: MixRules) -> float:
    """The largest exponent that reaches the entropy, or the least that keeps the repetition limit if that is larger.

    sources: one row each, with its tokens (above 0).
    """
    budget = tokens if p.budget is None else p.budget
    share = F.col("tokens") / F.lit(float(tokens))

    def bisect(fits) -> tuple[float, float]:
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            at = [lo + (hi - lo) * i / GRID for i in range(GRID + 1)]
            powered = sources.select(share.alias("s"), "tokens", F.explode(F.array(*map(F.lit, at))).alias("a")).withColumn("x", F.pow("s", F.col("a")))
            found = powered.groupBy("a").agg(F.sum("x").alias("z"), F.sum(F.col("x") * F.log("s")).alias("l"), F.max(F.col("x") / F.col("tokens")).alias("m")).collect()
            low = [r["a"] for r in found if fits(math.log(r["z"]) - r["a"] * r["l"] / r["z"], budget * r["m"] / r["z"])]
            if not low:
                return lo, lo
            lo = max(low)
            if lo >= hi:
                return hi, hi
            hi = min(a for a in at if a > lo)
        return lo, hi

    by_entropy = bisect(lambda h, m: h >= p.target_entropy * math.log(n_sources))[0]
    by_repeats = bisect(lambda h, m: m > p.max_repeats)[1]
    return max(by_entropy, by_repeats)


def mix_sources(docs: DataFrame, p: MixRules = MixRules(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for every time that a document is used: key, source, n_tokens, epoch (from 0), block, block_rank (of the
    block in its epoch, from 1), rank (of the document in its block and epoch, from 1).

    Tokens are words `[^\\x20\\x09-\\x0D]+`. A document without any is never used; a null source is a source like another.
    Equal rows are documents like others; of those with equal keys the order is by tokens. An empty table gives none.
    Columns of docs other than key, source and text are left out, whatever their names.
    The sums of a source's uses never exceed its budget. Texts are only counted, whole, however long.
    """
    words = F.regexp_count(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit("[^ \\t-\\r]+")).cast("long")
    docs = materialise(docs.select(F.col(f"`{key}`").alias("id"), "source", words.alias("n_tokens")).where("n_tokens > 0"))
    sources = materialise(docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens")))
    total, n = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    if n == 0:
        return docs.select(F.col("id").alias(key), "source", "n_tokens", *[F.lit(0).cast("long").alias(c) for c in ("epoch", "block", "block_rank", "rank")])
    alpha = exponent(sources, total, n, p)
    budget = total if p.budget is None else p.budget
    z = sources.agg(F.sum(F.pow(F.col("tokens") / F.lit(float(total)), F.lit(alpha)))).first()[0]
    quota = F.floor(F.pow(F.col("tokens") / F.lit(float(total)), F.lit(alpha)) / F.lit(z) * F.lit(float(budget)) + 1e-6)
    sources = materialise(
        sources.select("source", "tokens", quota.alias("quota"))
        .select("source", F.floor(F.col("quota") / F.col("tokens")).alias("full"), (F.col("quota") % F.col("tokens")).alias("rest"), F.ceil(F.col("tokens") / F.lit(p.block_tokens)).alias("blocks"))
    )

    drawn = lambda *c: F.md5(F.concat_ws(":", F.lit(str(p.seed)), *c))
    number = F.conv(F.substring(drawn(F.lit("b"), F.col("id").cast("string")), 1, 8), 16, 10).cast("long")
    placed = docs.alias("d").join(sources.alias("s"), F.expr("d.source <=> s.source"))
    placed = placed.select("d.id", "d.source", "d.n_tokens", "s.full", "s.rest", (number % F.col("s.blocks")).alias("block"))
    placed = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full"))).alias("epoch"))

    # Sums of blocks, and where each starts in its epoch.
    name = F.coalesce("source", F.lit(""))
    blocks = placed.groupBy("source", "epoch", "block").agg(F.sum("n_tokens").alias("size"))
    # Running sums in two steps: within stretches of the order, then over the stretches, of which no source has more than
    # 4096; so however many blocks a source has, no task goes over all of them.
    blocks = blocks.withColumn("turn", drawn(F.lit("o"), F.col("epoch").cast("string"), F.col("block").cast("string"), name))
    blocks = materialise(blocks.withColumn("stretch", F.substring("turn", 1, HEX_DIGITS)))
    upto = W.partitionBy("source", "epoch").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    stretches = blocks.groupBy("source", "epoch", "stretch").agg(F.sum("size").alias("sum"), F.count("*").alias("n"))
    none = F.lit(0).cast("long")
    stretches = stretches.select("source", "epoch", "stretch", F.coalesce(F.sum("sum").over(upto), none).alias("first"), F.coalesce(F.sum("n").over(upto), none).alias("past"))
    run = W.partitionBy("source", "epoch", "stretch").orderBy("turn", "block")
    within = blocks.select("*", (F.sum("size").over(run) - F.col("size")).alias("before"), F.row_number().over(run).cast("long").alias("k"))
    joined = within.alias("w").join(stretches.alias("s"), F.expr("w.source <=> s.source AND w.epoch = s.epoch AND w.stretch = s.stretch"))
    blocks = joined.select(F.col("w.source").alias("b_source"), F.col("w.epoch").alias("b_epoch"), F.col("w.block").alias("b_block"), (F.col("w.before") + F.col("s.first")).alias("before"), (F.col("w.k") + F.col("s.past")).alias("block_rank"))
    blocks = materialise(blocks)
    used = placed.join(blocks, F.expr("source <=> b_source AND epoch = b_epoch AND block = b_block"))
    inner = W.partitionBy("source", "epoch", "block").orderBy("turn", "id", "n_tokens")
    used = used.withColumn("turn", drawn(F.lit("d"), F.col("epoch").cast("string"), F.col("id").cast("string")))
    used = used.select("*", F.row_number().over(inner).cast("long").alias("rank"), F.sum("n_tokens").over(inner.rowsBetween(W.unboundedPreceding, 0)).alias("upto"))
    used = used.where((F.col("epoch") < F.col("full")) | (F.col("before") + F.col("upto") <= F.col("rest")))
    return used.select(F.col("id").alias(key), "source", "n_tokens", "epoch", "block", "block_rank", "rank")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def _sql(p: MixRules) -> str:
    """The same rounds and sums in SQL."""

    def rounds(name: str, fits: str) -> str:
        out = f"{name}0 AS (SELECT 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi)"
        for i in range(1, ROUNDS + 1):
            out += f""",
{name}{i} AS (SELECT CASE WHEN found IS NULL THEN lo ELSE least(found, hi) END AS lo, CASE WHEN found IS NULL THEN lo WHEN found >= hi THEN hi ELSE above END AS hi FROM (
  SELECT any_value(lo) AS lo, any_value(hi) AS hi, max(a) FILTER (WHERE {fits}) AS found FROM (
    SELECT g.a, any_value(g.lo) AS lo, any_value(g.hi) AS hi, sum(pow(share, g.a)) AS z, sum(pow(share, g.a) * ln(share)) AS l, max(pow(share, g.a) / tokens) AS m
    FROM (SELECT lo, hi, lo + (hi - lo) * i / {GRID} AS a FROM {name}{i - 1}, range({GRID + 1}) AS t(i)) g, sh GROUP BY g.a)),
  LATERAL (SELECT min(lo + (hi - lo) * i / {GRID}) AS above FROM range({GRID + 1}) AS t(i) WHERE lo + (hi - lo) * i / {GRID} > found))"""
        return out

    budget = "total" if p.budget is None else str(p.budget)
    return f"""
WITH d AS (SELECT doc_id AS id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+'))::BIGINT AS n FROM documents),
w AS (SELECT * FROM d WHERE n > 0), t AS (SELECT sum(n)::BIGINT AS total, count(DISTINCT coalesce(source, chr(1))) AS k FROM w),
sh AS (SELECT source, tokens, tokens / total::DOUBLE AS share, total, k FROM (SELECT source, sum(n)::BIGINT AS tokens FROM w GROUP BY 1), t),
{rounds("e", f"ln(z) - a * l / z >= {p.target_entropy} * ln((SELECT k FROM t))")},
{rounds("r", f"(SELECT {budget} FROM t) * m / z > {p.max_repeats}")},
al AS (SELECT greatest((SELECT lo FROM e{ROUNDS}), (SELECT hi FROM r{ROUNDS})) AS alpha),
q AS (SELECT source, tokens, floor(pow(share, alpha) / sum(pow(share, alpha)) OVER () * ({budget})::DOUBLE + 1e-6)::BIGINT AS quota FROM sh, al),
s AS (SELECT source, quota // tokens AS whole, quota % tokens AS rest, ceil(tokens / {p.block_tokens}.0)::BIGINT AS blocks FROM q),
p AS (SELECT w.id, w.source, n, whole, rest, ('0x' || substr(md5('{p.seed}:b:' || w.id), 1, 8))::BIGINT % blocks AS block, unnest(range(0, whole + 1)) AS epoch FROM w JOIN s ON w.source IS NOT DISTINCT FROM s.source),
b AS (SELECT source, epoch, block, sum(n) AS size FROM p GROUP BY ALL),
o AS (SELECT *, sum(size) OVER x - size AS before, row_number() OVER x AS block_rank FROM b WINDOW x AS (PARTITION BY source, epoch ORDER BY md5('{p.seed}:o:' || epoch || ':' || block || ':' || coalesce(source, '')), block)),
u AS (SELECT p.*, before, block_rank, row_number() OVER y AS rank, sum(n) OVER (y ROWS UNBOUNDED PRECEDING) AS upto FROM p JOIN o ON p.source IS NOT DISTINCT FROM o.source AND p.epoch = o.epoch AND p.block = o.block
  WINDOW y AS (PARTITION BY p.source, p.epoch, p.block ORDER BY md5('{p.seed}:d:' || p.epoch || ':' || p.id), p.id, n))
SELECT id AS doc_id, source, n AS n_tokens, epoch, block, block_rank, rank FROM u WHERE epoch < whole OR before + upto <= rest
"""


OP10_SQL = _sql(MixRules())
