"""The trie of all prefixes of conversations, built by cutting at half depth.

A sequence of turns is cut at half its depth, and each half again, until single turns are left. What stands above a cut is
named by its content: the name that its own upper end has, with the content down to the cut. So the trie above all cuts of
a depth and the forests below them don't wait for each other: names come from contents, equal names are one node. Within a
stretch of turns the cuts are made inside a row; stretches are themselves the turns of a shorter sequence, which is named
in the same way and gives each stretch the name that it hangs from.

Totals go upward by the same cuts. A node is in the lower half of one cut for each bit of its depth, and hangs there below
one cut prefix; each cut prefix sums what hangs below it and hands the sum to the nodes of the upper half above it. Every
pair of a node and one above it is parted by exactly one cut, so nothing is counted twice, and a sequence of n turns costs
n * log(n) rows, not n * n.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import materialise, table

#: Turns that share a row while they are named, and values of `turn` within which a conversation's turns are numbered.
STRETCH, NUMBERED = 512, 4096
#: Members of a node that share a row before they are hashed, and ancestors that come from one row.
MEMBERS, ANCESTORS = 4096, 4096
ROOT = b"\0" * 32
NOTHING = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame, kept: int = 6, block: int = 100) -> DataFrame:
    """conv_id, h, first, base, pos, token, size, n: each conversation's turns from 1 in the order of turn.

    token is a hash of role and text, size the text's code points; a null role or text is empty. A null turn comes first;
    equal turns come by their tokens. n is how many turns there are, h and first how many come from the conversation base:
    as many as asked for, and as there are. Numbers come from counts of stretches of turn, so no task numbers a whole
    conversation. Rows with a null conv_id are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    known = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("token"), F.length(text).cast("long").alias("size")
    )
    stretch = F.coalesce(F.floor(F.col("turn") / NUMBERED), F.lit(-(1 << 62))).alias("stretch")
    known = known.select("*", stretch)
    counts = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")).select("conv_id", stretch).groupBy("conv_id", "stretch").agg(F.count("*").alias("k"))
    before = F.sum("k").over(W.partitionBy("conv_id").orderBy("stretch").rowsBetween(W.unboundedPreceding, 0)) - F.col("k")
    counts = materialise(counts.select("*", before.alias("before")))
    n = counts.groupBy("conv_id").agg(F.sum("k").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % kept
    convs = n.select("*", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("base"))
    bases = n.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(bases, "base", "left").select("conv_id", "n", "h", "base", F.least("h", F.coalesce("n_base", F.lit(0))).alias("first"))
    placed = counts.join(convs, "conv_id")
    within = F.row_number().over(W.partitionBy("conv_id", "stretch").orderBy(F.asc_nulls_first("turn"), "token"))
    turns = known.select("*", within.alias("within")).join(placed, ["conv_id", "stretch"])
    return turns.select("conv_id", "h", "first", "base", (F.col("before") + F.col("within")).alias("pos"), "token", "size", "n")


def rebuilt(turns: DataFrame, kept: int = 6, block: int = 100) -> tuple[DataFrame, DataFrame]:
    """Sequences (seq, pos, token, size, last) and their numbers (seq, n): each conversation with its first h turns taken
    from the conversation base, then its own after its first h. A sequence may have no turns."""
    convs = turns.where("pos = 1").select("conv_id", "h", "first", "base", (F.col("first") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"))
    convs = materialise(convs)
    own = turns.where("pos > h").select(F.col("conv_id").alias("seq"), (F.col("pos") - F.col("h") + F.col("first")).alias("pos"), "token", "size", (F.col("pos") == F.col("n")).alias("last"))
    lent = turns.where((F.col("conv_id") % block == 0) & (F.col("pos") < kept)).select(F.col("conv_id").alias("base"), "pos", "token", "size")
    taken = convs.where("first > 0").select(F.col("conv_id").alias("seq"), "base", "first", "total").join(lent, "base").where("pos <= first")
    taken = taken.select("seq", "pos", "token", "size", (F.col("pos") == F.col("total")).alias("last"))
    return own.unionByName(taken), convs.select(F.col("conv_id").alias("seq"), F.col("total").alias("n"))


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def _named(root: pd.Series, tokens: pd.Series) -> pd.Series:
    return pd.Series([halved(r, list(t)) for r, t in zip(root, tokens)])


def halved(root: bytes, tokens: list[bytes]) -> list[bytes]:
    """The name of each prefix of tokens that hangs from root: cut at half depth, each half again."""
    names, span = [root, *tokens], 1 << len(tokens).bit_length() >> 1
    while span:
        for cut in range(span, len(names), 2 * span):
            names[cut] = hashlib.sha256(names[cut - span] + hashlib.sha256(b"".join(tokens[cut - span : cut])).digest()).digest()
        span //= 2
    return names[1:]


def prefix_names(turns: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """turns (seq, pos, token, size, last) without token and with name: equal for equal prefixes of the same length, and
    for no others."""
    place = F.floor((F.col("pos") - 1) / stretch)
    rows = turns.groupBy("seq", place.alias("place")).agg(F.array_sort(F.collect_list(F.struct("pos", "token", "size", "last"))).alias("t"))
    longest = turns.agg(F.max("pos")).first()[0] or 0
    if longest > stretch:
        rows = materialise(rows)
        content = F.unhex(F.sha2(F.array_join(F.transform("t", lambda x: F.hex(x["token"])), ""), 256))
        whole = rows.where(F.size("t") == stretch).select("seq", (F.col("place") + 1).alias("pos"), content.alias("token"), F.lit(0).cast("long").alias("size"), F.lit(False).alias("last"))
        above = prefix_names(whole, stretch).select("seq", F.col("pos").alias("place"), F.col("name").alias("root"))
        rows = rows.join(above, ["seq", "place"], "left")
    else:
        rows = rows.withColumn("root", F.lit(None).cast("binary"))
    named = rows.select("seq", "t", _named(F.coalesce("root", F.lit(ROOT)), F.transform("t", lambda x: x["token"])).alias("names"))
    each = named.select("seq", F.explode(F.arrays_zip("t", "names")).alias("x"))
    return each.select("seq", "x.t.pos", "x.t.size", "x.t.last", F.col("x.names").alias("name"))


def hashed_members(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of ends (conv_id, depth, seq): the hash of each node's members in order.

    Members share rows by thousands before they are dealt out; then a node's go through one task, row by row, as such a
    hash can only be taken in order. No node's members are ever held together.
    """
    packed = ends.groupBy("conv_id", "depth", F.floor(F.col("seq") / MEMBERS).alias("at")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("seq")), lambda s: s.cast("string")), ",").alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, None
        for batch in batches:
            done: list[tuple] = []
            for conv, depth, members in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv, depth) != node:
                    if held:
                        done.append((*node, held.hexdigest()))
                    node, held = (conv, depth), hashlib.sha256()
                else:
                    held.update(b",")
                held.update(members.encode())
            yield _rows(done)
        if held:
            yield _rows([(*node, held.hexdigest())])

    key = ["conv_id", "depth"]
    return packed.repartition(*key).sortWithinPartitions(*key, "at").select(*key, "members").mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])


def prefix_trie(turns: DataFrame, sequences: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: the trie's nodes.

    turns: seq, pos (from 1, without gaps), token, size, last. sequences: all seq with n, those without turns too. A node is known by its
    depth and its smallest member. No sequences, no rows; only sequences without turns: the root, which is a leaf then.
    """
    key = ["conv_id", "depth"]
    named = materialise(prefix_names(turns))
    nodes = named.groupBy("pos", "name").agg(F.min("seq").alias("conv_id"), F.count("*").alias("n_convs"), F.first("size").alias("size"))
    nodes = materialise(nodes.select("conv_id", F.col("pos").alias("depth"), "name", "n_convs", "size"))
    root, n_sequences = sequences.agg(F.min("seq"), F.count("*")).first()
    top = turns.sparkSession.createDataFrame([(root, 0, n_sequences, 0)] if n_sequences else [], "conv_id long, depth long, n_convs long, size long")

    # The node at each depth of each sequence; the root is at depth 0 of all.
    owners = nodes.select(F.col("depth").alias("pos"), "name", F.col("conv_id").alias("node"))
    path = named.join(owners, ["pos", "name"]).select("seq", "pos", "node", "last")
    path = materialise(path.unionByName(sequences.select("seq", F.lit(0).cast("long").alias("pos"), F.lit(root).cast("long").alias("node"), (F.col("n") == 0).alias("last"))))

    # Where each node hangs: its parent (bit -1), and the prefix cut above it for each bit of its depth.
    bits = F.filter(F.sequence(F.lit(0), F.length(F.bin("depth")) - 1), lambda k: F.call_function("shiftright", F.col("depth"), k).bitwiseAND(F.lit(1)) == 1)
    cuts = F.transform(bits, lambda k: F.struct(k.alias("bit"), F.call_function("shiftleft", F.call_function("shiftright", F.col("depth"), k), k).alias("pos")))
    asked = F.array_append(cuts, F.struct(F.lit(-1).alias("bit"), (F.col("depth") - 1).alias("pos")))
    asked = nodes.select(*key, "n_convs", "size", F.explode(asked).alias("c")).select(*key, "n_convs", "size", "c.bit", "c.pos")
    hung = asked.join(path.select(F.col("seq").alias("conv_id"), "pos", "node"), ["conv_id", "pos"])
    hung = hung.groupBy(*key).agg(F.first("n_convs").alias("n_convs"), F.first("size").alias("size"), F.max(F.when(F.col("bit") < 0, F.col("node"))).alias("parent_conv_id"), F.collect_list(F.when(F.col("bit") >= 0, F.struct("bit", "pos", "node"))).alias("cuts"))
    top = top.select("*", F.lit(None).cast("long").alias("parent_conv_id"), F.array().cast(hung.schema["cuts"].dataType).alias("cuts"))
    hung = materialise(hung.unionByName(top))

    children = hung.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    known = hung.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    known = known.select("*", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    known = materialise(known)

    # What hangs below each cut prefix, then handed to the upper half: the 2^bit depths above the cut.
    below = known.select("leaf", "saved", F.explode("cuts").alias("c")).groupBy("c.bit", "c.pos", "c.node").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    reach = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    starts = F.explode(F.sequence(F.col("pos") - reach, F.col("pos") - 1, F.lit(ANCESTORS).cast("long"))).alias("start")
    above = below.select("node", "pos", "leaf", "saved", starts)
    above = above.select(F.col("node").alias("seq"), "leaf", "saved", F.explode(F.sequence("start", F.least(F.col("start") + ANCESTORS, F.col("pos")) - 1)).alias("pos"))
    given = above.join(path.select("seq", "pos", "node"), ["seq", "pos"]).groupBy(F.col("node").alias("conv_id"), F.col("pos").alias("depth")).agg(F.sum("leaf").alias("leaves_below"), F.sum("saved").alias("saved_below"))

    ends = hashed_members(path.where("last").select(F.col("node").alias("conv_id"), F.col("pos").alias("depth"), "seq"))
    out = known.join(given, key, "left").join(ends, key, "left")
    total = lambda own, more: (F.col(own) + F.coalesce(more, F.lit(0))).cast("long")
    return out.select(*key, "parent_conv_id", "n_convs", "n_children", total("leaf", "leaves_below").alias("n_leaves"), total("saved", "saved_below").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(materialise(numbered_turns(table(spark, sf_dir, "conversations")))))


def _sql() -> str:
    bits = "xor(v, ascii(substr(s, i, 1)))::BIGINT"
    step = f"SELECT conv_id, s, i, {bits} AS v FROM crc WHERE i <= length(s)"
    for _ in range(8):
        step = f"SELECT conv_id, s, i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END AS v FROM ({step})"
    return f"""
WITH RECURSIVE m AS (SELECT conv_id, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS token, length(coalesce(text, ''))::BIGINT AS size FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, token) AS pos FROM m),
crc(conv_id, s, i, v) AS (SELECT DISTINCT conv_id, conv_id::VARCHAR, 1::BIGINT, 4294967295::BIGINT FROM m UNION ALL SELECT conv_id, s, i + 1, v FROM ({step})),
c AS (SELECT conv_id AS seq, conv_id - conv_id % 100 AS base, xor(v, 4294967295) % 6 AS h FROM crc WHERE i = length(s) + 1),
b AS (SELECT seq, pos, token, size FROM c JOIN t ON t.conv_id = base WHERE pos <= h),
k AS (SELECT c.seq, h, count(b.pos) AS n FROM c LEFT JOIN b USING (seq) GROUP BY 1, 2),
r AS (SELECT * FROM b UNION ALL SELECT seq, pos - h + n, token, size FROM k JOIN t ON t.conv_id = seq WHERE pos > h),
p AS (SELECT seq, pos AS depth, sha256(string_agg(token, '') OVER w) AS name, size, pos = count(*) OVER (PARTITION BY seq) AS last FROM r WINDOW w AS (PARTITION BY seq ORDER BY pos)
  UNION ALL SELECT seq, 0, '', 0, seq NOT IN (SELECT seq FROM r) FROM c),
n AS (SELECT depth, name, min(seq) AS conv_id, count(*) AS n_convs, any_value(size) AS size, coalesce(string_agg(seq::VARCHAR, ',' ORDER BY seq) FILTER (WHERE last), '') AS ends FROM p GROUP BY 1, 2),
u AS (SELECT n.*, o.conv_id AS parent_conv_id FROM n LEFT JOIN p ON p.seq = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN n o ON o.depth = p.depth AND o.name = p.name),
a AS (SELECT conv_id, depth, count(x) AS n_children FROM n LEFT JOIN (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, 1 AS x FROM u WHERE depth > 0) USING (conv_id, depth) GROUP BY 1, 2),
s AS (SELECT p.depth, p.name, sum((n_children = 0)::INTEGER) AS n_leaves, sum((n_convs - 1) * n.size) AS saved FROM n JOIN a USING (conv_id, depth) JOIN p ON p.seq = n.conv_id AND p.depth <= n.depth GROUP BY 1, 2)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256 FROM u JOIN a USING (conv_id, depth) JOIN s USING (depth, name)
"""


OP12_SQL = _sql()
