"""Secret scans with multipart credential linking, with DataFrame functions only.

Strong patterns are reported by themselves. Weak parts (an access identifier, a secret without a telling name, an
endpoint) mean little alone; they are reported where complementary parts stand close to each other in one scope. A
scope is a block of text between blank lines. Scopes and parts are intervals of one document: a sweep over both, sorted
by start, gives each part its scope, and the nearest earlier and later part of each kind within it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import materialise, others, packed, table, unpacked

#: Fixed values of the contract: the strong kinds in their order. Group 2 of each is what the length is asked of.
STRONG = {
    "assign": ("((?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?)([A-Za-z0-9+/_.=-]+)", 6),
    "access": ("()(AKIA[A-Z0-9]+)", 20),
    "hex": ("()([0-9a-f]{24,})", 24),
}
#: Parts that count only together; each with the kind of part that it is.
WEAK = {
    "link_id": ("((?i:(?:access|client|account|key)[_-]?id|user(?:name)?|login)[\"']?\\x20*[:=]\\x20*[\"']?)([A-Za-z0-9_.@-]+)", 3),
    "link_secret": ("((?i:pwd|pass(?:phrase)?|credentials?|auth|private[_-]?key)[\"']?\\x20*[:=]\\x20*[\"']?)([A-Za-z0-9+/_.=!@-]+)", 4),
    "link_endpoint": "endpoint",
}
ENDPOINT = ("()((?i:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\\s\"'<>]+)", 8)
KINDS = ["assign", "access", "hex", "link_id", "link_secret", "link_endpoint"]
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "link_id": "id", "link_secret": "secret", "link_endpoint": "endpoint"}
SPAN = "array<struct<start:int,kind:int,end:int>>"


@dataclass(frozen=True)
class LinkRules:
    #: Complementary parts stand at most so many characters apart.
    max_gap: int = 200


BLOCK = 256


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body asks for it."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each element what merge makes of all before it, starting at zero; merge is associative. The elements are taken in
    blocks, so that the arrays that grow step by step stay short."""

    def within(block: Column, first: Column) -> Column:
        start = F.struct(first.alias("now"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, start, lambda a, x: F.struct(merge(a["now"], x).alias("now"), F.concat(a["out"], F.array(a["now"])).alias("out")), lambda a: a["out"])

    def blocks(v: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(v, i * BLOCK + 1, BLOCK))

    def whole(held: Column) -> Column:
        firsts = within(F.transform(held, lambda x: F.aggregate(x, zero, merge)), zero)
        return bound(firsts, lambda f: F.flatten(F.transform(held, lambda x, i: within(x, F.get(f, i)))))

    return bound(values, lambda v: bound(blocks(v), whole))


def starts(sizes: Column) -> Column:
    """Where each piece of a text starts, by their lengths."""
    return running(sizes, F.lit(0), lambda a, n: a + n)


def _spans(text: Column, kind: str, pattern: str, least: int) -> Column:
    """Leftmost non-overlapping matches as (start, kind, end); those with a shorter group 2 are dropped, without retries.

    The text holds no \x01 or \x02. Each match is put between two \x01 marks; in the pieces between marks every second
    one is a match, and the lengths of all before give its place.
    """
    pieces = F.split(F.regexp_replace(text, pattern, "\x01$1\x02$2\x01"), "\x01", -1)

    def found(x: Column) -> Column:
        sizes = F.transform(x, lambda piece, i: F.length(piece) - i % 2)
        all_ = F.zip_with(x, starts(sizes), lambda piece, at: F.struct(at.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (at + F.length(piece) - 1).alias("end"), F.length(F.substring_index(piece, "\x02", -1)).alias("n")))
        hits = F.filter(all_, lambda s, i: (i % 2 == 1) & (s["n"] >= least))
        return F.transform(hits, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    # Plain searches come first: what lacks these letters has no match.
    may = {"access": F.contains(text, F.lit("AKIA")), "hex": F.lit(True), "link_endpoint": F.contains(text, F.lit("://"))}.get(kind, F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")))
    return F.when(may & text.rlike(pattern), bound(pieces, found)).otherwise(F.array().cast(SPAN))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secret_scans(docs: DataFrame, p: LinkRules = LinkRules(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each row of docs with: base (strong spans) and all_spans (with linked weak ones), arrays of (start, kind, end) by
    start, then kind (kind: index in KINDS; code points, end exclusive).

    A null text has no spans. Repeated rows each get the same spans; a null key is a key like another. Columns of the
    input with the name of a result are replaced; others stay, whatever their names. Texts are searched whole, within their
    rows; spans that begin together come by kind. No documents, no rows.
    """
    own = others(docs, "base", "all_spans")
    id_, text_ = F.col(f"`{key}`"), F.col(f"`{text}`")
    version = F.xxhash64(text_, F.length(text_))
    marked = F.contains(text_, F.lit("\x01")) | F.contains(text_, F.lit("\x02"))
    masked = F.coalesce(F.when(marked, F.translate(text_, "\x01\x02", "\x03\x03")).otherwise(text_), F.lit(""))
    weak = [(k, *(ENDPOINT if k == "link_endpoint" else WEAK[k])) for k in WEAK]
    found = docs.select(id_.alias("_id"), version.alias("_text"), masked.alias("_t")).select(
        "_id", "_text", "_t",
        F.array_sort(F.concat(*[_spans(F.col("_t"), k, *v) for k, v in STRONG.items()])).alias("base"),
        F.concat(*[_spans(F.col("_t"), *w) for w in weak]).alias("weak"),
    )
    scopes = F.when(F.size("weak") > 0, _scope_starts(F.col("_t"))).otherwise(F.array().cast("array<int>"))
    # Texts are searched once; what is found is written, and equal rows are one from here on.
    found = materialise(found.where("size(base) + size(weak) > 0").select("_id", "_text", "base", "weak", scopes.alias("scopes")).dropDuplicates(["_id", "_text"]))
    links = linked_parts(found.where("size(weak) > 0").select("_id", "_text", F.concat("base", "weak").alias("parts"), "scopes"), p)
    spans = found.alias("f").join(links.alias("l"), F.expr("f._id <=> l._id AND f._text = l._text"), "left")
    none = F.array().cast(SPAN)
    spans = materialise(spans.select("f._id", "f._text", "f.base", F.array_sort(F.concat("f.base", F.coalesce("l.links", none))).alias("all_spans")))
    rows = docs.select(packed(docs, own), id_.alias("_id"), version.alias("_text"))
    joined = rows.alias("d").join(spans.alias("s"), F.expr("d._id <=> s._id AND d._text = s._text"), "left")
    return unpacked(joined, own, F.coalesce("s.base", none).alias("base"), F.coalesce("s.all_spans", none).alias("all_spans"))


def _scope_starts(text: Column) -> Column:
    """Where the blocks between blank lines start."""
    pieces = F.split(F.regexp_replace(text, "(\\n[ \\t\\r]*\\n)", "$1\x01"), "\x01", -1)
    return starts(F.transform(pieces, F.length))


def linked_parts(found: DataFrame, p: LinkRules) -> DataFrame:
    """_id, _text, links: the weak spans that have their complement. found: _id, _text, parts, scopes."""
    events = found.select("_id", "_text", F.explode("parts").alias("s")).select("_id", "_text", F.col("s.start").alias("at"), F.lit(None).cast("int").alias("scope"), "s")
    scopes = found.select("_id", "_text", F.explode("scopes").alias("at")).select("_id", "_text", "at", F.col("at").alias("scope"), F.lit(None).cast(SPAN[6:-1]).alias("s"))
    sweep = W.partitionBy("_id", "_text").orderBy("at", F.col("s").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    parts = events.unionByName(scopes).withColumn("scope", F.last("scope", ignorenulls=True).over(sweep)).where("s IS NOT NULL").distinct()
    role = F.get(F.array(*[F.lit(ROLE[k]) for k in KINDS]), F.col("s.kind"))
    parts = parts.select("_id", "_text", "scope", "s", role.alias("role"))
    scope = W.partitionBy("_id", "_text", "scope")
    # Both run forwards over their order: a frame that reaches to the end is gone over again for every row.
    before, after = (scope.orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in (F.asc("s"), F.desc("s")))
    near = []
    for r in ("id", "secret", "endpoint"):
        was = F.max(F.when(F.col("role") == r, F.col("s.end"))).over(before)
        comes = F.last(F.when(F.col("role") == r, F.col("s.start")), ignorenulls=True).over(after)
        near.append((F.coalesce(F.col("s.start") - was <= p.max_gap, F.lit(False)) | F.coalesce(comes - F.col("s.end") <= p.max_gap, F.lit(False))).alias(f"near_{r}"))
    parts = parts.select("*", *near)
    complete = (
        F.when(F.col("role") == "id", F.col("near_secret"))
        .when(F.col("role") == "secret", F.col("near_id") | F.col("near_endpoint"))
        .otherwise(F.col("near_id") & F.col("near_secret"))
    )
    return parts.where(complete & (F.col("s.kind") >= len(STRONG))).groupBy("_id", "_text").agg(F.collect_set("s").alias("links"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch covered by spans replaced by one mark. spans: by start.

    The text is cut into blocks, and what stays is put together from them: no place is counted from the text's start.
    """
    cut = 1024
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{cut}}}"), F.lit(0))
    ends = F.transform(spans, lambda s: s["end"])

    def part(held: Column, a: Column, b: Column) -> Column:
        """From a to before b."""
        first, last = F.floor(a / cut).cast("int"), F.floor((b - 1) / cut).cast("int")
        one = F.get(held, first).substr(a % cut + 1, b - a)
        middle = F.array_join(F.slice(held, first + 2, F.greatest(F.lit(0), last - first - 1)), "")
        more = F.concat(F.get(held, first).substr(a % cut + 1, F.lit(cut)), middle, F.get(held, last).substr(F.lit(1), (b - 1) % cut + 1))
        return F.when(b <= a, "").when(first == last, one).otherwise(more)

    def whole(held: Column) -> Column:
        # A stretch begins where a span starts at or behind the end of all before it.
        upto = running(ends, F.lit(0), lambda a, b: F.greatest(a, b))
        kept = F.zip_with(spans, upto, lambda s, at: F.when(s["start"] >= at, F.concat(part(held, at, s["start"]), F.lit(mark))).otherwise(""))
        rest = bound(F.array_max(ends), lambda end: part(held, end, F.length(text)))
        return F.concat(F.array_join(kept, ""), rest)

    return F.when(F.size(spans) > 0, bound(blocks, whole)).otherwise(text)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *map(count, STRONG), F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("all_spans")).alias("spans"))


def _sql_spans(kind: int, pattern: str, least: int) -> str:
    pattern = pattern.replace("'", "''")
    mark = f"regexp_replace(t, '{pattern}', chr(1) || '\\1' || chr(2) || '\\2' || chr(1), 'g')"
    return f"""SELECT rid, {kind} AS kind, list_sum(list_transform(p[1:i - 1], lambda x: length(x) - contains(x, chr(2))::INTEGER))::BIGINT AS a, length(p[i]) - 1 AS n
      FROM (SELECT rid, p, unnest(range(2, len(p), 2)) AS i FROM (SELECT rid, string_split({mark}, chr(1)) AS p FROM t)) WHERE length(string_split(p[i], chr(2))[-1]) >= {least}"""


def _sql() -> str:
    """The same matches between marks, and the same sweep, in SQL. RE2 lower-cases more than ASCII, so letters in either
    case are written out."""

    def either(pattern: str) -> str:
        out, depth, at = "", 0, 0
        while at < len(pattern):
            if pattern.startswith("(?i:", at):
                out, depth, at = out + "(?:", 1, at + 4
                continue
            c = pattern[at]
            if depth:
                depth += (c == "(") - (c == ")")
            out += f"[{c.upper()}{c}]" if depth and c.isalpha() else c
            at += 1
        return out

    kinds = [STRONG[k] for k in STRONG] + [ENDPOINT if k == "link_endpoint" else WEAK[k] for k in WEAK]
    spans = " UNION ALL ".join(_sql_spans(i, either(pattern), least) for i, (pattern, least) in enumerate(kinds))
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    roles = "[" + ", ".join(f"'{ROLE[k]}'" for k in KINDS) + "]"
    gap = LinkRules().max_gap
    near = ", ".join(
        f"coalesce(a - max(CASE WHEN role = '{r}' THEN e END) OVER before <= {gap}, false) OR coalesce(first(CASE WHEN role = '{r}' THEN a END IGNORE NULLS) OVER after - e <= {gap}, false) AS near_{r}"
        for r in ("id", "secret", "endpoint")
    )
    count = ", ".join(f"count(*) FILTER (WHERE kind = {i})::BIGINT AS n_{k}" for i, k in enumerate(STRONG))
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS t FROM documents),
s AS (SELECT rid, kind, coalesce(a, 0) AS a, coalesce(a, 0) + n AS e FROM ({spans})),
m AS (SELECT *, {roles}[kind + 1] AS role, (SELECT len(regexp_extract_all(substr(t.t, 1, s.a::BIGINT), '\\n[ \\t\\r]*\\n')) FROM t WHERE t.rid = s.rid) AS scope FROM s WHERE rid IN (SELECT rid FROM s WHERE kind > 2)),
w AS (SELECT *, {near} FROM m WINDOW before AS (PARTITION BY rid, scope ORDER BY a, kind, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), after AS (PARTITION BY rid, scope ORDER BY a, kind, e ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
l AS (SELECT rid, kind, a, e FROM w WHERE kind > 2 AND CASE role WHEN 'id' THEN near_secret WHEN 'secret' THEN near_id OR near_endpoint ELSE near_id AND near_secret END),
u AS (SELECT rid, kind, a, e FROM s WHERE kind <= 2 UNION SELECT rid, kind, a, e FROM l),
g AS (SELECT rid, {count}, string_agg(CASE WHEN kind <= 2 THEN {names}[kind + 1] || ':' || a || ':' || e END, ',' ORDER BY a, kind) AS base, string_agg({names}[kind + 1] || ':' || a || ':' || e, ',' ORDER BY a, kind) AS spans FROM u GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (rid)
"""


OP8_SQL = _sql()
