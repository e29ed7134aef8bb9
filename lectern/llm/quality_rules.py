"""Line-first quality rules, with DataFrame functions only.

Every line is judged by itself (unfinished sentences, navigation, symbols, shouting, boilerplate); lines that fail are
taken out, and a document that loses too large a part of its text this way is rejected. Nothing is shuffled: each
document is judged within its row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import BLANKS, others, packed, table, unpacked, word_array

#: A sentence ends somewhere in the line.
FINISHED = "[.!?…。！？][\"'”»)\\]]*([ \\t\\x0b\\f\\r]|$)"
#: Phrases of lines that stand on pages of any content, in the languages of the tables; a caller gives others.
BOILERPLATE = {
    "en": ["cookie", "privacy policy", "terms of use", "terms of service", "all rights reserved", "licensed under", "general public license", "copyright (c)", "subscribe to our", "sign up for", "log in to", "enable javascript", "lorem ipsum"],
    "de": ["alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "impressum", "abonnieren sie", "newsletter bestellen", "melden sie sich an", "lizenziert unter", "javascript aktivieren"],
    "fr": ["tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "mentions légales", "abonnez-vous", "inscrivez-vous", "connectez-vous", "sous licence", "activer javascript"],
    "es": ["todos los derechos reservados", "política de privacidad", "condiciones de uso", "aviso legal", "suscríbete", "regístrate", "inicia sesión", "bajo licencia", "activar javascript"],
}
SEPARATORS = "|»›•·"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class QualityRules:
    """Parameters. Shares are per word of the line, or per character of the document."""

    separator_share: float = 0.33
    symbol_share: float = 0.25
    shout_share: float = 0.25
    #: A longer line is text even where it has such a phrase.
    boilerplate_max_words: int = 40
    #: In small letters.
    boilerplate: tuple[str, ...] = tuple(phrase for own in BOILERPLATE.values() for phrase in own)
    max_lost_share: float = 0.5


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _pattern(phrases: tuple[str, ...]) -> str:
    """Any of the phrases; none of them if there are none."""
    return "|".join(re.sub(r"([^\w\s'-])", r"\\\1", x) for x in phrases) or "[^\\x{0}-\\x{10ffff}]"


def line_fault(line: Column, p: QualityRules) -> Column:
    """The first rule that a line fails, or null."""
    words = F.regexp_count(line, F.lit("[^ \\t-\\r]+"))
    return (
        F.when(_count(line, SEPARATORS) > words * p.separator_share, F.lit("navigation"))
        .when(_count(line, SYMBOLS) > words * p.symbol_share, F.lit("symbols"))
        .when(F.regexp_count(line, F.lit("!!")) > words * p.shout_share, F.lit("shouting"))
        .when((words <= p.boilerplate_max_words) & F.lower(line).rlike(_pattern(p.boilerplate)), F.lit("boilerplate"))
        .when(~line.rlike(FINISHED), F.lit("unfinished"))
    )


def repeat_word_count(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds out: the words that stand in some 3-word window found twice or more in the array column `words`.

    Windows are compared by 64-bit hashes, sorted within the row. Few repeated windows are looked up in their short
    list; where there are many, a sort of (hash, position) finds them, so time stays within n log n for any text.
    """
    few = 64
    keep = [F.col(c) for c in df.columns]
    at = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    get = lambda c, i: F.get(F.col(c), i)
    df = df.select(*keep, F.transform(at, lambda i: F.xxhash64(get(words, i), get(words, i + 1), get(words, i + 2))).alias("_g"))
    df = df.select("*", F.sort_array("_g").alias("_gs"))
    df = df.select(*keep, "_g", F.array_distinct(F.filter("_gs", lambda x, i: x == get("_gs", i - 1))).alias("_dups"))
    paired = F.array_sort(F.transform("_g", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.select("*", F.when(F.size("_dups") > few, paired).alias("_zs"))
    same = lambda z, j: z["h"] == get("_zs", j)["h"]
    listed = F.filter(F.transform("_g", lambda x, i: F.when(F.array_contains("_dups", x), i)), lambda i: i.isNotNull())
    sorted_ = F.sort_array(F.transform(F.filter("_zs", lambda z, j: F.coalesce(same(z, j - 1), F.lit(False)) | F.coalesce(same(z, j + 1), F.lit(False))), lambda z: z["i"]))
    df = df.select(*keep, F.when(F.size("_dups") == 0, F.array().cast("array<int>")).when(F.size("_dups") <= few, listed).otherwise(sorted_).alias("_pos"))
    reach = F.transform("_pos", lambda p, j: F.least(F.lit(3), F.coalesce(get("_pos", j + 1) - p, F.lit(3))))
    return df.select(*keep, F.aggregate(reach, F.lit(0), lambda a, x: a + x).cast("long").alias(out))


def quality_rules(docs: DataFrame, p: QualityRules = QualityRules(), text: str = "text") -> DataFrame:
    """One row out for each row in, with all its columns and: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, total_chars, lost_chars, line_faults (rule of each failing line), cleaned_text, kept.

    A null, empty or blank text has no words, so base_failed is true and kept false; its cleaned_text is empty. Columns
    of the input with the name of a result are replaced. Repeated rows are judged each by itself. A text is judged within its
    row, whole, in time n log n of its words, so the longest bounds a task's memory. Of rules that a line fails the first
    counts. No documents, no rows.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "total_chars", "lost_chars", "line_faults", "cleaned_text", "kept"]
    df = docs.select(packed(docs, others(docs, *new)), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    df = df.select("*", word_array(F.col("_t")).alias("_w"))
    df = df.select(
        "_row", "_t", "_w", F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", BLANKS, "")).cast("long").alias("word_chars"),
        _count(F.col("_t"), SYMBOLS).cast("long").alias("n_symbols"),
        F.filter(F.split("_t", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("_lines"),
    )
    df = repeat_word_count(df, "_w", "n_repeat_words").drop("_w", "_t")
    df = df.select("*", F.transform("_lines", lambda x: F.struct(x.alias("line"), line_fault(x, p).alias("fault"))).alias("_judged"))
    chars = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x["line"]))
    df = df.select(
        "_row", "n_words", "word_chars", "n_symbols", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        chars(F.col("_judged")).alias("total_chars"), chars(F.filter("_judged", lambda x: x["fault"].isNotNull())).alias("lost_chars"),
        F.transform(F.filter("_judged", lambda x: x["fault"].isNotNull()), lambda x: x["fault"]).alias("line_faults"),
        F.array_join(F.transform(F.filter("_judged", lambda x: x["fault"].isNull()), lambda x: x["line"]), "\n").alias("cleaned_text"),
    )
    kept = ~F.col("base_failed") & (F.col("lost_chars") <= F.col("total_chars") * p.max_lost_share)
    # The results of a row come out of an array of one element, as a filter on them must not be moved below: it would
    # compute them again.
    df = df.select("_row", F.explode_outer(F.array(F.struct(*[F.col(c) for c in new[:-1]], kept.alias("kept")))).alias("_new"))
    return unpacked(df, others(docs, *new), *[F.col(f"_new.{c}") for c in new])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "kept")


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
b AS (
  SELECT rid, doc_id, t, w, len(w)::BIGINT AS n_words,
    list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS wc,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM w),
g AS (SELECT rid, n_words, unnest(range(1, n_words - 1)) AS i, w FROM b WHERE n_words >= 3),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM g),
r AS (SELECT rid, count(DISTINCT p)::BIGINT AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM h WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, unnest(lines) AS x FROM b),
f AS (SELECT rid, length(x)::BIGINT AS c, len(regexp_extract_all(x, '[^ \t-\r]+')) AS n,
    length(x) - length(translate(x, '|»›•·', '')) AS sep, length(x) - length(translate(x, '#*$%&|<>', '')) AS sym,
    len(regexp_extract_all(x, '!!')) AS sh, x FROM l),
s AS (SELECT rid, sum(c)::BIGINT AS total, coalesce(sum(c) FILTER (WHERE sep > n * 0.33::DOUBLE OR sym > n * 0.25::DOUBLE OR sh > n * 0.25::DOUBLE
    OR (n <= 40 AND regexp_matches(lower(x), '@phrases@'))
    OR NOT regexp_matches(x, '[.!?…。！？]["''”»)\]]*([ \t\x0b\f\r]|$)')), 0)::BIGINT AS lost FROM f GROUP BY rid),
o AS (SELECT b.doc_id, b.n_words, coalesce(b.wc, 0)::BIGINT AS word_chars, b.n_symbols,
    (len(b.lines) - len(list_distinct(b.lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    coalesce(s.lost, 0)::BIGINT AS lost_chars, coalesce(s.total, 0) AS total
  FROM b LEFT JOIN r USING (rid) LEFT JOIN s USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, lost_chars,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_chars <= total * 0.5::DOUBLE AS kept
FROM o
""".replace("@phrases@", _pattern(QualityRules().boilerplate).replace("'", "''"))
