"""Scalar text functions, as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CJK = "[\\u4e00-\\u9fff\\u3040-\\u30ff\\uac00-\\ud7af]"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body asks for it and wherever the optimiser moves it."""
    return F.get(F.transform(F.array(value), body), 0)


def estimate_tokens(c: Column) -> Column:
    """A CJK character is a token, of others four are."""
    cjk = F.regexp_count(c, F.lit(CJK))
    return F.ceil(cjk + (F.length(c) - cjk) / F.lit(4.0)).cast("long")


def split_sentences(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit("[^.。;；!！?？\\n]+[.。;；!！?？]*"), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.btrim(s, F.lit(" \t\r\n"))), lambda s: s != "")


def norm_title(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9\\u4e00-\\u9fff]", "")


def full_width(c: Column) -> Column:
    """Full-width digits and brackets as ordinary ones."""
    return F.translate(c, "０１２３４５６７８９（）［］．", "0123456789()[].")


def slugify(c: Column, default: str = "paper", size: int = 48) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(dashed == "", F.lit(default)).otherwise(F.substring(dashed, 1, size))


def category_name(c: Column) -> Column:
    """A category's name without characters that files can't have; 40 characters at most."""
    clean = F.regexp_replace(F.regexp_replace(c, "[\\\\/:*?\"<>|\\x00-\\x1f]", ""), "\\s+", " ")
    return F.substring(F.regexp_replace(F.trim(clean), "^\\.+", ""), 1, 40)


def title_from_slug(c: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "^\\d{4}-", ""), "-\\d+$", ""), "-", " ")
    words = F.transform(F.split(plain, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10_000)))
    return F.array_join(words, " ")


def clean_query(c: Column) -> Column:
    """White space collapsed, 500 characters, without a list number in front."""
    short = F.substring(F.regexp_replace(F.trim(c), "\\s+", " "), 1, 500)
    return F.trim(F.regexp_replace(short, "^(\\[\\d+\\]|\\(\\d+\\)|\\d+\\.)\\s*", ""))


def keywords(c: Column, most: int = 8) -> Column:
    """Quoted phrases, then Latin words of three letters or more; each once, in order."""
    quoted = F.regexp_extract_all(c, F.lit("[\"“”]([^\"“”]{2,40})[\"“”]"), F.lit(1))
    words = F.regexp_extract_all(c, F.lit("[A-Za-z][A-Za-z0-9-]{2,}"), F.lit(0))
    return F.slice(F.array_distinct(F.concat(F.transform(quoted, lambda q: F.trim(q)), words)), 1, most)


def intent(c: Column, title_hit: Column | None = None) -> Column:
    """exact for a quoted phrase, capitals, a dotted number, a number with a unit, or a title that is named."""
    exact = c.rlike("[\"“”][^\"“”]{2,}[\"“”]") | c.rlike("(?<!\\w)[A-Z]{2,}(?!\\w)") | c.rlike("\\d+(\\.\\d+)+") | c.rlike("(?<!\\w)\\d+[kKmM]?[VAWHz](?!\\w)")
    if title_hit is not None:
        exact = exact | title_hit
    return F.when(exact, F.lit("exact")).otherwise(F.lit("semantic"))


def merged_keywords(first: Column, then: Column, most: int = 8) -> Column:
    """Those that a model gave before those of the rules; each once."""
    return F.slice(F.array_distinct(F.concat(first, then)), 1, most)


#: Words that tell nothing about where a passage stands.
LOCATE_STOP_WORDS = frozenset(
    "the and for are with this that from have has had was were will can could its their than then when what which how why does did not but all any"
    " into over between based using used use via about you your there these those some such may also should would".split()
)


def locate_words(c: Column, size: int = 500, most: int = 24) -> Column:
    """Words by which a passage is looked for: Latin ones of three letters or more, then pairs of CJK characters."""
    probe = F.substring(c, 1, size)
    latin = F.transform(F.regexp_extract_all(probe, F.lit("[A-Za-z][A-Za-z0-9+-]{2,}"), F.lit(0)), F.lower)
    latin = F.filter(latin, lambda w: ~w.isin(sorted(LOCATE_STOP_WORDS)))
    runs = F.regexp_extract_all(probe, F.lit("[\\u4e00-\\u9fff]{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: r.substr(i, F.lit(2)))))
    return F.slice(F.array_distinct(F.concat(latin, pairs)), 1, most)


def file_title(path: Column) -> Column:
    """title (the file's name without its ending) and year (the first 19.. or 20.. in it, else null)."""
    name = F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), "(?<=.)\\.[^.]*$", "")
    return F.struct(name.alias("title"), F.nullif(F.regexp_extract(name, "((?:19|20)\\d{2})", 1), F.lit("")).cast("int").alias("year"))


def search_terms(words: Column) -> Column:
    """Terms of a search: blanks collapsed, two characters at least, eight at most."""
    clean = F.transform(words, lambda k: F.trim(F.regexp_replace(k, "[\"\\s]+", " ")))
    return F.slice(F.filter(clean, lambda k: F.length(k) >= 2), 1, 8)


def category_label(c: Column) -> Column:
    return F.when(c == "inbox", F.lit("unsorted")).otherwise(c)


def relative_time(then: Column, now: Column) -> Column:
    """just now, minutes, hours, yesterday, days, or the date."""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    number = lambda unit: F.floor(s / F.lit(unit)).cast("string")
    return (
        F.when(s < 60, "just now").when(s < 3600, F.concat(number(60), F.lit(" minutes ago"))).when(s < 86400, F.concat(number(3600), F.lit(" hours ago")))
        .when(s < 2 * 86400, "yesterday").when(s < 30 * 86400, F.concat(number(86400), F.lit(" days ago"))).otherwise(F.date_format(then, "yyyy-MM-dd"))
    )


def bigrams(c: Column) -> Column:
    """The distinct pairs of neighbouring characters: those from the first on, and those from the second on. No character is
    counted from the start of a text, so long ones cost no more."""
    pairs = lambda t: F.regexp_extract_all(t, F.lit("(?s).."), F.lit(0))
    return F.coalesce(F.array_distinct(F.concat(pairs(c), pairs(F.substring(c, 2, (1 << 31) - 1)))), F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two columns of bigrams; 0 where one is empty."""
    total = F.size(a) + F.size(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def join_lines(first: Column, second: Column) -> Column:
    """Two lines as one text; a word parted by a hyphen is joined."""
    return F.when(first.rlike("[A-Za-z]-$") & second.rlike("^[a-z]"), F.concat(F.regexp_replace(first, "-$", ""), second)).otherwise(F.concat_ws(" ", first, second))


def selection_text(c: Column) -> Column:
    """Text picked from a page: line ends after a hyphen and between CJK characters go, others become spaces."""
    joined = F.regexp_replace(F.regexp_replace(c, "-\\s*\\n\\s*", "-"), f"(?<={CJK})\\s*\\n\\s*(?={CJK})", "")
    return F.trim(F.regexp_replace(F.regexp_replace(joined, "\\s*\\n\\s*", " "), "[ \\t]+", " "))


def version_newer(a: Column, b: Column) -> Column:
    """Whether dotted version a is above b; missing parts are 0."""
    parts = lambda v: F.transform(F.split(F.regexp_replace(v, "^v", ""), "\\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    pad = lambda p: F.slice(F.concat(p, F.array_repeat(F.lit(0), 6)), 1, 6)
    return pad(parts(a)) > pad(parts(b))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def loose_json(c: Column) -> Column:
    """From the first { to the last }, as text that parses as JSON, else null."""
    piece = F.nullif(F.regexp_extract(c, "(?s)\\{.*\\}", 0), F.lit(""))
    return F.when(F.is_variant_null(F.try_parse_json(piece)).isNotNull(), piece)


@F.pandas_udf(T.StringType())
def ascii_fold(c: pd.Series) -> pd.Series:
    """Without accents; only letters, digits, _ and - of ASCII stay."""
    return c.map(lambda s: None if s is None else fold(s))


def fold(s: str) -> str:
    plain = (x for x in unicodedata.normalize("NFD", s) if not "̀" <= x <= "ͯ")
    return "".join(x for x in plain if x.isascii() and (x.isalnum() or x in "_-"))


@F.pandas_udf(T.StringType())
def norm_text(c: pd.Series) -> pd.Series:
    """Lower case, compatibility forms, without accents; letters and digits of Latin, CJK, kana and hangul."""

    def one(s):
        if s is None:
            return None
        return "".join(x for x in unicodedata.normalize("NFKD", s.lower()) if (x.isascii() and x.isalnum()) or "一" <= x <= "鿿" or "぀" <= x <= "ヿ" or "가" <= x <= "힯" or "ᄀ" <= x <= "ᇿ")

    return c.map(one)
