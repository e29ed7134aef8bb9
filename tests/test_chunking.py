"""Chunks of a whole table against a plain version, and hand-made cases."""

import itertools
import math
import re
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from lectern.functions.arrays import divided_at, filled_starts
from lectern.operators import chunking as C
from lectern.sources.tables import papers

SF = "/root/testdata/sf0.001"
CJK = re.compile("[一-鿿぀-ヿ가-힯]")
BLANK = " \t\n\x0b\x0c\r"


def tokens(t):
    n = len(CJK.findall(t))
    return math.ceil(n + (len(t) - n) / 4)


def sentences(t):
    return [s for s in (x.strip(" \t\r\n") for x in re.findall(r"[^.。;；!！?？\n]+[.。;；!！?？]*", t)) if s]


def tail(t, size=C.OVERLAP):
    found = sentences(t[-6 * size :])
    fit = bisect_right(list(itertools.accumulate(tokens(s) for s in reversed(found))), size)
    return " ".join(found[-max(1, fit) :]) or t[-3 * size :]


def filled(sizes, most):
    """Stretches (from, to) by looking ahead in the running sums."""
    upto, out, at = [0, *itertools.accumulate(sizes)], [], 0
    while at < len(sizes):
        end = max(at + 1, bisect_right(upto, upto[at] + most) - 1)
        out.append((at, end))
        at = end
    return out


def divided(t):
    found = sentences(t)
    parts = [[" ".join(found[a:b]), sum(map(tokens, found[a:b]))] for a, b in filled([tokens(s) for s in found], C.TARGET)]
    if len(parts) > 1 and parts[-1][1] < C.LEAST:
        (a, m), (b, n) = parts[-2:]
        parts[-2:] = [[f"{a} {b}", m + n]]
    return [(x, n, found[0] if i else None, tail(parts[i - 1][0]) if i else None) for i, (x, n) in enumerate(parts)]


def packed(pieces):
    runs = [pieces[a:b] for a, b in filled([p[1] for p in pieces], C.TARGET)]
    long = [i for i, r in enumerate(runs) if sum(p[1] for p in r) >= C.LEAST]
    chunks = [sum(runs[a:b], []) for a, b in zip(long, [*long[1:], len(runs)])]
    own = lambda c: "\n".join(x for p in c for x in (p[3], p[2] and f"Topic: {p[2]}", p[0]) if x is not None)
    return [("\n".join(p[0] for p in c), own(c)) for c in chunks]


def plain_chunks(text):
    """A document of one page without marks of structure: paragraphs, or lines where no paragraph is long enough."""
    paragraphs = [" ".join(x.split()) for x in re.split(r"\n[ \t\r\x0b\x0c]*\n", text)]
    paragraphs = [p for p in paragraphs if len(p) > 8]
    if paragraphs:
        groups, last = [], None
        for p in paragraphs:
            long = tokens(p) > C.HARD
            if long or last is not False:
                groups.append([])
            groups[-1] += divided(p) if long else [(p, tokens(p), None, None)]
            last = long
        return [c for g in groups for c in packed(g)]
    lines = [x for x in (x.strip(BLANK) for x in text.split("\n")) if x]
    return packed([p for x in lines for p in (divided(x) if tokens(x) > C.HARD else [(x, tokens(x), None, None)] if tokens(x) >= 8 else [])])


def test_whole_table(spark):
    docs = papers(spark, SF).select(F.col("id").alias("doc_id"), F.lit(1).alias("page"), "text")
    marks = re.compile(r"(?m)^\s*(```|~~~)|^#{1,6}\s|^\s*!\[[^\]]*\]\([^)]*\)\s*$")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {}
    for r in C.chunk_documents(docs).orderBy("doc_id", "ord").collect():
        got.setdefault(r["doc_id"], []).append((r["text"], r["embed_text"]))
    n = 0
    for i, t in texts.items():
        if not marks.search(t):
            want = plain_chunks(t)
            before = [None, *(c[0] for c in want)]
            assert got.get(i, []) == [(c, own if b is None else f"{tail(b)}\n{own}") for (c, own), b in zip(want, before)], i
            n += len(want) > 1
    assert len(texts) == 200 and n > 5


def values(spark, kind, column, *given):
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(given)], f"i int, v {kind}").orderBy("i")
    return [r[0] for r in rows.select(column(F.col("v"))).collect()]


@pytest.mark.parametrize("size", [1, 5, 20, 1000])
def test_tail(spark, size):
    texts = ["One is here. Two is there. Three is a longer one than these. Four.", "", "....", "x" * 900, "你好。再见。" * 30, "a. " * 400]
    assert values(spark, "string", lambda c: C.tail(c, size), *texts) == [tail(t, size) for t in texts]


def test_filled(spark):
    sizes = [[], [5], [3, 3, 3], [10, 1, 1], [4, 4, 4, 12, 1], [1] * 40, [9, 9, 9], [3, 7, 1, 9, 10, 11, 1]]
    got = values(spark, "array<int>", lambda c: divided_at(c, filled_starts(c, 10)), *sizes)
    assert got == [[s[a:b] for a, b in filled(s, 10)] for s in sizes]


P = ("word " * 400).strip()  # 500 tokens


def test_sections(spark):
    page = "\n\n".join(["# 1 One", P, P, P, "Figure 1 shows the thing that is of note here now", P])
    got = C.chunk_documents(spark.createDataFrame([(1, 2, "# 2 Two\n\ntiny text"), (1, 1, page), (2, 1, None), (3, 1, "")], "doc_id long, page int, text string")).orderBy("ord").collect()
    assert [(c["ord"], c["kind"], c["section_no"]) for c in got] == [(0, "caption", "1"), (1, "body", "1"), (2, "body", "1")]
    assert got[2]["embed_text"].endswith(got[2]["text"]) and len(got[2]["embed_text"]) > len(got[2]["text"])


@pytest.mark.parametrize("words", [39, 40, 600, 1024, 1025, 1400, 1401, 2500])
def test_sizes(spark, words):
    """Paragraphs at the edges of the budgets."""
    text = "\n\n".join(["abcd" * 600, " ".join(["abc"] * words)[:-1] + "."])
    got = [r["text"] for r in C.chunk_documents(spark.createDataFrame([(1, 1, text)], "doc_id long, page int, text string")).orderBy("ord").collect()]
    assert got == [c[0] for c in plain_chunks(text)]


def test_long_paragraphs_know_their_topic(spark):
    long = " ".join(f"Sentence number {i} is here to be counted with others." for i in range(400))
    got = C.chunk_documents(spark.createDataFrame([(1, 1, f"{P}\n\n{long}\n\n{P}")], "doc_id long, page int, text string")).orderBy("ord").collect()
    assert len(got) > 4 and all(tokens(r["text"]) <= C.HARD for r in got) and "Topic: Sentence number 0" in got[2]["embed_text"] and "Topic" not in got[1]["embed_text"]
