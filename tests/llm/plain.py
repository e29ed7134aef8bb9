"""Plain versions of what the operators compute, and fixtures that all tests use."""

import re
from collections import Counter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def alnum_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def blank_words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def bag(text, k=5):
    w = alnum_words(text)
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else [])


def similarity(a, b):
    shared = sum((a & b).values())
    return shared / max(1, sum(a.values()) + sum(b.values()) - shared)


def docs_of(spark, texts, **more):
    """A table of documents: one for each text, or for each (id, text)."""
    rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], DOCS)


#: Texts at the edges: null, empty, blank, one word, marks only, beyond the BMP, controls, very long, one huge word.
EDGES = [None, "", " \t\n", "one", "... !!! ###", "naïve 😀 text 漢字", "a\x00b\x01c\x02d", "word " * 30_000, "x" * 200_000, "a\n\n\n\nb", "the same text twice. " * 3, "the same text twice. " * 3]
