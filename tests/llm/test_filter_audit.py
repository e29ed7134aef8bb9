import re
from collections import Counter
from itertools import permutations
from math import factorial

from tests.llm.plain import EDGES, blank_words, docs_of

from lectern.llm.filter_audit import AuditRules, failing_tables, filter_audit

LABELS = "doc_id long, quality int, toxic int"
SOME = [*EDGES, "Word " * 60, "a b c " * 30, " ".join(f"w{i}" for i in range(60)), "UPPER CASE TEXT", "costs $5 & more", "costs $5 & more"]


def failed(text, is_copy):
    t = text or ""
    w = blank_words(t)
    tests = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": is_copy}
    return {f for f, found in tests.items() if found}


def plain(rows, labels):
    """rows: doc_id, text, source. Every order is walked through, document by document."""
    firsts = {}
    for i, t, _ in rows:
        if i is not None:
            firsts[t or ""] = min(i, firsts.get(t or "", i))
    docs = [(s or "", failed(t, i is not None and i > firsts[t or ""]), any(q == 1 for d, q, _ in labels if d == i and i is not None), any(x == 1 for d, _, x in labels if d == i and i is not None)) for i, t, s in rows]
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                own = [d for d in docs if d[0] == part]
                redundant = sum(f in d[1] and bool(d[1] & set(order[: step - 1])) for d in own)
                out[part, order, step] = [len(left), len(gone), redundant, sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(docs, labels, **more):
    ids, failing = failing_tables(docs)
    rows = filter_audit(ids, failing, labels, **more).collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in rows}
    assert len(found) == len(rows)
    return found


def test_all_orders(spark):
    rows = [(i, t, f"s{i % 2}" if i % 5 else None) for i, t in enumerate(SOME)]
    rows += [(None, "costs $5 & more", "s1"), (3, "another text", "s1"), (3, "another text", "s1"), (12, SOME[12], "s0")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, len(SOME), 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, id int, part string")
    got = audited(docs, spark.createDataFrame([(*x, 7) for x in labels], f"{LABELS}, good int"))
    assert got == plain(rows, labels)
    assert all(got[p, o, s][0] + sum(got[p, o, i][1] for i in range(1, s + 1)) == sum((r[2] or "") == p for r in rows) for p, o, s in got)


def test_one_order_and_few_filters(spark):
    docs, labels = docs_of(spark, SOME), spark.createDataFrame([], LABELS)
    every, one = audited(docs, labels), audited(docs, labels, orders=["EDCBA"])
    assert one == {k: v for k, v in every.items() if k[1] == "EDCBA"} and len(one) == 15
    ids, failing = failing_tables(docs, AuditRules(least_words=2))
    two = filter_audit(ids, {f: failing[f] for f in "AE"}, labels)
    assert {r["filter_order"] for r in two.collect()} == {"AE", "EA"} and two.agg({"shapley": "max"}).first()[0] <= factorial(2) * len(SOME)


def test_empty(spark):
    labels = spark.createDataFrame([], LABELS)
    assert audited(docs_of(spark, []), labels) == {}
    got = audited(docs_of(spark, [" ".join(f"w{i}" for i in range(60))]), labels)
    assert len(got) == 600 and set(got.values()) == {(1, 0, 0, 0, 0, 0, 0)}
