"""Searches against plain versions: null vectors, other widths, ties, no rows, terms that overlap themselves."""

import math
import random

import numpy as np
import pytest

from lectern.operators import numbering, retrieval
from lectern.plans.hybrid import with_context
from lectern.plans.questions import prepared
from lectern.sources.shared import materialise, scratch

R = random.Random(1)
VECTOR = lambda: [R.choice([0.0, 0.5, 1.0, -1.0]) for _ in range(3)]
ROWS = [(i, i % 7 if i % 7 != 6 else 100 + i, VECTOR()) for i in range(300)] + [(1000, 1, None), (1001, 2, [1.0, None, 0.0]), (1002, 3, [1.0, 0.0]), (1003, 3, [])]
ASKED = [(j, VECTOR()) for j in range(20)] + [(50, None), (51, [1.0, 1.0]), (52, [])]


def plain(k, by_paper):
    out = []
    for j, v in ASKED:
        scored = [(-round(float(np.dot(v, w)), 9), i, p) for i, p, w in ROWS if v and w and None not in w and len(w) == len(v)]
        if by_paper:
            best = {}
            for s in sorted(scored):
                best.setdefault(s[2], s)
            scored = sorted(best.values(), key=lambda s: (s[0], s[2]))
        out += [(j, i, p, -s) for s, i, p in sorted(scored, key=lambda s: (s[0], s[2] if by_paper else s[1]))[:k]]
    return sorted(out)


def tables(spark):
    return spark.createDataFrame(ROWS, "id long, paper_id long, vec array<float>"), spark.createDataFrame(ASKED, "query_id long, vec array<float>")


@pytest.mark.parametrize("sizes", [(1 << 20, 1 << 16, 4096, 1024), (50, 4, 7, 3)])
@pytest.mark.parametrize("k", [1, 5, 400])
def test_nearest(spark, monkeypatch, sizes, k):
    for name, value in zip(("CELL_ROWS", "CELL_QUESTIONS", "ROWS_AT_ONCE", "QUESTIONS_AT_ONCE"), sizes):
        monkeypatch.setattr(retrieval, name, value)
    chunks, asked = tables(spark)
    of = lambda df: sorted((r["query_id"], r["id"], r["paper_id"], r["score"]) for r in df.collect())
    assert of(retrieval.nearest(chunks, asked, k)) == plain(k, False)
    assert of(retrieval.nearest_of_group(chunks, asked, k)) == plain(k, True)
    if k == 400:
        assert of(retrieval.nearest_of_group(chunks, asked)) == plain(None, True)


def test_a_null_vector_moves_no_other(spark):
    chunks = spark.createDataFrame([(1, 1, None), (2, 1, [1.0, 0.0]), (3, 1, [0.0, 1.0])], "id long, paper_id long, vec array<float>")
    asked = spark.createDataFrame([(0, None), (9, [0.0, 1.0])], "query_id long, vec array<float>")
    assert [r["id"] for r in retrieval.nearest(chunks, asked, 1).collect()] == [3] == [r["id"] for r in retrieval.nearest_of_group(chunks, asked).collect()]


def test_nothing_asked(spark):
    chunks, asked = tables(spark)
    for a, b in ((chunks, asked.limit(0)), (chunks.limit(0), asked), (chunks.limit(0), asked.limit(0))):
        assert retrieval.nearest(a, b, 3).count() == retrieval.nearest_of_group(a, b).count() == retrieval.nearest_of_group(a, b, 2).count() == 0
        texts, terms = a.selectExpr("id", "'text' AS text"), b.selectExpr("query_id", "array('te') AS terms")
        assert retrieval.text_search(texts, terms, 3).count() == 0


def test_plan_does_not_grow(spark):
    """As many jobs' branches for many cells of questions as for one."""
    chunks, asked = tables(spark)
    size = lambda: retrieval.nearest(chunks, asked, 2)._jdf.queryExecution().optimizedPlan().toString().count("\n")
    few = size()
    retrieval.CELL_QUESTIONS, held = 2, retrieval.CELL_QUESTIONS
    try:
        assert size() == few
    finally:
        retrieval.CELL_QUESTIONS = held


@pytest.mark.parametrize("sizes", [(1 << 16, 1 << 20), (3, 2)])
def test_text_search(spark, monkeypatch, sizes):
    """Terms that overlap themselves are counted at every place."""
    monkeypatch.setattr(retrieval, "BLOCK", sizes[0])
    monkeypatch.setattr(retrieval, "MOST_HELD", sizes[1])
    r = random.Random(2)
    texts = [(i, "".join(r.choice("ab n") for _ in range(r.randrange(40)))) for i in range(60)] + [(90, None), (91, "ANANANA"), (92, "banana banana")]
    asked = [(0, ["ana"]), (1, ["aaa", "ana", "ana", "ab"]), (2, ["nan", "ban"]), (3, []), (4, None), (5, ["zzz"]), (6, ["aba", None])]
    got = sorted((x["query_id"], x["id"], x["score"]) for x in retrieval.text_search(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(asked, "query_id long, terms array<string>"), 9).collect())
    low = [(i, (t or "").lower()) for i, t in texts]
    mean, want = sum(max(len(t) - 2, 0) for _, t in low) / len(low), []
    for q, terms in asked:
        scores = {}
        for t in dict.fromkeys(t for t in terms or [] if t and len(t) >= 3):
            tf = {i: sum(x.startswith(t, p) for p in range(len(x))) for i, x in low}
            df = sum(n > 0 for n in tf.values())
            idf = max(math.log((len(low) - df + 0.5) / (df + 0.5)), 0) or 1e-6
            for i, x in low:
                if tf[i]:
                    scores[i] = scores.get(i, 0) + idf * tf[i] * 2.2 / (tf[i] + 1.2 * (0.25 + 0.75 * max(len(x) - 2, 0) / mean))
        want += [(q, i, round(s, 9)) for i, s in sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:9]]
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want)] and np.allclose([x[2] for x in got], [x[2] for x in sorted(want)])


def test_numbers(spark, monkeypatch):
    monkeypatch.setattr(numbering, "STRETCHES", 5)
    rows = [("hot" if i % 3 else None if i % 2 else f"k{i % 50}", i * 7919 % 1000) for i in range(900)] + [("hot", None), ("hot", None)]
    df = spark.createDataFrame(rows, "key string, ord long")
    got = {}
    for r in numbering.numbered(df, "key", "ord").collect():
        got.setdefault(r["key"], []).append((r["_k"], -1 if r["ord"] is None else r["ord"]))
    for key, found in got.items():
        orders = sorted(-1 if o is None else o for k, o in rows if k == key)
        assert sorted(found) == list(enumerate(orders, 1))
    names = spark.createDataFrame([(f"s{i % 2}", f"p{i:03d}") for i in range(40)], "key string, ord string")
    assert {(r["key"], r["_k"]) for r in numbering.numbered(names, "key", "ord").collect()} == {(f"s{i}", k) for i in (0, 1) for k in range(1, 21)}
    assert numbering.numbered(df.limit(0), "key", "ord").count() == 0


def test_scratch(spark, tmp_path):
    import os

    with scratch(spark):
        df = materialise(spark.range(5))
        folder = df.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
        assert df.count() == 5 and os.path.isdir(folder)
    assert not os.path.exists(folder)


def test_rerank_by_question(spark):
    ranked = spark.createDataFrame([(q, i, i) for q in (1, 2) for i in range(5)], "query_id long, id long, pos long")
    model = lambda rows: rows.withColumn("model_score", (rows["id"] * (3 - 2 * rows["query_id"])).cast("double"))
    got = {}
    for r in retrieval.rerank(ranked, model, 3, ["query_id"]).orderBy("query_id", "pos").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == {1: [2, 1, 0, 3, 4], 2: [0, 1, 2, 3, 4]}
    assert retrieval.rerank(ranked, None) is ranked


def test_prepared_questions(spark):
    asked = [(1, 'What is "gate drive" of the IGBT?'), (2, "x"), (3, None), (4, "how is it?"), (5, "plain question"), (6, "broken"), (7, "???")]
    replies = [(1, '{"query": "", "intent": "maybe", "keywords": ["gate drive", 5, "a", "insulated gate"]}'), (4, 'Well: {"query": "how is the load?", "intent": "exact", "keywords": ["load", "load"]}'), (5, '{"keywords": null}'), (6, '{"query": "q"'), (2, '{"query": "never"}')]
    got = {r["query_id"]: tuple(r)[1:] for r in prepared(spark.createDataFrame(asked, "query_id long, q string"), spark.createDataFrame(replies, "query_id long, reply string"), spark.createDataFrame([(5,), (5,)], "query_id long")).collect()}
    assert got[1][0] == asked[0][1] and got[1][3] == "exact" and got[1][1][0] == "gate drive" and "insulated gate" in got[1][1] and "IGBT" in got[1][1]
    assert got[2] == ("x", [], "x", "semantic") and got[3] == ("", [], "", "semantic") and got[7] == ("???", [], "???", "semantic")
    assert got[4] == ("how is the load?", ["load", "how"], "load OR how", "exact")
    assert got[5] == ("plain question", ["plain", "question"], "plain OR question", "exact") and got[6] == ("broken", ["broken"], "broken", "semantic")
    assert prepared(spark.createDataFrame([], "query_id long, q string")).count() == 0


def test_context_of_hits(spark):
    texts = spark.createDataFrame([(i, i // 4, "a" if i % 4 < 3 else "b", i, f"t{i}") for i in range(8)], "id long, paper_id long, section string, ord long, text string")
    hits = spark.createDataFrame([(1, 1), (1, 3), (2, 6), (2, 99)], "query_id long, id long")
    got = {(r["query_id"], r["id"]): r["context"] for r in with_context(hits, texts).collect()}
    assert got == {(1, 1): "t0\nt1\nt2", (1, 3): "t3", (2, 6): "t5\nt6", (2, 99): None}


def test_many_questions_of_texts(spark):
    """Whatever a task has kept so far, equal scores and questions of many terms or none: as bm25() gives it for each."""
    words = ["alpha", "beta", "gamma", "delta", "alphabet", "eps", "ta "]
    rows = [(i, " ".join(words[(i * (j + 3)) % 7] for j in range(i % 9))) for i in range(300)]
    texts = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    asked = [(q, [words[q % 7], words[(q * q) % 7], "ALPHA"][: q % 4]) for q in range(12)]
    got = {}
    for r in retrieval.text_search(texts, spark.createDataFrame(asked, "query_id long, terms array<string>"), 5).collect():
        got.setdefault(r.query_id, []).append((r.pos, r.id, r.score))
    for q, terms in asked:
        scored = retrieval.bm25(texts, ["text"], terms, "id").collect() if terms else []
        want = sorted(((-r.score, r.id) for r in scored))[:5]
        assert [(i, x[1], -x[0]) for i, x in enumerate(want)] == sorted(got.get(q, []))


def test_room_for_twice_what_stays():
    """65536 questions keep 50 each, 3.3 million scores: with room for a million, each further row had them all put in order."""
    assert all(retrieval.most_held(50, n) >= 100 * n for n in (1, 20_000, retrieval.BLOCK))
