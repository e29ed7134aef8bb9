import hashlib
import random
import time

import pytest
from tests.llm.plain import EDGES, SF, alnum_words, docs_of

from lectern.llm.decontamination import find_contamination, op7_decontamination


def plain(texts, items):
    windows = {}
    for i, t in items:
        w = alnum_words(t)
        k = min(10, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + k]), set()).add(i)
    sizes = {len(w) for w in windows}
    for t in texts:
        w = alnum_words(t)
        hit, found = set(), set()
        for k in sizes:
            for j in range(len(w) - k + 1):
                if ids := windows.get(tuple(w[j : j + k])):
                    found |= ids
                    hit.update(range(j, j + k))
        yield len(w), len(hit), sorted(map(str, found))


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_planted_passages(spark):
    rnd = random.Random(4)
    word = lambda: rnd.choice("abcdefghij") + rnd.choice("klm")
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 3, 5, 9, 9, 10, 11, 15, 40, 40])]
    items += [(20, None), (21, ""), (22, "..."), (9, items[9][1]), (30, "x " * 30), (31, items[10][1])]
    texts = [*EDGES, "x " * 15, "X. x, x " * 8]
    for _ in range(60):
        w = [word() for _ in range(rnd.randrange(5, 120))]
        source = alnum_words(items[rnd.randrange(11)][1])
        a = rnd.randrange(len(source))
        w[rnd.randrange(len(w)) : 0] = source[a : a + rnd.randrange(1, 25)]
        texts.append(" ".join(w).upper())
    got = {r["doc_id"]: r for r in find_contamination(docs_of(spark, texts), bench(spark, items)).collect()}
    for i, (n, hit, found) in enumerate(plain(texts, items)):
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (n, hit, found, hit > 0), texts[i]


@pytest.mark.parametrize("length", [10, 11, 14])
def test_every_shared_span_of_ten_words_is_found(spark, length):
    item = [f"i{i}" for i in range(60)]
    texts = [" ".join([f"d{a}_{i}" for i in range(7)] + item[a : a + length] + ["end"]) for a in range(60 - length + 1)]
    texts += [" ".join(["d"] * 3 + item[a : a + 9] + ["end"]) for a in range(50)]
    got = find_contamination(docs_of(spark, texts), bench(spark, [(1, " ".join(item))])).collect()
    assert sorted(r["n_hit"] for r in got) == [0] * 50 + [length] * (60 - length + 1)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r for r in op7_decontamination(spark, SF).collect()}
    for (i, _), (n, hit, found) in zip(rows, plain([t for _, t in rows], items)):
        digest = hashlib.sha256(",".join(found).encode()).hexdigest()
        assert tuple(got[i])[1:] == (n, hit, len(found), digest, hit > 0)


def test_shape(spark):
    docs = docs_of(spark, [(None, "a b c d e f g h i j"), (None, "a b c d e f g h i j"), (2, None)]).withColumnRenamed("lang", "items").selectExpr("*", "1 AS _id", "2 AS _hash", "3 AS _d_id", "4 AS `a.b`", "5 AS id", "6 AS window")
    one = bench(spark, [(1, "a b c d e f g h i j k")])
    got = find_contamination(docs, one).collect()
    assert sorted(r["n_hit"] for r in got) == [0, 10, 10]
    assert [(r["_id"], r["_hash"], r["_d_id"], r["a.b"], r["id"], r["window"]) for r in got] == [(1, 2, 3, 4, 5, 6)] * 3
    assert find_contamination(docs, one.limit(0)).where("contaminated").count() == 0
    assert find_contamination(docs.limit(0), one).count() == 0


def test_repeated_words_cost_no_more(spark):
    n = 100_000
    began = time.time()
    got = find_contamination(docs_of(spark, ["x " * n, "x y " * n, "a b c d e f g h i j k " * 20_000]), bench(spark, [(1, "x " * 2000), (2, "y x " * 500), (3, "z")])).collect()
    assert time.time() - began < 60
    assert [(r["n_hit"], r["items"]) for r in sorted(got, key=lambda r: r["doc_id"])] == [(n, ["1"]), (2 * n, ["2"]), (0, [])]
