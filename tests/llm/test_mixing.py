import hashlib
import math
from collections import Counter, defaultdict

import pytest
from tests.llm.plain import EDGES, SF, blank_words, docs_of

from lectern.llm.mixing import MixRules, exponent, mix_sources, op10_mixing


def entropy(t, a):
    w = [x**a for x in t]
    w = [x / sum(w) for x in w]
    return -sum(x * math.log(x) for x in w), max(x * sum(t) / y for x, y in zip(w, t))


@pytest.mark.parametrize("tokens, target, limit", [([1000, 10, 10], 0.9, 100), ([1000, 10, 10], 0.9, 4), ([5, 5], 0.99, 2), ([100, 50, 1], 1.0, 1e9), ([7], 0.9, 4)])
def test_exponent(spark, tokens, target, limit):
    sources = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(tokens)], "source string, tokens long")
    a = exponent(sources, sum(tokens), len(tokens), MixRules(target_entropy=target, max_repeats=limit))
    h, m = entropy(tokens, a)
    goal = target * math.log(len(tokens))
    assert m <= limit * (1 + 1e-6)
    if h < goal - 1e-6:  # the limit on repeats came first
        assert entropy(tokens, a - 1e-5)[1] > limit
    elif a < 1:
        assert entropy(tokens, a + 1e-5)[0] < goal + 1e-9


def plain(rows, p, alpha):
    """The uses of each document, by the rules of the module."""
    n = {i: len(blank_words(t)) for i, _, t in rows}
    rows = [(i, s) for i, s, _ in rows if n[i]]
    tokens = Counter()
    for i, s in rows:
        tokens[s] += n[i]
    total = sum(tokens.values())
    z = sum((t / total) ** alpha for t in tokens.values())
    md5 = lambda *x: hashlib.md5(":".join([str(p.seed), *map(str, x)]).encode()).hexdigest()
    out = []
    for s, t in tokens.items():
        quota = math.floor((t / total) ** alpha / z * (p.budget or total) + 1e-6)
        blocks = -(-t // p.block_tokens)
        for epoch in range(quota // t + 1):
            room = t if epoch < quota // t else quota % t
            of = defaultdict(list)
            for i, x in rows:
                if x == s:
                    of[int(md5("b", i)[:8], 16) % blocks].append(i)
            used = 0
            for rank, b in enumerate(sorted(of, key=lambda b: (md5("o", epoch, b, s or ""), b)), 1):
                upto = used
                for place, i in enumerate(sorted(of[b], key=lambda i: md5("d", epoch, i)), 1):
                    upto += n[i]
                    if upto <= room:
                        out.append((i, s, epoch, b, rank, place))
                used = upto
    return sorted(out)


@pytest.mark.parametrize("p", [MixRules(), MixRules(block_tokens=800, target_entropy=0.999), MixRules(budget=3000, block_tokens=500), MixRules(budget=200_000, block_tokens=900, max_repeats=6)])
def test_uses(spark, p):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text").collect()]
    rows = [(i, ["big", "big", "mid", "small"][int(s[3:]) % 4] if i % 7 else "tiny", t) for i, s, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sizes = Counter()
    for i, s, t in rows:
        sizes[s] += len(blank_words(t))
    alpha = exponent(spark.createDataFrame(list(sizes.items()), "source string, tokens long"), sum(sizes.values()), len(sizes), p)
    got = sorted((r["doc_id"], r["source"], r["epoch"], r["block"], r["block_rank"], r["rank"]) for r in mix_sources(docs, p).collect())
    assert got == plain(rows, p, alpha)
    used = Counter()
    for r in mix_sources(docs, p).collect():
        used[r["source"]] += r["n_tokens"]
    assert sum(used.values()) <= (p.budget or sum(sizes.values()))


def test_edges(spark):
    docs = docs_of(spark, [*EDGES, (None, "a b"), (None, "a b")]).drop("source").selectExpr("*", "if(doc_id = 3, null, 's') AS source", "1 AS rank")
    got = mix_sources(docs).collect()
    assert all(r["n_tokens"] > 0 for r in got)
    assert mix_sources(docs.limit(0)).count() == 0
    assert mix_sources(docs.where("text = ''")).count() == 0
    assert op10_mixing(spark, SF).count() > 0
