"""Stupid backoff and Kneser-Ney against plain versions, and how well the latter tells labelled text apart."""

import math
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.plain import EDGES, SF, alnum_words, blank_words, docs_of

from lectern.llm.kneser_ney import layout, perplexities
from lectern.llm.lm_scoring import BackoffRules, op6_lm_scoring, score_documents
from lectern.llm.quality_classifier import KneserNeyRules, Model, Table, _quantiles, _trains, judge_quality, op9_quality_classifier, sampled, sets_cuts, trained, unseen
from lectern.llm.tokens import BETWEEN_BLANKS, Words, words_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_backoff(texts, order, size):
    words = [alnum_words(t) for t in texts]
    one = Counter(w for x in words for w in x)
    code = {w: int(words_of(w).hash[0].astype("int64")) for w in one}
    known = set(sorted(one, key=lambda w: (-one[w], code[w]))[:size])
    words = [[w if w in known else None for w in x] for x in words]

    def grams(x):
        return Counter(tuple(x[i - k + 1 : i + 1]) for k in range(1, order + 1) for i in range(k - 1, len(x)))

    corpus = sum((grams(x) for x in words), Counter())
    total = sum(map(len, words))
    for x in words:
        own, score, back = grams(x), 0.0, 0
        for i in range(len(x)):
            longest = min(order, i + 1)
            for k in range(longest, 0, -1):
                g = tuple(x[i - k + 1 : i + 1])
                c = corpus[g] - own[g]
                if k == 1:
                    score += math.log(max(c, 0.5) / max(total - len(x), 1))
                elif c > 0:
                    score += math.log(c / (corpus[g[:-1]] - own[g[:-1]]))
                    break
                else:
                    score += math.log(0.4)
            back += k < longest
        yield len(x), score, back


@pytest.mark.parametrize("p", [BackoffRules(), BackoffRules(order=3, vocabulary=40, chunk_words=700), BackoffRules(chunk_words=500, shard_grams=900), BackoffRules(spare_bits=None, chunk_words=900)])
def test_backoff(spark, p):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    texts = [t for _, t in rows] + [None, "", "!!!", "solo", rows[0][1]]
    got = {r["doc_id"]: r for r in score_documents(docs_of(spark, texts), p).collect()}
    for i, (n, score, back) in enumerate(plain_backoff(texts, p.order, p.vocabulary)):
        r = got[i]
        assert (r["n_words"], r["n_backoff"]) == (n, back)
        assert r["logprob"] == pytest.approx(score, rel=1e-9)
        assert (r["score"] is None) == (n == 0)


def test_backoff_edges(spark):
    docs = docs_of(spark, [*EDGES, (None, "a b"), (None, "a b")])
    assert score_documents(docs).count() == len(EDGES) + 2
    assert score_documents(docs.limit(0)).count() == 0
    assert op6_lm_scoring(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_backoff_many_equal_rows_and_clashing_columns(spark):
    """Equal rows share a chunk and count for each other; columns of the input don't meet the results'."""
    docs = docs_of(spark, [(1, "one two three")] * 50 + [(2, "one two"), (2, "one two")]).selectExpr("doc_id", "text", "lang AS chunk", "source AS score", "n_chars AS id")
    out = score_documents(docs, BackoffRules(chunk_words=3))
    assert out.columns == ["doc_id", "n_words", "logprob", "n_backoff", "score"]
    got = [(r["doc_id"], r["n_words"], round(r["logprob"], 9)) for r in out.collect()]
    want = [(i, n, round(score, 9)) for (i, (n, score, _)) in zip([1] * 50 + [2, 2], plain_backoff(["one two three"] * 50 + ["one two"] * 2, 3, None))]
    assert sorted(got) == sorted(want)


def test_backoff_rare_words(spark):
    """More different words than any fixed vocabulary: a word that no other document has isn't taken for other rare words."""
    many = " ".join(f"w{i}" for i in range(70_000))
    texts = [many, many, "zzqx zzqy zzqz", "w1 w2 w3 zzqx"]
    p = BackoffRules()
    assert p.order >= 3
    got = {r["doc_id"]: r for r in score_documents(docs_of(spark, texts), p).collect()}
    for i, (n, score, back) in enumerate(plain_backoff(texts, p.order, None)):
        assert (got[i]["n_words"], got[i]["n_backoff"]) == (n, back)
        assert got[i]["logprob"] == pytest.approx(score, rel=1e-9)
    assert got[2]["score"] < math.log(1e-5) < got[0]["score"]


def plain_kneser_ney(train, order):
    """A function from a list of words to their log probabilities."""
    raw = [Counter() for _ in range(order + 1)]
    for x in train:
        for k in range(1, order + 1):
            raw[k].update(tuple(x[i - k + 1 : i + 1]) for i in range(k - 1, len(x)))
    used = [None] * (order + 1)
    used[order] = raw[order]
    for k in range(1, order):
        before = Counter(g[1:] for g in raw[k + 1])
        used[k] = Counter({g: before[g] or 1 for g in raw[k]})
    d = [None] * (order + 1)
    for k in range(1, order + 1):
        t = [0] + [sum(n == i for n in used[k].values()) for i in (1, 2, 3, 4)]
        y = t[1] / (t[1] + 2 * t[2]) if t[1] else 0.5
        d[k] = [0] + [min(max(i - (i + 1) * y * t[i + 1] / t[i], 0.1), i - 0.1) if t[i] else i * 0.5 for i in (1, 2, 3)]
    total, held = defaultdict(float), defaultdict(float)
    for k in range(1, order + 1):
        for g, n in used[k].items():
            total[g[:-1], k] += n
            held[g[:-1], k] += d[k][min(n, 3)]

    def prob(g):
        k = len(g)
        if k == 0:
            return 1 / (len(used[1]) + 1)
        h = g[:-1]
        if not total[h, k]:
            return prob(g[1:])
        n = used[k][g]
        return (n - d[k][min(n, 3)] if n else 0) / total[h, k] + held[h, k] / total[h, k] * prob(g[1:])

    return lambda x: [math.log(prob(tuple(x[max(0, i - order + 1) : i + 1]))) for i in range(len(x))]


def test_kneser_ney(spark):
    texts = ["a b c a b d a b c", "a b c d e", "b c a", "the a b c", "e e e e f", "A b C"]
    p = KneserNeyRules()
    model = Model(*trained(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string"), p), p.order)
    want = plain_kneser_ney([blank_words(t.translate(LOWER)) for t in texts], 3)
    for t in ["a b c", "a b zzz a b d", "f e e e", "q", "the a b d c"]:
        data = np.frombuffer(t.encode(), np.uint8)
        got = model.logprobs(Words(data, np.array([0, len(data)]), BETWEEN_BLANKS))
        assert list(got) == pytest.approx(want(t.split()), rel=1e-5)


def test_probabilities_sum_to_one():
    words = "a b c a b d a b c e".split()
    logp = plain_kneser_ney([words], 3)
    assert sum(math.exp(logp(["a", "b", w])[-1]) for w in [*set(words), "unseen"]) == pytest.approx(1)


def test_labelled_text(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = op9_quality_classifier(spark, sf).join(labels, "doc_id").select("quality", "toxic", "kept", "perplexity").collect()
    good = [r["kept"] for r in got if r["quality"] == 1 and not r["toxic"]]
    bad = [r["kept"] for r in got if r["quality"] == 0]
    assert sum(good) >= 0.98 * len(good)
    assert len(bad) > 30 and sum(bad) <= 0.2 * len(bad)


def test_faults_of_held_out_text(spark):
    """Labelled rows that neither models nor weights nor cuts have looked at."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = op9_quality_classifier(spark, sf).join(labels, "doc_id").where(unseen(F.col("doc_id"), KneserNeyRules())).select("quality", "toxic", "kept").collect()
    clean = [r["kept"] for r in got if r["quality"] == 1 and not r["toxic"]]
    toxic = [r["kept"] for r in got if r["quality"] == 1 and r["toxic"]]
    low = [r["kept"] for r in got if r["quality"] == 0]
    assert min(len(clean), len(toxic), len(low)) > 20
    assert sum(clean) >= 0.98 * len(clean)
    assert sum(toxic) <= 0.2 * len(toxic)
    assert sum(low) <= 0.2 * len(low)


def test_cuts_do_not_depend_on_partitions(spark):
    """However rows lie and whatever else they have, and whether a bound is reached; the parts of held-out rows don't overlap."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    p = KneserNeyRules(cut_docs=5, least_docs=2)
    of = lambda df: sorted(map(tuple, judge_quality(df, labels, p).drop("perplexity").select("doc_id", "kept", "toxic_cut").collect()))
    clash = docs.withColumns({c: F.lit(1) for c in ("kept", "perplexity", "threshold", "_turn", "_lang", "id")})
    assert of(docs) == of(clash.repartition(13))
    keys = spark.range(2000)
    parts = {n: {r[0] for r in keys.where(f(F.col("id"), p)).collect()} for n, f in (("trains", _trains), ("cuts", sets_cuts), ("unseen", unseen))}
    assert sum(map(len, parts.values())) == len(set().union(*parts.values())) == 2000 and all(len(x) > 50 for x in parts.values())


def test_look_ups():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 2, 1000):
        hashes = rnd.integers(0, 1 << 64, n, dtype=np.uint64)
        hashes[: n // 2] >>= np.uint64(40)  # many that begin alike
        hashes = np.unique(hashes)
        values = rnd.random(len(hashes))
        shuffled = rnd.permutation(len(hashes))
        keys = np.concatenate([hashes, rnd.integers(0, 1 << 64, 50, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64)])
        known = dict(zip(hashes.tolist(), values))
        assert Table(hashes[shuffled], values[shuffled]).look(keys, -1.0).tolist() == [known.get(k, -1.0) for k in keys.tolist()]


def test_sample(spark):
    """Bounds hold for each kind; equal rows are one; of documents with ties in the order all columns decide."""
    docs = docs_of(spark, [(i, f"w{i} " * 10) for i in range(300)] + [(7, "again " * 10)] * 50 + [(None, "x"), (8, None), (9, "")]).withColumn("n", F.lit(1)).withColumn("kind", F.lit(2))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(300)] + [(1, 0, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    p = KneserNeyRules(train_docs=40, train_words=200)
    got = sampled(docs, labels, p, "text", "doc_id").collect()
    assert len(got) == len(set(got))
    for kind, ok in (("trusted", lambda i: i % 3 > 0 and i % 5 > 0 and i != 1), ("low", lambda i: i % 3 == 0 or i == 1), ("toxic", lambda i: i % 5 == 0)):
        own = [r for r in got if r["kind"] == kind]
        assert 15 <= len(own) <= 20 and all(ok(r["id"]) for r in own)


def test_classifier_edges(spark):
    docs = docs_of(spark, [*EDGES, (None, "a b"), (None, "a b")])
    labels = spark.createDataFrame([(5, 1, None), (5, 1, 0), (None, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    got = judge_quality(docs, labels).collect()
    assert len(got) == len(EDGES) + 2
    assert all(r["kept"] == (r["n_words"] > 0) for r in got if r["threshold"] is None)
    assert judge_quality(docs, labels.limit(0)).where("kept").count() == sum(bool(blank_words(t)) for t in EDGES) + 2
    assert judge_quality(docs.limit(0), labels).count() == 0


def plain_perplexities(texts, learnt):
    words = [blank_words((t or "").translate(LOWER)) for t in texts]
    logprobs = plain_kneser_ney([words[i] for i in learnt], 3)
    return [math.exp(-sum(logprobs(x)) / len(x)) if x else None for x in words]


def test_all_trusted_text_is_learnt(spark):
    """More documents than any sample had (8000): the model is that of all of them."""
    texts = [f"a{i % 50} b{i % 7} c{i} a{i % 11} b{i % 7}" for i in range(11_000)] + ["a1 b1 new a1", None, " ", "x", *EDGES]
    labels = spark.range(11_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    learnt = [r[0] for r in labels.where(_trains(F.col("doc_id"), KneserNeyRules())).select("doc_id").collect()]
    assert len(learnt) > 8_500
    got = {r["doc_id"]: r["perplexity"] for r in judge_quality(docs_of(spark, texts).repartition(3, "doc_id"), labels).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(plain_perplexities(texts, learnt)):
        assert got[i] == (want if want is None else pytest.approx(want, rel=1e-9))


@pytest.mark.parametrize("dealt", [{}, {"rounds": 3, "turns": 2, "pair_shards": 5, "word_shards": 4, "chunk_bytes": 3_000}, {"bits": 64, "chunk_bytes": 1}])
def test_model_by_exchanges(spark, dealt):
    """Against the plain model, however chunks, shards, rounds and turns are dealt."""
    texts = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("text").limit(40).collect()] + ["the the the the", "q", "a b", "a b", None, ""]
    docs = docs_of(spark, texts).select("text", (F.col("doc_id") % 3 != 1).alias("trains"), F.col("doc_id").alias("id"), "lang", F.lit(True).alias("scored"))
    more = lambda t: {c: np.zeros(len(t)) for c in ("low_ratio", "toxic_ratio")}
    got = {r["id"]: r for r in perplexities(docs, replace(layout(docs, "text"), **dealt), more).collect()}
    for i, want in enumerate(plain_perplexities(texts, [i for i in range(len(texts)) if i % 3 != 1])):
        assert got[i]["n_words"] == len(blank_words(texts[i] or ""))
        assert got[i]["perplexity"] == (want if want is None else pytest.approx(want, rel=1e-9))


def test_whole_and_bounded_models_agree(spark):
    """Where all fits the bounds, the sample is all: equal rows learnt once, the same ratios and cuts."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    docs = docs.unionByName(docs.where("doc_id % 3 = 0")).unionByName(docs.where("doc_id % 5 = 0").withColumn("text", F.lit("another text of that key")))
    of = lambda p: sorted((tuple(r) for r in judge_quality(docs, labels, p).collect()), key=str)
    whole, bounded = of(KneserNeyRules()), of(KneserNeyRules(train_docs=10**6, train_words=10**9, cut_docs=10**6))
    key = lambda r: (r[0], r[2], r[5])
    whole, bounded = sorted(whole, key=key), sorted(bounded, key=key)
    assert [key(r) for r in whole] == [key(r) for r in bounded]
    for a, b in zip(whole, bounded):
        for x, y in zip(a[3:5] + a[6:], b[3:5] + b[6:]):
            assert x == (y if y is None else pytest.approx(y, rel=1e-5))


def test_exact_quantiles(spark):
    df = spark.range(5000).selectExpr("CASE WHEN id % 5 < 3 THEN NULL WHEN id % 7 = 0 THEN 'b' ELSE 'a' END AS lang", "round(randn(3) * 50, 1) AS x", "exp(randn(5)) AS y")
    for q in (0.995, 0.05, 1 - 0.95):
        want = df.groupBy("lang").agg(*[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {c})").alias(c) for c in "xy"], F.count("*").alias("n"))
        assert sorted(map(str, _quantiles(df, "lang", {"x": "x", "y": "y"}, q).collect())) == sorted(map(str, want.collect()))
    assert _quantiles(df.limit(0), "lang", {"x": "x"}, 0.5).count() == 0
