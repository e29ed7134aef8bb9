import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from tests.llm.plain import EDGES, docs_of

from lectern.llm.fingerprints import BATCH, Batch, DigestRules, alike, beside_next, entropy_classes, fingerprints, n_classes, rarity

P = DigestRules()
M = (1 << 64) - 1


def mixed(x):
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * by & M
    return x ^ x >> 31


def classes(t, p=P):
    fixed = [round(c * math.log2(max(c, 1)) * (1 << 20)) for c in range(p.width + 1)]
    return [sum(fixed[c] for c in Counter(t[i : i + p.width]).values()) * 4 >> 20 for i in range(len(t) - p.width + 1)]


def digest(t, ranks, p=P):
    """One text, window by window."""
    rank = [int(ranks[c]) for c in classes(t, p)]
    if len(rank) <= p.filter_features:
        chosen = range(len(rank))
    else:
        wins = Counter()
        for at in range(-p.reach + 1, len(rank)):
            wins[min(range(max(at, 0), min(at + p.reach, len(rank))), key=lambda i: (rank[i], i))] += 1
        chosen = sorted(i for i, n in wins.items() if n >= p.least_wins)
    features = [t[i : i + p.width] for i in chosen] or ([t] if t else [])
    features = list(dict.fromkeys(f.ljust(p.width, b"\0") for f in features))
    out = b""
    for a in range(0, len(features), p.filter_features):
        bits = bytearray(p.filter_bits // 8)
        for f in features[a : a + p.filter_features]:
            h = 0x9E3779B97F4A7C15
            for j in range(0, p.width, 8):
                h = mixed(h * 0xD6E8FEB86659FD93 & M ^ int.from_bytes(f[j : j + 8], "little"))
            for i in range(p.hashes):
                place = h >> i * (p.filter_bits.bit_length() - 1) & p.filter_bits - 1
                bits[place // 8] |= 128 >> place % 8
        out += bytes(bits)
    return out


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ta", "ri", "mo", "shé", "lu", "k", "n", "ß"]) for _ in range(r.randint(1, 4))) for _ in range(n))


TEXTS = [prose(i, 3 + i * i * 3) for i in range(25)] + [t for t in EDGES if len(t or "") < 1000] + ["ab" * 400, "x" * 31, "x" * 32, "y" * 33, "漢字" * 60]


def test_digests_by_windows():
    r = random.Random(5)
    ranks = np.array(r.sample(range(n_classes(P.width)), n_classes(P.width)))
    texts = [(t or "").encode() for t in TEXTS]
    want = [digest(t, ranks) for t in texts]
    assert Batch(texts, P).digests(ranks) == want
    assert [d for t in texts for d in Batch([t], P).digests(ranks)] == want
    small = DigestRules(width=8, reach=8, least_wins=3, filter_bits=256, filter_features=10, hashes=3)
    assert Batch(texts, small).digests(ranks) == [digest(t, ranks, small) for t in texts]
    assert Batch([], P).digests(ranks) == []


def test_pieces(monkeypatch):
    """What is looked at together doesn't matter."""
    texts, ranks = [prose(i, 900).encode() for i in range(3)], np.arange(n_classes(P.width))
    want = Batch(texts, P).digests(ranks)
    monkeypatch.setattr("lectern.llm.fingerprints.PIECE", 200)
    assert Batch(texts, P).digests(ranks) == want and entropy_classes(np.frombuffer(texts[0], np.uint8), 32).tolist() == classes(texts[0])


def test_likeness():
    ranks = np.arange(n_classes(P.width))
    a, b, c, d = (prose(i, 2000) for i in range(4))
    of = lambda t: Batch([t.encode()], P).digests(ranks)[0]
    assert alike(of(a), of(a)) == 1 and alike(of(a), of(b)) < 0.1 and alike(b"", of(a)) == 0 and alike(b"", b"") == 1
    assert 0.4 < alike(of(a + b), of(a + c)) < 0.6 and alike(of(a), of(c + a + d)) > 0.6
    assert alike(of(a + b), of(d + b)) == alike(of(d + b), of(a + b))


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_beside_next(spark, partitions):
    rows = [(i * 7 % 1000, t) for i, t in enumerate(TEXTS)] + [(3, prose(5, 50)), (3, prose(5, 50)), (None, "first of all, by a null")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, part string, n_chars int")
    ranks = rarity(docs)
    n = Counter(c for _, t in rows for c in classes((t or "").encode()))
    assert [int(x) for x in np.argsort(ranks)] == sorted(range(len(ranks)), key=lambda c: (n[c], c))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = beside_next(docs, ranks).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    line = sorted(((-1 if i is None else i), t or "") for i, t in rows)
    own = [digest(t.encode(), ranks) for _, t in line]
    want = []
    for k, (i, t) in enumerate(line):
        after = line[(k + 1) % len(line)][1]
        e = (t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()
        d = digest(e, ranks)
        want.append((i, len(t), hashlib.sha256(e).hexdigest(), own[k], d, alike(own[k], d), alike(own[k], own[(k + 1) % len(line)])))
    names = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], *(r[c] for c in names)) for r in got) == sorted(want)


def test_table(spark):
    docs = docs_of(spark, [*TEXTS, *EDGES])
    ranks = rarity(docs)
    out = fingerprints(docs.withColumnRenamed("lang", "fingerprint").withColumnRenamed("source", "new0"), ranks)
    assert out.columns == ["doc_id", "text", "new0", "n_chars", "fingerprint"]
    by_text = {}
    for r in out.collect():
        assert by_text.setdefault(r["text"] or "", r["fingerprint"]) == r["fingerprint"] and (r["text"] or r["fingerprint"] == b"")
    none = docs_of(spark, [])
    assert beside_next(none, rarity(none)).count() == 0 and fingerprints(none, ranks).count() == 0
    one = beside_next(docs_of(spark, ["abcdef"]), ranks).collect()
    assert len(one) == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and one[0]["near_next"] == 1


def test_very_long_text():
    t = (prose(1, 400) * 500).encode()
    assert len(t) > BATCH
    d = Batch([t, b"", t], P).digests(np.arange(n_classes(P.width)))
    assert d[0] == d[2] and d[0] and not d[1]
