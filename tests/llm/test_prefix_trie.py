import hashlib
import random
import zlib

import pytest

from lectern.llm.prefix_trie import ROOT, halved, numbered_turns, prefix_names, prefix_trie, rebuilt

TURNS = "conv_id long, turn long, role string, text string"


def sequences(rows):
    """What each conversation is rebuilt to."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    order = lambda x: (x[0], hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).hexdigest())
    own = {c: [x[1:] for x in sorted(v, key=order)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[: h[c]] + own[c][h[c] :] for c in own}


def plain(rows):
    seqs = sequences(rows)
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    out = []
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) if below else 1
        saved[p] = sum(saved[k] for k in below) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(seqs[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, more=lambda df: df, **how):
    turns = numbered_turns(more(spark.createDataFrame(rows, TURNS)))
    got = prefix_trie(*rebuilt(turns))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


def made(seed, n, depth, words=2):
    """Conversations with much in common, of all lengths to depth."""
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant"]), r.choice(["a", "bb", "ccc", "😀"][:words])) for c in r.sample(range(330), n) for t in range(r.randint(1, depth))]


EDGES = [
    (100, None, "user", "null turn"), (100, 2, "user", "x"), (100, 2, "user", "x"), (100, 2, None, "y"), (101, 5, "user", None), (101, None, None, None), (150, 1, "", ""),
    (None, 1, "user", "nobody's"), (-5, 1, "user", "x"), (7, 1, "a", "bc"), (8, 1, "ab", "c"), (207, 1, "a", "bc"), (9000, 1, "z" * 2000, "y" * 50_000), (9100, 1, "z" * 2000, "y" * 50_000),
]


@pytest.mark.parametrize("rows", [EDGES, made(1, 90, 9), made(2, 60, 20, 1), [], [(8, 1, "user", "x")], [(c, 0, "user", "same") for c in range(120)]], ids=["edges", "many", "chain", "empty", "one", "equal"])
def test_nodes(spark, rows):
    assert found(spark, rows) == plain(rows)


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = made(3, 30, 5)
    assert found(spark, rows, lambda df: df.withColumns({c: F.lit(1) for c in ("pos", "token", "size", "n", "seq", "depth", "name")})) == plain(rows)


def test_long_conversations(spark, monkeypatch):
    """Stretches of few turns give the same nodes: names above and below a cut fit together, and numbers over stretches."""
    rows = [*made(4, 12, 70, 1), *((c, t, "user", "same") for c in (100, 101, 200, 201) for t in range(90))]
    want = plain(rows)
    for name, value in (("STRETCH", 4), ("NUMBERED", 8), ("MEMBERS", 16), ("ANCESTORS", 4)):
        monkeypatch.setattr(f"lectern.llm.prefix_trie.{name}", value)
    monkeypatch.setattr(prefix_names, "__defaults__", (4,))
    assert found(spark, rows) == want


def test_names():
    tokens = [bytes([i % 3]) * 32 for i in range(70)]
    every = halved(ROOT, tokens)
    assert len(set(every)) == 70
    assert all(halved(ROOT, tokens[:n]) == every[:n] for n in range(1, 70))
    assert halved(b"x", tokens)[0] != every[0] and halved(ROOT, []) == []
    other = [*tokens[:40], b"y" * 32, *tokens[41:]]
    assert [a == b for a, b in zip(halved(ROOT, other), every)] == [True] * 40 + [False] * 30
