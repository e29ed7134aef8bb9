"""Stupid-backoff scores of documents, from counts over the whole corpus, by joins of n-grams.

Documents are dealt to chunks of some hundred thousand words. A chunk gives its distinct n-grams with their numbers; the
corpus counts are the sums by n-gram, in tables partitioned by the n-gram's hash (shards), and each shard answers every
chunk with the counts of the n-grams that it asked about. There each document's score is summed up.

Rows of both exchanges are packed: one holds the n-grams of one chunk that lie in one shard, sorted. The answer needs no
n-grams, as the chunk knows which it sent, in which order. A chunk has an n-gram once, so the most frequent n-gram of the
corpus has as many entries as there are chunks, and no key is hot. Shards and chunks grow in number with the corpus, not
in size; where a corpus is so large that a chunk has few n-grams in each shard, rows hold few, but never number more than
the n-grams sent.

Hashes have some bits more than it takes to number all n-grams of the corpus (a rule; 64 bits at most), so whatever the
size, an n-gram shares its hash, and so its count, with another one with a probability that the rule sets.

A document is scored by the others: its own occurrences are taken off all counts. Every word counts as itself: n-grams of
all orders, single words too, are hashes that go through the same counts and join, and only the number of words of
the corpus goes to the driver. A caller may ask for a vocabulary (the most frequent words); other words are one symbol then.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import table
from lectern.llm.tokens import chunks, mix


@dataclass(frozen=True)
class BackoffRules:
    order: int = 3
    backoff: float = 0.4
    #: None: every word counts as itself. A number: so many of the most frequent words do, and are broadcast.
    vocabulary: int | None = None
    #: About so many words in a chunk, and n-grams in a shard; they bound a task's memory and change no result.
    chunk_words: int = 500_000
    shard_grams: int = 2_000_000
    #: Bits of a hash beyond those that number the n-grams of the corpus, so that one shares its count with another with a
    #: probability under 2 ** -spare_bits; None: hashes of 64 bits, as many as there are.
    spare_bits: int | None = 20


def total_words(docs: DataFrame, text: str) -> int:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(w.hash) for _, _, w in chunks(batch.column("text")))], pa.int64())], names=["n"])

    return int(docs.select(F.col(text).alias("text")).mapInArrow(count, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def vocabulary(docs: DataFrame, size: int, text: str) -> np.ndarray:
    """The hashes of the most frequent words, sorted; size of them at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [w.hash for _, _, w in chunks(batch.column("text"))]
            h, n = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["word", "n"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "word").limit(size).toPandas()
    return np.sort(top["word"].to_numpy(np.int64).view(np.uint64))


class Grams:
    """The n-grams of a chunk's documents, those of each order one after another, and the documents that they stand in."""

    def __init__(self, texts: pa.Array, known_words: np.ndarray | None, order: int, bits: int):
        """bits: of the hashes."""
        words, docs = [], []
        for a, _, w in chunks(texts):
            words.append(w.hash)
            docs.append((w.doc + a).astype(np.int32))
        self.word = np.concatenate(words or [np.zeros(0, np.uint64)])
        self.doc = np.concatenate(docs or [np.zeros(0, np.int32)])
        if known_words is not None:
            self.word = np.where(np.isin(self.word, known_words), self.word, np.uint64(0))
        #: For each order, where its n-grams end.
        self.ends = [self._ends(k) for k in range(1, order + 1)]
        self.key = np.concatenate([self._keys(k) for k in range(1, order + 1)]) >> np.uint64(64 - bits)
        self.owner = np.concatenate([self.doc[at] for at in self.ends])

    def _ends(self, k: int) -> np.ndarray:
        n = max(0, len(self.word) - k + 1)
        return np.flatnonzero(self.doc[:n] == self.doc[k - 1 : k - 1 + n]) + k - 1

    def _keys(self, k: int) -> np.ndarray:
        first = self.ends[k - 1] - k + 1
        key = np.full(len(first), k, np.uint64)
        for j in range(k):
            key *= np.uint64(0xD6E8FEB86659FD93)
            key += self.word[first + j]
        return mix(key)


def shard_of(keys: np.ndarray, bits: int, n_shards: int) -> np.ndarray:
    """Doesn't fall where keys don't. The first 32 bits of a hash deal."""
    top = keys >> np.uint64(bits - 32) if bits > 32 else keys << np.uint64(32 - bits)
    return (top * np.uint64(n_shards)) >> np.uint64(32)


def packed(x: np.ndarray) -> bytes:
    """All first bytes, then all second ones and so on: high bytes are alike, and compress to nothing."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T))


def unpacked(b: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def differences(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def asked(g: Grams, bits: int, n_shards: int) -> dict[str, list]:
    """shard, keys, n: a row for each shard that has n-grams of the chunk."""
    keys, n = np.unique(g.key, return_counts=True)
    shard = shard_of(keys, bits, n_shards)
    begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), shard[1:] != shard[:-1]]))
    end = np.append(begin[1:], len(keys))
    return {
        "shard": [int(shard[a]) for a in begin],
        "keys": [packed(differences(keys[a:b])) for a, b in zip(begin, end)],
        "n": [packed(n[a:b].astype(np.int32)) for a, b in zip(begin, end)],
    }


def answers(keys: list[bytes], n: list[bytes]) -> list[bytes]:
    """For each row asked, how often rows other than it have each of its n-grams."""
    held = [np.cumsum(unpacked(k, np.uint64), dtype=np.uint64) for k in keys]
    own = np.concatenate([unpacked(x, np.int32) for x in n]).astype(np.int64)
    every = np.concatenate(held)
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(every)), bool), every[1:] != every[:-1]]))
    summed = np.add.reduceat(own[order], first) if len(first) else own
    others = np.empty(len(own), np.int64)
    others[order] = np.repeat(summed, np.diff(np.append(first, len(every))))
    others -= own
    return [packed(x) for x in np.split(others, np.cumsum([len(k) for k in held])[:-1])]


def elsewhere(g: Grams, others: np.ndarray) -> np.ndarray:
    """For each n-gram of g, how often documents other than its own have it. others: the counts outside the chunk, for its
    distinct n-grams in order."""
    order = np.argsort(g.key, kind="stable")  # by key and, as documents don't fall within an order, by document
    key, doc = g.key[order], g.owner[order]
    new = np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(key))) + (others if len(others) else 0)
    group = np.cumsum(new) - 1
    new[1:] |= doc[1:] != doc[:-1]
    own = np.diff(np.append(np.flatnonzero(new), len(key)))
    out = np.empty(len(key), np.int64)
    out[order] = count[group] - own[np.cumsum(new) - 1]
    return out


def backoff_scores(g: Grams, n_docs: int, others: np.ndarray, total: int, p: BackoffRules) -> dict[str, np.ndarray]:
    n = len(g.word)
    words = np.bincount(g.doc, minlength=n_docs)
    rest = np.maximum(total - words[g.doc], 1).astype(float) if n else np.zeros(0)
    counts = np.split(elsewhere(g, others), np.cumsum([len(at) for at in g.ends])[:-1])
    below = counts[0]  # counts of the n-gram one shorter, by where it ends
    score = np.log(np.maximum(below, 0.5) / rest)
    used, longest = np.ones(n, np.int8), np.ones(n, np.int8)
    for k in range(2, p.order + 1):
        at = g.ends[k - 1]
        now = np.zeros(n, np.int64)
        now[at] = counts[k - 1]
        seen = at[now[at] > 0]
        longest[at] = k
        score[at] += np.log(p.backoff)  # one step down, unless the longer one is there
        score[seen] = np.log(now[seen] / below[seen - 1])
        used[seen] = k
        below = now
    return {
        "n_words": words, "logprob": np.bincount(g.doc, score, n_docs).astype(float), "n_backoff": np.bincount(g.doc, used < longest, n_docs).astype(np.int64),
    }


def score_documents(docs: DataFrame, p: BackoffRules = BackoffRules(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_words, logprob (sum of the natural logarithms of the words' scores), n_backoff (words whose longest n-gram
    no other document has), score (logprob for each word; null without words) for each row of docs. Other columns of docs
    are left out, whatever their names.

    The context of a word is the words before it in the same document, order - 1 at most. A null text has no words;
    repeated rows are documents like others, and so count for each other. An empty table gives an empty one.

    Documents are dealt by a hash of key and text, so a lost task deals them the same way again. A text is never divided:
    the longest one bounds a task's memory besides p.
    """
    total = total_words(docs, text)
    held = docs.sparkSession.sparkContext.broadcast(None if p.vocabulary is None else vocabulary(docs, p.vocabulary, text))
    n_chunks = max(1, -(-total // p.chunk_words))
    n_shards = max(1, -(-total * p.order // p.shard_grams))
    bits = 64 if p.spare_bits is None else min(64, (total * p.order).bit_length() + p.spare_bits)
    kind = docs.schema[key].dataType.simpleString()
    id_, text_ = F.col(f"`{key}`"), F.col(f"`{text}`")
    dealt = docs.select(id_.alias("id"), text_.alias("text"), F.pmod(F.xxhash64(id_, text_), F.lit(n_chunks)).alias("chunk"))

    def ask(chunk: pa.Table) -> pa.Table:
        rows = asked(Grams(chunk.column("text").combine_chunks(), held.value, p.order, bits), bits, n_shards)
        return pa.table({"shard": pa.array(rows["shard"], pa.int64()), "chunk": pa.array([chunk.column("chunk")[0].as_py()] * len(rows["shard"]), pa.int64()), "keys": pa.array(rows["keys"], pa.binary()), "n": pa.array(rows["n"], pa.binary())})

    def answer(shard: pa.Table) -> pa.Table:
        said = answers(shard.column("keys").to_pylist(), shard.column("n").to_pylist())
        return pa.table({"chunk": shard.column("chunk"), "shard": shard.column("shard"), "others": pa.array(said, pa.binary())})

    def score(chunk: pa.Table, known: pa.Table) -> pa.Table:
        g = Grams(chunk.column("text").combine_chunks(), held.value, p.order, bits)
        said = known.sort_by("shard").column("others").to_pylist()
        others = np.concatenate([unpacked(x, np.int64) for x in said] or [np.zeros(0, np.int64)])
        return pa.table({"id": chunk.column("id"), **{c: pa.array(x) for c, x in backoff_scores(g, len(chunk), others, total, p).items()}})

    # One exchange of the documents serves both passes over the chunks.
    grams = dealt.groupBy("chunk").applyInArrow(ask, "shard bigint, chunk bigint, keys binary, n binary")
    known = grams.groupBy("shard").applyInArrow(answer, "chunk bigint, shard bigint, others binary")
    out = dealt.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(score, f"id {kind}, n_words bigint, logprob double, n_backoff bigint")
    return out.select(F.col("id").alias(key), "n_words", "logprob", "n_backoff", (F.col("logprob") / F.when(F.col("n_words") > 0, F.col("n_words"))).alias("score"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
