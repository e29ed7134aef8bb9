"""Interpolated modified Kneser-Ney of three words, trained on all trusted text, for all documents, by exchanges.

Nothing here is held whole by one task. Documents are cut into chunks where they are read. A chunk asks the shard of each of its
distinct pairs of words (by the pair's hash) about the pair and the words that follow it, and says what its trusted documents
have: how often each word follows, and which words stand before the pair. So a shard has all of a pair's counts at once: how
often its followers were seen, as a history; how many different words stand before it, as an n-gram. The shards of single words
get the same from the shards of pairs, as sums. Both answer with counts; probabilities are worked out where the chunk's texts
meet the answers, once the discounts (from a handful of sums) are known.

Rows of the exchanges are packed as in lm_scoring. Pairs are asked about in rounds, by ranges of their hashes, and texts meet
answers in turns, by the chunks' names, so that what lies on disk at a time is a round's questions or a turn's texts. All pairs
and all texts have their round or turn; words are hashed again in each.

A pair's hash has 20 bits more than number all pairs; a word among those beside a pair has 40 bits, a single word 48.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import materialise
from lectern.llm.lm_scoring import differences, packed, shard_of, unpacked
from lectern.llm.tokens import BETWEEN_BLANKS, chunks, mix

_FACTOR = np.uint64(0xD6E8FEB86659FD93)
_BESIDE, _WORD = 40, 48
_MASK = np.uint64((1 << _BESIDE) - 1)
ROWS = "kind string, part int, dest bigint, src bigint, data array<binary>"
_KINDS = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("dest", pa.int64()), ("src", pa.int64()), ("data", pa.list_(pa.binary()))])


@dataclass(frozen=True)
class Layout:
    """How pairs and words are dealt; no result depends on it, except by the hashes' lengths."""

    rounds: int
    turns: int
    pair_shards: int
    word_shards: int
    bits: int
    chunk_bytes: int


def layout(docs: DataFrame, text: str, rounds: int = 4, turns: int = 2, chunk_bytes: int = 6_000_000, shard_pairs: int = 1_000_000) -> Layout:
    chars = int(docs.agg(F.coalesce(F.sum(F.length(F.col(f"`{text}`"))), F.lit(0))).first()[0])
    words = chars // 6
    return Layout(rounds, turns, max(1, -(-words // (rounds * shard_pairs))), max(1, words // 4_000_000), min(64, (chars // 2).bit_length() + 20), chunk_bytes)


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])]


def rows_of(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _KINDS)], schema=_KINDS)


class Pairs:
    """A round's pairs of words in a chunk: at, where they end; keys, the distinct ones; of, each one's number among these;
    third, where a pair and a follower end; next, the distinct pairs with followers; of_next, each one's number."""

    def __init__(self, c: Chunk, n_round: int, lay: Layout):
        shard = shard_of(c.key, lay.bits, lay.rounds * lay.pair_shards)
        mine = (shard >= n_round * lay.pair_shards) & (shard < (n_round + 1) * lay.pair_shards)
        self.at = c.second[mine]
        self.keys, self.of = np.unique(c.key[mine], return_inverse=True)
        self.number = np.full(len(c.word), -1, np.int64)
        self.number[self.at] = self.of
        self.third = c.third[self.number[c.third - 1] >= 0]
        self.beside = self.number[self.third - 1].astype(np.uint64) << np.uint64(_BESIDE) | c.word[self.third] >> np.uint64(64 - _BESIDE)


class Chunk:
    def __init__(self, texts: pa.Array, trains: np.ndarray | None, bits: int):
        """trains: of each text, whether the model learns it."""
        words, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        for a, _, w in chunks(texts, is_word=BETWEEN_BLANKS):
            words.append(w.hash)
            docs.append((w.doc + a).astype(np.int32))
        self.word, self.doc = np.concatenate(words), np.concatenate(docs)
        self.train = trains[self.doc] if trains is not None else np.zeros(len(self.doc), bool)
        self.second = np.flatnonzero(self.doc[1:] == self.doc[:-1]) + 1
        self.third = np.flatnonzero(self.doc[2:] == self.doc[:-2]) + 2
        key = (self.word[self.second - 1] + np.uint64(2)) * _FACTOR + self.word[self.second]
        self.key = mix(key) >> np.uint64(64 - bits)

    def ask_pairs(self, n_round: int, lay: Layout) -> Iterator[tuple[int, list[bytes]]]:
        """shard, and: the pairs; how many followers each has, those, and how often trusted documents have them; how many
        words stand before it in trusted documents, and those; whether they have the pair, and its words if they do."""
        p = Pairs(self, n_round, lay)
        follow = distinct(p.beside)
        learnt, times = np.unique(p.beside[self.train[p.third]], return_counts=True)
        n = np.zeros(len(follow), np.int32)
        n[np.searchsorted(follow, learnt)] = times
        ends = self.third[self.train[self.third] & (p.number[self.third] >= 0)]
        before = distinct(p.number[ends].astype(np.uint64) << np.uint64(_BESIDE) | self.word[ends - 2] >> np.uint64(64 - _BESIDE))
        seen = np.zeros(len(p.keys), np.uint8)
        seen[p.of[self.train[p.at]]] = 1
        where = np.zeros(len(p.keys), np.int64)
        where[p.of] = p.at
        shard = shard_of(p.keys, lay.bits, lay.rounds * lay.pair_shards)
        begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(shard)), bool), shard[1:] != shard[:-1]]))
        for a, b in zip(begin, np.append(begin[1:], len(shard))):
            edge = np.array([a, b], np.uint64) << np.uint64(_BESIDE)
            (f, g), (x, y) = np.searchsorted(follow, edge), np.searchsorted(before, edge)
            held = lambda s, a=a, b=b: [packed(np.bincount((s >> np.uint64(_BESIDE)).astype(np.int64) - a, minlength=b - a).astype(np.int32)), packed(s & _MASK)]
            at = where[a:b][seen[a:b] > 0]
            codes = [packed(self.word[i] >> np.uint64(64 - _WORD)) for i in (at - 1, at)]
            yield int(shard[a]), [packed(differences(p.keys[a:b])), *held(follow[f:g]), packed(n[f:g]), *held(before[x:y]), packed(seen[a:b]), *codes]

    def ask_words(self, lay: Layout) -> Iterator[tuple[int, list[bytes]]]:
        """shard, and the distinct words and whether trusted documents have them."""
        codes, of = np.unique(self.word >> np.uint64(64 - _WORD), return_inverse=True)
        seen = np.zeros(len(codes), np.uint8)
        seen[of[self.train]] = 1
        for s, a, b in stretches(codes, lay):
            yield s, [packed(differences(codes[a:b])), packed(seen[a:b])]


def stretches(codes: np.ndarray, lay: Layout) -> Iterator[tuple[int, int, int]]:
    shard = shard_of(codes, _WORD, lay.word_shards)
    begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(shard)), bool), shard[1:] != shard[:-1]]))
    for a, b in zip(begin, np.append(begin[1:], len(shard))):
        yield int(shard[a]), int(a), int(b)


def unpack(rows: list[list[bytes]], i: int, kind: type) -> list[np.ndarray]:
    return [unpacked(r[i], kind) for r in rows]


def keys_of(rows: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, the number of each row's keys among them, and where rows end."""
    held = [np.cumsum(k, dtype=np.uint64) for k in unpack(rows, 0, np.uint64)]
    keys, of = np.unique(np.concatenate(held), return_inverse=True)
    return keys, of, np.cumsum([len(k) for k in held])


def by_count(of: np.ndarray, n: np.ndarray, size: int) -> list[np.ndarray]:
    """For each history the sum of its n-grams' counts, and how many have 1, 2, and more."""
    return [np.bincount(of, n, size).astype(np.int64), *(np.bincount(of[x], minlength=size) for x in (n == 1, n == 2, n > 2))]


def tally(n: np.ndarray) -> np.ndarray:
    """How many n-grams have counts of 1, 2, 3 and 4."""
    return np.array([np.count_nonzero(n == i) for i in (1, 2, 3, 4)], np.int64)


def answer_pairs(rows: list[list[bytes]]) -> tuple[list[list[bytes]], tuple[np.ndarray, list[np.ndarray]], np.ndarray]:
    """For each row asked the counts; for single words their codes, how many different words stand before them, and what
    they are as histories; the tallies of pairs and of three words."""
    keys, of, ends = keys_of(rows)
    size = len(keys)

    def joined(i: int) -> tuple[np.ndarray, list[int]]:
        codes = unpack(rows, i + 1, np.uint64)
        owner = np.repeat(of, np.concatenate(unpack(rows, i, np.int32)))
        return owner.astype(np.uint64) << np.uint64(_BESIDE) | np.concatenate(codes), [len(c) for c in codes]

    beside, lengths = joined(1)
    next_, of_next = np.unique(beside, return_inverse=True)
    n3 = np.bincount(of_next, np.concatenate(unpack(rows, 3, np.int32)), len(next_)).astype(np.int64)
    history = by_count((next_ >> np.uint64(_BESIDE)).astype(np.int64), n3, size)
    before = (distinct(joined(4)[0]) >> np.uint64(_BESIDE)).astype(np.int64)
    seen = np.concatenate(unpack(rows, 6, np.uint8)) > 0
    n2 = np.zeros(size, np.int64)
    n2[of[seen]] = 1  # what only ever starts a document has nothing before it; it counts once
    n2 = np.maximum(n2, np.bincount(before, minlength=size))
    per_pair = [np.split(x[of], ends[:-1]) for x in (n2, *history)]
    per_next = np.split(n3[of_next], np.cumsum(lengths)[:-1])
    said = [[*(packed(x[i]) for x in per_pair), packed(per_next[i])] for i in range(len(rows))]
    first, last = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
    first[of[seen]], last[of[seen]] = np.concatenate(unpack(rows, 7, np.uint64)), np.concatenate(unpack(rows, 8, np.uint64))
    learnt = n2 > 0
    codes, at = np.unique(np.concatenate([first[learnt], last[learnt]]), return_inverse=True)
    m = np.count_nonzero(learnt)
    words = [np.bincount(at[m:], minlength=len(codes)), *by_count(at[:m], n2[learnt], len(codes))]
    return said, (codes, words), np.concatenate([tally(n2), tally(n3)])


def answer_words(asked: list[list[bytes]], sums: list[list[bytes]]) -> tuple[list[list[bytes]], np.ndarray]:
    """For each row asked the counts; the tally of words, the sum of their counts, and how many have 1, 2, and more."""
    keys, of, ends = keys_of([*asked, *sums])
    upto = ends[len(asked) - 1] if asked else 0
    total = [np.zeros(len(keys), np.int64) for _ in range(5)]
    for i, t in enumerate(total):
        if sums:
            t += np.bincount(of[upto:], np.concatenate(unpack(sums, i + 1, np.int64)), len(keys)).astype(np.int64)
    if asked:
        seen = of[:upto][np.concatenate(unpack(asked, 1, np.uint8)) > 0]
        total[0][seen] = np.maximum(total[0][seen], 1)
    n1 = total[0]
    said = [[packed(x[o]) for x in total] for o in np.split(of[:upto], ends[: len(asked)][:-1])] if asked else []
    return said, np.concatenate([tally(n1), *by_count(np.zeros(len(n1), np.int64), n1, 1)])


def discounts(t: np.ndarray) -> list[float]:
    """By how much counts of 1, 2 and more are lessened. t: how many n-grams have counts of 1 to 4."""
    t = [0, *(int(x) for x in t)]
    y = t[1] / (t[1] + 2 * t[2]) if t[1] else 0.5
    return [min(max(i - (i + 1) * y * t[i + 1] / t[i], 0.1), i - 0.1) if t[i] else i * 0.5 for i in (1, 2, 3)]


def lessened(n: np.ndarray, total: np.ndarray, d: list[float]) -> np.ndarray:
    return np.where(n > 0, (n - np.array([0.0, *d])[np.minimum(n, 3)]) / np.maximum(total, 1), 0.0)


def rest(history: list[np.ndarray], d: list[float]) -> np.ndarray:
    """The weight of the order below."""
    total, *held = history
    return np.where(total > 0, sum(x * y for x, y in zip(held, d)) / np.maximum(total, 1), 1.0)


def logprobs(c: Chunk, pairs: list[list[list[bytes]]], words: list[list[bytes]], tallies: dict[int, np.ndarray], lay: Layout) -> np.ndarray:
    """Natural logarithm of each word's probability given the two before it. pairs, words: the answers in the order of shards,
    by round those of pairs."""
    d = {k: discounts(t[:4]) for k, t in tallies.items()}
    of_all = [x.reshape(1) for x in tallies[1][4:]]
    _, of = np.unique(c.word >> np.uint64(64 - _WORD), return_inverse=True)
    n1, *as_history = (np.concatenate(unpack(words, i, np.int64))[of] for i in range(5))
    p = lessened(n1, of_all[0], d[1]) + rest(of_all, d[1]) / (of_all[1] + of_all[2] + of_all[3] + 1)
    at = c.second
    n2, n3 = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
    history = [np.zeros(len(p), np.int64) for _ in range(4)]
    for n_round, said in enumerate(pairs):
        q = Pairs(c, n_round, lay)
        if not len(q.at):
            continue
        found = [np.concatenate(unpack(said, i, np.int64)) for i in range(6)]
        n2[q.at] = found[0][q.of]
        for x, y in zip(history, found[1:5]):
            x[q.at] = y[q.of]
        n3[q.third] = found[5][np.unique(q.beside, return_inverse=True)[1]]
    p[at] = lessened(n2[at], as_history[0][at - 1], d[2]) + rest([x[at - 1] for x in as_history], d[2]) * p[at]
    at = c.third
    p[at] = lessened(n3[at], history[0][at - 1], d[3]) + rest([x[at - 1] for x in history], d[3]) * p[at]
    return np.log(p)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What a query exchanged goes from the disks at its end, as nothing reads it again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def pieces(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows, in chunks, each with a name that its place and content give: whoever reads the same rows again, by the same
    partitions, gets the same chunks. Columns: text first."""
    n = 0
    for batch in batches:
        size = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(size):
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + most_bytes, "right")))
            part = batch.slice(a, b - a)
            digest = hashlib.blake2b(f"{TaskContext.get().partitionId()} {n}".encode(), digest_size=8)
            texts = pa.compute.fill_null(part.column(0), "").cast(pa.large_string())
            edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            digest.update(edges - edges[0])
            digest.update(memoryview(texts.buffers()[2] or b"")[edges[0] : edges[-1]])
            yield int.from_bytes(digest.digest(), "little", signed=True), part
            a, n = b, n + 1


def ipc(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_batch(batch)
    return out.getvalue().to_pybytes()


def perplexities(docs: DataFrame, lay: Layout, more) -> DataFrame:
    """id, lang, n_words, perplexity and what more gives for each row of docs (text, trains, id, lang, scored) with scored, under
    the model of the rows with trains. more: from a batch's texts, the names and values of further columns of doubles.

    docs are read several times and have to be dealt to partitions alike each time, as tables that are read from files are.
    So that even a repartition deals them alike, the same columns are read each time.
    """
    docs = docs.select("text", "trains", "id", "lang", "scored")
    spark = docs.sparkSession
    kind = docs.schema["id"].dataType.simpleString()

    def ask(n_round: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for name, part in pieces(batches, lay.chunk_bytes):
                c = Chunk(part.column(0), part.column(1).to_numpy(zero_copy_only=False), lay.bits)
                asked = c.ask_words(lay) if n_round is None else c.ask_pairs(n_round, lay)
                yield from rows_of([("ask", n_round, s, name, data) for s, data in asked]).to_batches()

        return docs.mapInArrow(run, ROWS)

    def pairs(n_round: int):
        def run(shard: pa.Table) -> pa.Table:
            said, (codes, words), counted = answer_pairs(shard.column("data").to_pylist())
            own = shard.column("dest")[0].as_py()
            rows = [("pairs", n_round, to, own, data) for to, data in zip(shard.column("src").to_pylist(), said)]
            rows += [("sums", n_round, s, own, [packed(differences(codes[a:b])), *(packed(x[a:b].astype(np.int64)) for x in words)]) for s, a, b in stretches(codes, lay)]
            return rows_of([*rows, ("tally", n_round, 0, own, [counted.tobytes()])])

        return run

    def single(shard: pa.Table) -> pa.Table:
        rows = shard.to_pylist()
        asked = [r for r in rows if r["kind"] == "ask"]
        said, counted = answer_words([r["data"] for r in asked], [r["data"] for r in rows if r["kind"] == "sums"])
        own = rows[0]["dest"]
        return rows_of([*(("words", None, r["src"], own, data) for r, data in zip(asked, said)), ("tally", None, 0, own, [counted.tobytes()])])

    with shuffles_removed(spark):
        answers = [materialise(ask(r).groupBy("dest").applyInArrow(pairs(r), ROWS)) for r in range(lay.rounds)]
        every = answers[0]
        for x in answers[1:]:
            every = every.unionByName(x)
        words = materialise(ask(None).unionByName(every.where("kind = 'sums'")).groupBy("dest").applyInArrow(single, ROWS))
        every = every.unionByName(words)
        tallies = {1: np.zeros(8, np.int64), 2: np.zeros(4, np.int64), 3: np.zeros(4, np.int64)}
        for r in every.where("kind = 'tally'").select("part", "data").toLocalIterator():
            n = np.frombuffer(r["data"][0], np.int64)
            if r["part"] is None:
                tallies[1] += n
            else:
                tallies[2] += n[:4]
                tallies[3] += n[4:]

        def own(turn: int):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for name, part in pieces(batches, lay.chunk_bytes):
                    if name % lay.turns == turn:
                        yield from rows_of([("own", None, name, 0, [ipc(part)])]).to_batches()

            return run

        def score(rows: pa.Table) -> pa.Table:
            rows = rows.to_pylist()
            held = [r for r in rows if r["kind"] == "own"]
            docs = pa.ipc.open_stream(held[0]["data"][0]).read_all().combine_chunks().to_batches()[0] if held else None
            c = Chunk(docs.column(0), None, lay.bits) if held else None
            if len(held) != 1 or len(c.word) and not any(r["kind"] == "words" for r in rows):
                raise ValueError("the documents weren't dealt to partitions alike each time they were read; write them to a table first")
            n = np.bincount(c.doc, minlength=len(docs))
            log = np.zeros(0)
            if len(c.word):
                rows.sort(key=lambda r: r["src"])
                log = logprobs(c, [[r["data"] for r in rows if r["kind"] == "pairs" and r["part"] == i] for i in range(lay.rounds)], [r["data"] for r in rows if r["kind"] == "words"], tallies, lay)
            mean = np.bincount(c.doc, log, len(docs)) / np.maximum(n, 1)
            cols = {"id": docs.column(2), "lang": docs.column(3), "n_words": pa.array(n), "perplexity": pa.array(np.exp(-mean), mask=n == 0)}
            return pa.table(cols | {k: pa.array(x, mask=n == 0) for k, x in more(docs.column(0)).items()}).filter(docs.column(4))

        out = None
        for turn in range(lay.turns):
            said = every.where("kind IN ('pairs', 'words')").where(F.pmod("dest", F.lit(lay.turns)) == turn)
            rows = docs.mapInArrow(own(turn), ROWS).unionByName(said)
            now = materialise(rows.groupBy("dest").applyInArrow(score, f"id {kind}, lang string, n_words bigint, perplexity double, low_ratio double, toxic_ratio double"))
            out = now if out is None else out.unionByName(now)
        return out
