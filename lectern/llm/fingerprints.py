"""Improbable-feature digests: what tells two texts alike when they share long stretches of bytes.

Every window of bytes has an entropy. How often each class of entropy occurs is counted over all texts, and a window's rank
is how rare its class is. Of each run of `reach` neighbouring windows the rarest (of equals the first) wins; windows that
win often enough are a text's features; of a short text, whose windows fit into one filter, all are. Their hashes go into a chain of Bloom filters, a bounded number into each. Two
chains are as alike as the bits that their filters share beyond what chance gives, from 0 to 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.llm.common import map_rows, materialise, table
from lectern.llm.tokens import mix


@dataclass(frozen=True)
class DigestRules:
    width: int = 32  # bytes in a window
    reach: int = 64  # neighbouring windows of which one wins; a power of two
    least_wins: int = 16
    filter_bits: int = 2048  # a power of two
    filter_features: int = 160
    hashes: int = 5


#: Entropies are told apart in steps of 1 / CLASSES_A_BIT of c * log2(c), summed over a window's different bytes.
CLASSES_A_BIT = 4
_FIXED = 1 << 20
#: Windows that are looked at together, and bytes of texts.
PIECE, BATCH = 1 << 16, 1 << 20


@cache
def _steps(width: int) -> tuple[np.ndarray, np.ndarray]:
    """c * log2(c) for c from 0 to width as whole numbers, and the differences."""
    c = np.arange(width + 1)
    g = np.rint(c * np.log2(np.maximum(c, 1)) * _FIXED).astype(np.int64)
    return g, np.diff(g)


def n_classes(width: int) -> int:
    return int(_steps(width)[0][width] * CLASSES_A_BIT // _FIXED) + 1


def entropy_classes(data: np.ndarray, width: int) -> np.ndarray:
    """The class of each window of data (uint8), by its first byte: high where few different bytes are in it.

    A step to the next window changes the sum by what the byte that goes and the byte that comes have in common with the
    rest of the window; those counts come from comparing the data with itself at each distance.
    """
    g, steps = _steps(width)
    out = np.empty(max(0, len(data) - width + 1), np.int16)
    for at in range(0, len(out), PIECE):
        part = data[at : at + PIECE + width - 1]
        ahead, behind = np.zeros(len(part), np.uint8), np.zeros(len(part), np.uint8)
        for j in range(1, min(width, len(part))):
            same = (part[:-j] == part[j:]).view(np.uint8)
            ahead[:-j] += same
            behind[j:] += same
        n = len(part) - width + 1
        first = g[np.bincount(part[:width], minlength=256)].sum()
        change = steps[behind[width:]] - steps[ahead[: n - 1]]
        out[at : at + n] = (first + np.concatenate([[0], np.cumsum(change)])) * CLASSES_A_BIT // _FIXED
    return out


class Batch:
    """Some texts as one array of bytes, with gaps between them, so that no run of windows meets two texts."""

    def __init__(self, texts: list[bytes], p: DigestRules):
        gap = b"\0" * max(0, p.reach - p.width)
        self.p = p
        self.data = np.frombuffer(gap.join([b"\0" * (p.reach - 1), *texts, b""]), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.start = p.reach - 1 + len(gap) + np.concatenate([[0], np.cumsum(sizes + len(gap))])[:-1]
        self.size = sizes
        self.windows = np.maximum(sizes - p.width + 1, 0)

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """The class of each window, and whether it lies in one text."""
        found = entropy_classes(self.data, self.p.width)
        edges = np.zeros(len(found) + 1, np.int8)
        some = self.windows > 0
        np.add.at(edges, self.start[some], 1)
        np.add.at(edges, self.start[some] + self.windows[some], -1)
        return found, np.cumsum(edges[:-1]).astype(bool)

    def winners(self, ranks: np.ndarray) -> np.ndarray:
        """Where the windows begin that win often enough, in order."""
        p = self.p
        found, inside = self.classes()
        none = len(ranks)
        rank = np.full(len(found) + p.reach, none, np.int64)
        rank[: len(found)][inside] = ranks[found[inside]]
        places, wins = [], []
        for at in range(0, len(found), PIECE):
            n = min(PIECE, len(found) - at)
            least = rank[at : at + n + p.reach - 1] << 40 | np.arange(at, at + n + p.reach - 1)
            step = 1
            while step < p.reach:
                least = np.minimum(least[:-step], least[step:])
                step *= 2
            least = least[least >> 40 < none] & (1 << 40) - 1
            if len(least):
                first = np.flatnonzero(np.concatenate([[True], np.diff(least) != 0]))
                places.append(least[first])
                wins.append(np.diff(np.append(first, len(least))))
        if not places:
            return np.zeros(0, np.int64)
        at, won = np.concatenate(places), np.concatenate(wins)
        first = np.flatnonzero(np.concatenate([[True], np.diff(at) != 0]))  # a run may go on in the next piece
        at = at[first][np.add.reduceat(won, first) >= p.least_wins]
        short = self.windows <= p.filter_features
        n = self.windows[short]
        every = np.repeat(self.start[short] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.sort(np.concatenate([at[~short[np.searchsorted(self.start, at, "right") - 1]], every]))

    def digests(self, ranks: np.ndarray) -> list[bytes]:
        """Each text's filters, one after the other; a text without bytes has none, one shorter than a window is its only
        feature."""
        p = self.p
        at = self.winners(ranks)
        words = -(-p.width // 8)
        if len(at):
            text = np.searchsorted(self.start, at, "right") - 1
            rows = np.zeros((len(at), words * 8), np.uint8)
            for i in range(0, len(at), PIECE):
                rows[i : i + PIECE, : p.width] = self.data[at[i : i + PIECE, None] + np.arange(p.width)]
        else:
            text, rows = np.zeros(0, np.int64), np.zeros((0, words * 8), np.uint8)
        short = np.flatnonzero((self.size > 0) & (self.windows == 0))
        whole = np.zeros((len(short), words * 8), np.uint8)
        for row, i in zip(whole, short):
            row[: self.size[i]] = self.data[self.start[i] : self.start[i] + self.size[i]]
        text, rows = np.concatenate([text, short]), np.concatenate([rows, whole])
        hashes = np.full(len(rows), 0x9E3779B97F4A7C15, np.uint64)
        for word in rows.view("<u8").T:
            hashes = mix(hashes * np.uint64(0xD6E8FEB86659FD93) ^ word)

        _, first = np.unique(np.stack([text.astype(np.uint64), hashes]), axis=1, return_index=True) if len(rows) else (None, np.zeros(0, np.int64))
        first = first[np.argsort(text[first] * (len(rows) + 1) + first, kind="stable")]  # each text's different features, as they come
        text, hashes = text[first], hashes[first]
        n = np.bincount(text, minlength=len(self.size))
        turn = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        chain = -(-n // p.filter_features)
        at_filter = np.cumsum(chain) - chain
        bits = np.zeros((int(chain.sum()), p.filter_bits), bool)
        width = p.filter_bits.bit_length() - 1
        for i in range(p.hashes):
            bits[at_filter[text] + turn // p.filter_features, (hashes >> np.uint64(i * width) & np.uint64(p.filter_bits - 1)).astype(np.int64)] = True
        packed = np.packbits(bits, axis=1)
        return [packed[a : a + k].tobytes() for a, k in zip(at_filter, chain)]


def alike(a: bytes, b: bytes, filter_bits: int = 2048) -> float:
    """How alike two digests are, 0 to 1: each filter of the shorter chain against the filter of the other that it shares
    most bits with; filters count by their bits. Of chains as long as each other, the mean of both ways. Digests without
    filters are alike only to each other."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(d, np.uint8).reshape(-1, filter_bits // 8).view(np.uint64) for d in (a, b))
    if not len(x) or not len(y):
        return 0.0
    if len(x) == len(y):
        return (_one_way(x, y, filter_bits) + _one_way(y, x, filter_bits)) / 2
    return _one_way(*sorted((x, y), key=len), filter_bits)


def _one_way(x: np.ndarray, y: np.ndarray, filter_bits: int) -> float:
    own, other = (np.bitwise_count(f).sum(1).astype(float) for f in (x, y))
    total = 0.0
    for f, n in zip(x, own):
        shared = np.bitwise_count(f & y).sum(1)
        chance, most = n * other / filter_bits, np.minimum(n, other)
        room = most - chance
        total += n * float(np.where(room > 0, np.clip((shared - chance) / np.where(room > 0, room, 1), 0, 1), shared == np.maximum(n, other)).max())
    return total / float(own.sum())


def _by_size(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """From and to of stretches of texts of some BATCH bytes together; a larger text comes alone."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + BATCH, "right")) - 1)
        yield at, end
        at = end


def _texts(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    column = column.fill_null("").cast(pa.large_binary())
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]) if len(column) else np.zeros(0, np.int64)
    for a, b in _by_size(sizes):
        yield a, b, column.slice(a, b - a).to_pylist()


def rarity(docs: DataFrame, p: DigestRules = DigestRules(), text: str = "text") -> np.ndarray:
    """The rank of each class of entropy, 0 the rarest, from the windows of all texts. Only one count for each class (some
    hundreds) goes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_classes(p.width), np.int64)
        for batch in batches:
            for _, _, texts in _texts(batch.column(0)):
                found, inside = Batch(texts, p).classes()
                total += np.bincount(found[inside], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["class", "n"])

    n = np.zeros(n_classes(p.width), np.int64)
    for r in docs.select(F.col(f"`{text}`")).mapInArrow(count, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        n[r["class"]] = r["n"]
    ranks = np.empty(len(n), np.int64)
    ranks[np.argsort(n, kind="stable")] = np.arange(len(n))
    return ranks


def fingerprints(docs: DataFrame, ranks: np.ndarray, p: DigestRules = DigestRules(), text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the digest of each text (binary). A null text is an empty one, whose digest is empty. Equal texts have
    equal digests. Other columns stay, whatever their names; one named out is replaced. Texts are read whole; some are
    looked at together, in pieces of bounded size, so memory follows the longest text."""

    def work(column: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        for a, b, texts in _texts(column):
            yield a, b, [pa.array(Batch(texts, p).digests(ranks), pa.binary())]

    return map_rows(docs, text, f"`{out}` binary", work)


# ---- Each document beside an edited copy and the next document ------------------------------------------------------

_FOUND = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _beside(own: list[tuple[str, bytes]], after: list[tuple[str, bytes]], ranks: np.ndarray, p: DigestRules) -> list[list]:
    """The columns of _FOUND for documents (text, digest) and those that come after them."""
    edited = [(t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode() for (t, _), (n, _) in zip(own, after)]
    made = [d for a, b in _by_size(np.array([len(e) for e in edited])) for d in Batch(edited[a:b], p).digests(ranks)]
    return [
        [len(t) for t, _ in own], [hashlib.sha256(e).hexdigest() for e in edited], [d for _, d in own], made,
        [alike(d, e, p.filter_bits) for (_, d), e in zip(own, made)], [alike(d, n, p.filter_bits) for (_, d), (_, n) in zip(own, after)],
    ]


def beside_next(docs: DataFrame, ranks: np.ndarray, p: DigestRules = DigestRules()) -> DataFrame:
    """doc_id and the columns of _FOUND: each document (doc_id, text) against the next one in the order of doc_id, and
    against its own text with its last half replaced by what the next begins with. After the last comes the first.

    Documents are put in order once, by ranges, and go through a task one after the other. The last one of a range waits
    for the first of the next range: those two of each range are joined afterwards. Null texts are empty; null doc_ids come
    first; rows with equal doc_id come by a hash of their texts, and equal rows one after the other. One document is its
    own next. No documents, no rows.
    """
    types = _FOUND.replace(" long", " bigint")
    schema = f"part int, end int, doc_id long, text string, {types}"
    names = ["part", "end", "doc_id", "text", *(c.split()[0] for c in _FOUND.split(", "))]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]

    def rows(*columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def ends(end: int, doc: tuple[int, str, bytes]) -> pa.RecordBatch:
        return rows([TaskContext.get().partitionId()], [end], [doc[0]], [doc[1]], [None], [None], [doc[2]], [None], [None], [None])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str, bytes]] = []
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, texts in _texts(batch.column(1)):
                now = list(zip(ids[a:b], [t.decode() for t in texts], Batch(texts, p).digests(ranks)))
                if not held:
                    yield ends(0, now[0])
                line = [*held, *now]
                if len(line) > 1:
                    own, after = [x[1:] for x in line[:-1]], [x[1:] for x in line[1:]]
                    n = len(own)
                    yield rows([0] * n, [None] * n, [x[0] for x in line[:-1]], [None] * n, *_beside(own, after, ranks, p))
                held = line[-1:]
        if held:
            yield ends(1, held[0])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    place = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    found = materialise(ordered.repartitionByRange(*place).sortWithinPartitions(*place).mapInArrow(run, schema))

    first, last = found.where("end = 0"), found.where("end = 1")
    turns = W.orderBy("part")  # a row for each range
    following = first.select("part", F.coalesce(F.lead("part").over(turns), F.min("part").over(W.partitionBy())).alias("next_part"))
    pairs = last.select("part", "doc_id", "text", F.col("fingerprint").alias("digest")).join(following, "part")
    pairs = pairs.join(first.select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_digest")), "next_part")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, text, digest, after, after_digest = (c.to_pylist() for c in batch.slice(i, 1).columns)
                yield rows([0], [None], ids, [None], *_beside([(text[0], digest[0])], [(after[0], after_digest[0])], ranks, p))

    joined = pairs.select("doc_id", "text", "digest", "next_text", "next_digest").mapInArrow(finish, schema)
    return found.where("end IS NULL").unionByName(joined).drop("part", "end", "text")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = beside_next(docs, rarity(docs))
    return found.select("doc_id", "n_chars", "edited_sha256", F.base64("fingerprint").alias("fingerprint"), F.base64("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next")
