"""Signatures of weighted sets whose components agree with the weighted Jaccard similarity as probability.

Every element has a Poisson process over (0, weight] x components. Weights are whole multiplicities; their axis is cut
into blocks (0, 1], (1, 2], (2, 4], (4, 8], ..., each with a process of its own that depends only on the element and the
block. An element runs the blocks that its weight reaches into; a point in the part of its last block that lies above
the weight is passed over. A component's value is the time of the earliest point that falls on it, over all elements.
Points come in order of time, so an element stops as soon as it is later than all components of its document: most
elements of a long document stop after one or two points.
"""

from __future__ import annotations

import numpy as np

from lectern.llm.tokens import Words, mix


def shingle_bags(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and multiplicity of each distinct shingle of k words, by text, then hash.

    A text of fewer words, but not none, has one shingle of all its words.
    """
    grams, inside = w.grams(k)
    at = np.flatnonzero(inside)
    doc, h = w.doc[at], grams[at]
    n = w.counts()
    for m in set(n[(n > 0) & (n < k)].tolist()):
        short = np.flatnonzero(n == m)
        doc, h = np.concatenate([doc, short]), np.concatenate([h, w.grams(m)[0][w.first[short]]])
    return counted(doc, h)


def counted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(doc)))


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1] from 64 bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """n_docs x m arrival times; infinite throughout for a document without elements."""
    best = np.full((n_docs, m), np.inf)
    last = np.full(n_docs, np.inf)
    # Blocks: number 0 is (0, 1], number j is (2 ** (j - 1), 2 ** j].
    blocks = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64), 0)
    of = np.repeat(np.arange(len(h)), blocks + 1)
    number = np.arange(len(of)) - np.repeat(np.cumsum(blocks + 1) - blocks - 1, blocks + 1)
    low = np.where(number > 0, 1 << np.maximum(number - 1, 0), 0)
    width = np.maximum(low, 1)
    seed = mix(h[of] + number.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    d, room, rate = doc[of], weight[of] - low, width * float(m)
    time = np.zeros(len(of))
    done, step = 0, 1
    while len(seed):
        i = np.arange(done + 1, done + step + 1, dtype=np.uint64)
        drawn = mix(seed[:, None] + i * np.uint64(0xE7037ED1A0B428DB))
        gap = -np.log(_unit(drawn)) / rate[:, None]
        gap[:, 0] += time
        when = np.cumsum(gap, axis=1)
        place = mix(drawn ^ np.uint64(0x8EBC6AF09C88C6E3))
        part = (place % np.uint64(m)).astype(np.int64)
        cell = ((place >> np.uint64(32)) % width[:, None].astype(np.uint64)).astype(np.int64)
        take = (when <= last[d][:, None]) & (cell < room[:, None])
        row, col = np.nonzero(take)
        np.minimum.at(best.reshape(-1), d[row] * m + part[row, col], when[row, col])
        last = best.max(axis=1)
        time = when[:, -1]
        on = time <= last[d]
        seed, d, room, rate, width, time = seed[on], d[on], room[on], rate[on], width[on], time[on]
        done += step
        step = min(2 * step, 64) if done > 1 else 1
    return best


def bands(best: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit hash of each band of so many components; the band's number is part of it."""
    n, m = best.shape
    bits = mix(best.view(np.uint64)).reshape(n, m // rows, rows)
    out = np.tile(np.arange(m // rows, dtype=np.uint64), (n, 1))
    for j in range(rows):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + bits[:, :, j])
    return out


def overlap(pairs: int, a: tuple, b: tuple) -> np.ndarray:
    """Weighted Jaccard similarity of bag a[i] and bag b[i], each as shingle_bags gives them; 0 where both are empty."""
    doc = np.concatenate([a[0], b[0]])
    h = np.concatenate([a[1], b[1]])
    n = np.concatenate([a[2], b[2]])
    order = np.lexsort((h, doc))
    doc, h, n = doc[order], h[order], n[order]
    both = np.flatnonzero((doc[1:] == doc[:-1]) & (h[1:] == h[:-1]))
    shared = np.bincount(doc[both], np.minimum(n[both], n[both + 1]), pairs)
    total = np.bincount(doc, n, pairs)
    return shared / np.maximum(total - shared, 1)
