"""Pages as rows, each with an array of its runs: their reading order and the places of a text, many pages at a time.

A page's runs are looked at where the page is; nothing is exchanged between rows. The runs of some pages lie in flat
arrays one after another, so no object is made for a run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# What counts as one visual row, a gap between columns, a gap between words, and the right column.
ROW_LEAST, ROW_SHARE = 2.0, 0.5
GAP_LEAST, GAP_SHARE = 2.0, 0.012
WORD_LEAST, WORD_SHARE = 1.0, 0.2
MIDDLE, LEAST_OF_COLUMN = 0.45, 3
#: Pages that are looked at together; they bound memory and change no result.
TOGETHER = 1_000
#: White space and line ends as Spark's expressions know them.
BLANK = r"[ \t\n\x0b\f\r]"
AT_END = BLANK + r"(\r\n|[\n\r\x{85}\x{2028}\x{2029}])?\z"


def either_case(words: str) -> str:
    """A pattern for words in which only A-Z have two cases."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else BLANK + "+" if c == " " else c for c in words)


WATERMARK = f"{either_case('licensed use limited to')}|{either_case('downloaded on ')}[0-9]"


def _array(column: pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


class Runs:
    """The runs of some pages. page: the number of each run's page; the fields of runs by name."""

    def __init__(self, column: pa.Array):
        runs = _array(column).flatten()
        self.page = np.repeat(np.arange(len(column)), pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False))
        self.fields = {f.name: a for f, a in zip(runs.type, runs.flatten())}

    def number(self, name: str) -> np.ndarray:
        return self.fields[name].fill_null(0).to_numpy(zero_copy_only=False).astype(float, copy=False)

    def text(self, name: str = "str") -> pa.Array:
        return self.fields[name].fill_null("")


def _flags(found: pa.Array) -> np.ndarray:
    return found.to_numpy(zero_copy_only=False).astype(bool, copy=False)


def _at_most(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As Spark compares: nothing is above NaN."""
    return (a <= b) | np.isnan(b)


def _changes(x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    out[1:] = x[1:] != x[:-1]
    return out


def row_starts(page: np.ndarray, y: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each run begins a row: it isn't about as high as the first run of the row before it. Runs lie by page, from the
    top down. All pages take a step together, so there are as many steps as the longest page has runs."""
    first = np.flatnonzero(_changes(page))
    sizes = np.diff(np.append(first, len(page)))
    by_size = np.argsort(-sizes, kind="stable")
    first, sizes = first[by_size], sizes[by_size]
    begins = np.zeros(len(page), bool)
    begins[first] = True
    top, tall = y[first], h[first]
    for i in range(1, sizes[0] if len(sizes) else 0):
        n = np.searchsorted(-sizes, -i)  # pages that have so many runs
        at = first[:n] + i
        limit = np.maximum(ROW_LEAST, np.maximum(tall[:n], h[at]) * ROW_SHARE)
        new = np.flatnonzero(~_at_most(np.abs(y[at] - top[:n]), limit))
        begins[at[new]] = True
        top[new], tall[new] = y[at[new]], h[at[new]]
    return begins


def _joined(first: np.ndarray, pieces: pa.Array) -> pa.Array:
    """The pieces as texts, one from each of first on."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, len(pieces)), pa.int32()), pieces), "")


def _lines(runs: Runs, page_w: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """The page of each line, and what it is."""
    text = runs.text()
    live = np.flatnonzero(_flags(pc.match_substring_regex(text, r"[^ \t\n\x0b\f\r]")) & ~_flags(pc.match_substring_regex(text, WATERMARK)))
    text, page = text.take(pa.array(live)), runs.page[live]
    x, y, w, h = (runs.number(c)[live] for c in "xywh")
    place = runs.fields["ord"].cast(pa.int64()).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)[live]
    keys = [h, w, place, x, -y, page]
    order = np.lexsort(keys)
    if len(order) and not np.logical_or.reduce([_changes(k[order]) for k in keys]).all():
        order = np.lexsort([pc.rank(text, tiebreaker="dense").to_numpy(), *keys])
    x, y, w, h, page = (v[order] for v in (x, y, w, h, page))
    begins = row_starts(page, y, h)
    across = np.lexsort((x, np.cumsum(begins)))
    x, y, w, h = (v[across] for v in (x, y, w, h))
    text = text.take(pa.array(order[across]))

    gap = np.zeros(len(x))
    gap[1:] = x[1:] - (x[:-1] + w[:-1])
    cut = begins | ~_at_most(gap, np.maximum(GAP_LEAST, page_w[page] * GAP_SHARE))
    wide = np.zeros(len(x), bool)
    wide[1:] = ~_at_most(gap[1:], np.maximum(WORD_LEAST, h[:-1] * WORD_SHARE)) & ~_flags(pc.match_substring_regex(text, AT_END))[:-1]
    wide &= ~cut & ~_flags(pc.match_substring_regex(text, r"\A" + BLANK))
    first = np.flatnonzero(cut)
    said = _joined(first, pc.binary_join_element_wise(pc.if_else(pa.array(wide), " ", ""), text, ""))
    said = pc.utf8_trim(pc.replace_substring_regex(said, BLANK + "+", " "), " ")

    page, x, y = page[first], x[first], y[first]
    right = ~(x < page_w[page] * MIDDLE)
    on = lambda side: np.bincount(page[side], minlength=len(page_w)) >= LEAST_OF_COLUMN
    order = np.lexsort((-y, (on(right) & on(~right))[page] & right, page))
    page = page[order]
    line = np.arange(len(page)) - np.searchsorted(page, page) + 1
    return page, {"line": pa.array(line, pa.int32()), "text": said.take(pa.array(order)), "x0": pa.array(x[order]), "col": pa.array(right[order], pa.int32()), "page_w": pa.array(page_w[page])}


def _places(runs: Runs, needle: str, share: float) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """The page of each part of a place, and what it is. The texts of the pages lie one after another; where they and their
    runs begin and end are sums of lengths."""
    y, h, page, low = runs.number("y"), runs.number("h"), runs.page, runs.text("low")
    new = _changes(page)
    jump = np.zeros(len(y), bool)
    jump[1:] = ~new[1:] & ~_at_most(np.abs(y[1:] - y[:-1]), np.maximum(h[1:], 2.0) * share)
    eol = _flags(runs.fields["eol"].fill_null(False))
    line_end = lambda on: pc.if_else(pa.array(on), "\n", "")
    own = np.flatnonzero(new)
    text = _joined(own, pc.binary_join_element_wise(line_end(jump), low, line_end(eol), ""))
    n = pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.cumsum(n + jump + eol) - eol
    start = end - n
    hits, pages, numbers = [], [], []
    for p in np.flatnonzero(_flags(pc.match_substring(text, needle))):
        at, t, i = -1, text[p].as_py(), 0
        base = start[own[p]]
        while (at := t.find(needle, at + 1)) >= 0:
            i += 1
            hits.append(base + at)
            numbers.append(i)
    hit, number = np.array(hits, np.int64), np.array(numbers, np.int32)
    some = np.flatnonzero(n > 0)
    a = np.searchsorted(end[some], hit, "right")
    b = np.searchsorted(start[some], hit + len(needle), "left")
    count = b - a
    of = np.repeat(np.arange(len(hit)), count)
    run = some[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)]
    left = np.maximum(hit[of], start[run])
    size = np.minimum(hit[of] + len(needle), end[run]) - left
    given = {c: pa.array(runs.number(c)[run]) for c in "xywh"}
    return page[run], {"hit": pa.array(number[of]), "ord": runs.fields["ord"].take(pa.array(run)), "left": pa.array(left - start[run]), "size": pa.array(size), "n": pa.array(n[run]), **given}


def _by_page(pages: DataFrame, work: Callable[[pa.RecordBatch], tuple[np.ndarray, dict[str, pa.Array]]], keys: list[str], added: str) -> DataFrame:
    """For each row that work makes of some pages its page's keys and what work says of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), TOGETHER):
                some = batch.slice(a, TOGETHER)
                page, said = work(some)
                of = pa.array(page)
                yield pa.RecordBatch.from_arrays([*(some.column(k).take(of) for k in keys), *said.values()], names=[*keys, *said])

    kept = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in keys)
    return pages.mapInArrow(run, f"{kept}, {added}")


def lines_of(pages: DataFrame) -> DataFrame:
    """doc_id, page, line, text, x0, col, page_w of pages: doc_id, page, page_w, runs (ord, str, x, y, w, h)."""

    def work(some: pa.RecordBatch) -> tuple[np.ndarray, dict[str, pa.Array]]:
        width = some.column("page_w").fill_null(0).to_numpy(zero_copy_only=False).astype(float)
        return _lines(Runs(some.column("runs")), width)

    return _by_page(pages.select("doc_id", "page", "page_w", "runs"), work, ["doc_id", "page"], "line int, text string, x0 double, col int, page_w double")


def places_of(pages: DataFrame, needle: str, share: float = 0.6) -> DataFrame:
    """doc_id, page, page_w, page_h, hit (from 1 on its page), and for each run that has a part of the hit its ord, x, y, w, h
    and n, and the part's left and size in characters. pages: their runs have ord, low (the text, lower case), x, y, w, h, eol.

    needle is lower case and not empty; hits may overlap. A page costs its characters, its runs and its hits' parts."""
    kind = pages.schema["runs"].dataType.elementType["ord"].dataType.simpleString()
    work = lambda some: _places(Runs(some.column("runs")), needle, share)
    return _by_page(pages, work, ["doc_id", "page", "page_w", "page_h"], f"hit int, ord {kind}, left bigint, size bigint, n bigint, x double, y double, w double, h double")
