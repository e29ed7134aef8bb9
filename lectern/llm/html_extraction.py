"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass sums evidence about each block: the density of stop words
and the length of its text, the share of it that stands in links, and, with fixed weights, the tags and the words of the
names of the containers around it. Clear sums decide; others, and short blocks and headings, stay undecided: prose in a
container whose name only touches on what isn't an article, too. In the second pass an undecided block takes the label of its nearest decided neighbours: good where both are good, and where they differ, that
of the nearer one. Each page is handled within its row, in one walk over it.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import map_rows, table

#: Frequent function words of the languages looked at.
STOP_WORDS = frozenset(
    "the of and to a in is it that for with as are was be by on from this at or an not he she they we you his her its"
    " der die das und ist von zu mit den im nicht ein eine als auch für auf dem des sich sie er es wie aus bei"
    " le la les de des et un une du en est que qui dans pour par sur pas au avec il elle ce se ne plus"
    " el los las del y una por con para como su al lo más no o".split()
)
#: Elements whose content isn't text of the page.
SKIPPED = frozenset("script style noscript template head title iframe canvas select button textarea".split())
#: Elements that are by their meaning not the article; a header is one outside of it.
CHROME = frozenset("nav footer aside menu dialog header".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th"
    " thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
#: Words of a class, id or role that speak against a container. The word that a name ends with says what the container is;
#: some words say it wherever they stand; a word elsewhere says something about it, but little.
HINTS = frozenset(
    "ad ads advert advertisement advertising adverts banner sponsor sponsored sponsors promo promoted promotion nav navbar navigation menu menubar sidebar"
    " footer breadcrumb breadcrumbs cookie cookies consent gdpr notice alert toast comment comments disqus reply replies share sharing social related recommended"
    " recommendations newsletter subscribe subscription signup popup modal widget widgets pagination pager toolbar masthead login contentinfo complementary".split()
)
ANYWHERE = frozenset("ad ads advert advertisement advertising adverts sponsor sponsored sponsors promoted cookie cookies consent gdpr comment comments disqus newsletter breadcrumb breadcrumbs".split())
#: Words that say nothing, so that the word before them is the one that a name ends with.
LAYOUT = frozenset(
    "a area b bar block body bottom box button buttons c center col column container content count d form global group header holder icons inner"
    " item items l large left line link links list m main medium middle outer overlay page panel primary r right row secondary section site slot small tag text"
    " the thread title top unit w wrap wrapper x posts articles stories reads".split()
)
SAYS_OF_PAGE = frozenset("has no with without is not".split())
#: What stands in such elements weighs so much against a block; in containers with such words so much, and with a word that
#: only says something about them; a form is as good as a container with such a word.
CHROME_WEIGHT, NAMED_WEIGHT, TOUCHED_WEIGHT = -6, -6, -1
NAME_WORD = re.compile(r"[a-z]+")
OPENS = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([A-Za-z][A-Za-z0-9:-]*))")
#: Where a tag ends or a quoted value begins.
STOP = re.compile(r">|=\s*[\"']")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Tags that end an open one of the same kind.
SELF_CLOSING = frozenset("li dt dd tr td th option p".split())
MARK = re.compile(r"<(?:article|main)[\s>]", re.I)
WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class BlockRules:
    max_link_density: float = 0.33
    short_chars: int = 70
    long_chars: int = 200
    stop_low: float = 0.12
    stop_high: float = 0.20


class Block:
    __slots__ = ("chrome", "heading", "hint", "linked", "main", "text")

    def __init__(self, text: str, linked: int, chrome: bool, hint: int, main: bool, heading: bool):
        self.text, self.linked, self.chrome, self.hint, self.main, self.heading = text, linked, chrome, hint, main, heading


class Tags:
    """The tags of a page in order. Nothing is read twice, whatever is left open."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in "\"'"}
        self.unclosed: set[str] = set()

    def end(self, at: int) -> int:
        """Where the tag that is open at at ends; -1 if it never does. A quote that isn't closed is a letter like others."""
        while True:
            m = STOP.search(self.page, at)
            if not m:
                return -1
            quote = self.page[m.end() - 1]
            if quote == ">":
                return m.end()
            at = self.page.find(quote, m.end()) + 1 if self.last[quote] >= m.end() else m.end()

    def close(self, tag: str, at: int) -> int:
        """Behind the next closing tag; -1 if there is none."""
        if tag in self.unclosed:
            return -1
        m = re.compile(rf"</{tag}\s*>", re.I).search(self.page, at)
        if not m:
            self.unclosed.add(tag)
            return -1
        return m.end()


def blocks_of(page: str) -> list[Block]:
    """The blocks with text, in page order; white space is one space each. A tag that the end of the page cuts off is none."""
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, int, bool]] = []  # tag, in chrome, weight of the names around, in the main part
    opened: Counter[str] = Counter()
    tags = Tags(page)
    links, at, size = 0, 0, len(page)
    heading = False

    def flush() -> None:
        nonlocal parts, heading
        if parts:
            text = " ".join(entities.unescape("".join(x for x, _ in parts)).split())
            if text:
                linked = len(" ".join(entities.unescape("".join(x for x, link in parts if link)).split()))
                out.append(Block(text, linked, *(stack[-1][1:] if stack else (False, 0, False)), heading))
            parts = []
        heading = False

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    while at < size:
        m = OPENS.search(page, at)
        begin = m.start() if m else size
        if begin > at:
            parts.append((page[at:begin], links > 0))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if m[0] == "<!--":
                end = page.find("-->", at)
            elif m[0] == "<![CDATA[":
                end = page.find("]]>", at)
                inside = page[at : end if end >= 0 else size]
                parts.append((inside.replace("&", "&amp;"), links > 0))
            else:
                end = page.find(">", at)
            at = size if end < 0 else end + (1 if m[0] in ("<!", "<?") else 3)
            continue
        end = tags.end(at)
        if end < 0:
            break
        inner, at = page[at : end - 1], end
        tag, closing = m[2].lower(), bool(m[1])
        if tag in SKIPPED and not closing:
            if not inner.endswith("/"):
                end = tags.close(tag, at)
                if end >= 0:
                    at = end
                elif tag in ("script", "style", "noscript", "template", "iframe", "textarea"):
                    at = size  # an open script runs to the end
            continue
        if tag == "a":
            links = 0 if closing else 1
        elif tag in ("br", "img", "wbr"):
            parts.append((" ", False))
        elif tag in BLOCKS:
            flush()
            if closing:
                if opened[tag]:
                    while stack[-1][0] != tag:
                        pop()
                    pop()
            elif tag not in VOID:
                if stack and stack[-1][0] == "p":
                    pop()
                if tag in SELF_CLOSING and stack and stack[-1][0] == tag:
                    pop()
                _, chrome, hint, main = stack[-1] if stack else ("", False, 0, False)
                chrome = chrome or (tag in CHROME and not (tag == "header" and main))
                hint = min(hint, NAMED_WEIGHT if tag == "form" else 0 if tag in ("html", "body", *MAIN) else name_weight(inner))
                main = main or tag in MAIN
                stack.append((tag, chrome, hint, main))
                opened[tag] += 1
                heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            if tag in ("td", "th") or tag == "li":
                links = 0
    flush()
    return out


def name_weight(attributes: str) -> int:
    """What the names of a container weigh: the heaviest of its classes, ids and roles."""
    weight = 0
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        if m[1].lower() == "hidden":
            return NAMED_WEIGHT
        for name in (m[2] or m[3] or m[4] or "").split():
            words = NAME_WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
            if words and words[0] not in SAYS_OF_PAGE and not HINTS.isdisjoint(words):
                said = [w for w in words if w not in LAYOUT]
                weight = min(weight, NAMED_WEIGHT if said[-1] in HINTS or not ANYWHERE.isdisjoint(words) else TOUCHED_WEIGHT)
    return weight


def evidence(b: Block, r: BlockRules, hints: bool = True) -> int:
    """Above 0 speaks for the article, below 0 against it."""
    score = 1 if b.main else 0
    score += min(CHROME_WEIGHT if b.chrome else 0, b.hint if hints else 0)
    if b.linked > r.max_link_density * len(b.text):
        score -= 5
    if len(b.text) >= r.short_chars and not b.heading:
        words = WORD.findall(b.text.lower())
        density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
        score += 2 if density >= r.stop_high else 1 if density >= r.stop_low else -2
        if len(b.text) >= r.long_chars and density >= r.stop_low:
            score += 1
    return score


def first_pass(b: Block, r: BlockRules, hints: bool = True) -> str:
    """good, bad or short (undecided)."""
    score = evidence(b, r, hints)
    return "good" if score >= 2 else "bad" if score <= -2 else "short"


def labels(blocks: list[Block], r: BlockRules = BlockRules(), marked: bool = False) -> list[bool]:
    """True for the blocks of the article. marked: the page has an element for it.

    What is bad by its container tells nothing about the blocks beside it. Where a page without such an element would have
    no text at all, class words aren't asked: its text is in a container that looks like something else.
    """
    hints = marked or any(first_pass(b, r) != "bad" for b in blocks)
    kinds = [first_pass(b, r, hints) for b in blocks]
    apart = [k == "bad" and (b.chrome or (hints and b.hint <= NAMED_WEIGHT)) for b, k in zip(blocks, kinds)]

    def nearest(order: range) -> dict[int, tuple[str, int]]:
        seen: tuple[str, int] | None = None
        found = {}
        for i in order:
            if kinds[i] == "short":
                if seen:
                    found[i] = (seen[0], abs(seen[1] - i))
            elif not apart[i]:
                seen = (kinds[i], i)
        return found

    before, after = nearest(range(len(blocks))), nearest(range(len(blocks) - 1, -1, -1))
    inside = any(b.main and k != "bad" for b, k in zip(blocks, kinds))
    out = []
    for i, kind in enumerate(kinds):
        if kind == "short":
            order = (after, before) if blocks[i].heading else (before, after)  # a heading goes with what comes next
            sides = sorted((x[i] for x in order if i in x), key=lambda x: (x[1], not blocks[i].heading and (x[0] == "good") != blocks[i].main))
            # Where a page marks its article, a short block outside isn't part of it.
            kind = "bad" if inside and not blocks[i].main else sides[0][0] if sides else "good"
        out.append(kind == "good")
    return out


def main_text(page: str | None, r: BlockRules = BlockRules()) -> str:
    if not page:
        return ""
    found = blocks_of(page)
    return "\n\n".join(b.text for b, good in zip(found, labels(found, r, MARK.search(page) is not None)) if good)


def extract_html(pages: DataFrame, r: BlockRules = BlockRules(), html: str = "html") -> DataFrame:
    """Each row of pages with text: the main text, empty where there is none.

    Null, empty and text-free pages give an empty text; a page cut off anywhere gives what it has. Repeated rows stay. A
    block as far from a good one as from a bad one is good inside the marked article and bad elsewhere; a heading goes with
    what follows. A column of the input named text is replaced; others stay, whatever their names. Pages are read whole and
    once, in time in line with their length; the longest bounds a task's memory. No pages, no rows.
    """

    def work(column: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        yield 0, len(column), [pa.array([main_text(x.as_py(), r) for x in column], pa.string())]

    return map_rows(pages, html, "text string", work)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_html(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
