import random
import re
import time
from html.parser import HTMLParser

import pytest
from tests.llm.plain import SF

from lectern.llm import html_extraction as H
from lectern.llm.html_extraction import BlockRules, extract_html, main_text, op1_html_extraction

PARAGRAPH = "The people of the town are in the square and they talk about what is to come, as it was said by all of them in the morning."


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("<html>", ""), ("<p>", ""),
        (f"<body><nav><a href='/'>Home</a></nav><article><h1>A &amp; B</h1><p>{PARAGRAPH}<p>Short.<br>Yes</article><footer>c</footer>", f"A & B\n\n{PARAGRAPH}\n\nShort. Yes"),
        (f"<div class='sidebar'><p>{PARAGRAPH}</p></div><p>{PARAGRAPH}</p><div id=comments><p>{PARAGRAPH}</p></div>", PARAGRAPH),
        (f"<p>{PARAGRAPH}</p><p>Well.</p><p>{PARAGRAPH}</p>", f"{PARAGRAPH}\n\nWell.\n\n{PARAGRAPH}"),
        (f"<p>{PARAGRAPH}</p><p><a href=x>{PARAGRAPH}</a></p>", PARAGRAPH),
        (f"<p>{PARAGRAPH}</p><script>if (a < b) document.write('<p>no</p>')</script><style>p {{}}</style><!-- <p>no</p> -->", PARAGRAPH),
        (f"<article><p>{PARAGRAPH}</p><aside>{PARAGRAPH}</aside><form><p>{PARAGRAPH}</p></form><p>Caf&eacute;&nbsp;&#x41;</p>", f"{PARAGRAPH}\n\nCafé A"),
        (f"<main><p>{PARAGRAPH}</p><p>1 &lt; 2 <i>a</i>b", f"{PARAGRAPH}\n\n1 < 2 ab"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def test_edges(spark):
    pages = spark.createDataFrame([(1, None, None, "clash"), (1, None, None, "clash"), (None, "u", "<p>" + PARAGRAPH * 2000, None)], "page_id long, url string, html string, text string")
    got = sorted(extract_html(pages).collect(), key=str)
    assert len(got) == 3 and got[0].asDict().keys() == {"page_id", "url", "html", "text"}
    assert sorted(len(r["text"]) for r in got) == [0, 0, len(PARAGRAPH) * 2000]
    assert extract_html(pages.limit(0)).count() == 0


def test_query_gives_the_article_of_every_page(spark):
    import html

    for r in op1_html_extraction(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])


PLAIN_PAGE = f"""<html><body><div><a href=/a>Home</a> <a href=/b>News</a></div><h1>The title</h1><p>{PARAGRAPH}</p><p>Short one.</p><p>{PARAGRAPH}</p>
<div>Shoes, boots, sandals, socks, laces, polish, brushes, heels, insoles, buckles, straps, gaiters, slippers, clogs, trainers, pumps</div>
<p>Prices Tuesday</p><div><a href=/x>{PARAGRAPH}</a> and more</div></body></html>"""


def test_densities_decide_where_no_tag_does():
    assert main_text(PLAIN_PAGE) == f"The title\n\n{PARAGRAPH}\n\nShort one.\n\n{PARAGRAPH}"
    always, never = BlockRules(stop_low=0, stop_high=0), BlockRules(stop_low=2, stop_high=2)
    assert "Shoes" in main_text(PLAIN_PAGE, always)
    assert main_text(PLAIN_PAGE, never) == ""
    assert main_text(PLAIN_PAGE, BlockRules(max_link_density=2)).count(PARAGRAPH) == 3


@pytest.mark.parametrize("container", ['div class="container has-sidebar"', 'div class="content no-comments"', 'div id="social-science"', 'section class="login-guide"', 'div class="main widget"', "form"])
def test_class_words_that_only_look_like_menus(container):
    page = f"<body><{container}><h2>Head</h2><p>{PARAGRAPH * 2}</p></{container.split()[0]}></body>"
    assert main_text(page) == f"Head\n\n{PARAGRAPH * 2}"


@pytest.mark.parametrize("container", ['div class="ad"', 'div class="sidebar-left"', 'div id="comments"', 'ol class="comment-list"', 'div class="cookieNotice"', 'div role="navigation"', "aside", "nav", "footer", "div hidden"])
def test_containers_beside_the_article(container):
    other = f"<{container}><p>{PARAGRAPH * 2}</p><p>Short.</p></{container.split()[0]}>"
    assert main_text(f"<body>{other}<div><p>{PARAGRAPH * 2}</p><p>Tail.</p></div>{other}") == f"{PARAGRAPH * 2}\n\nTail."


def test_nothing_of_the_article_is_dropped():
    assert main_text(f"<article><p>{PARAGRAPH}</p><p>for <math><mi>x</mi><mo>=</mo><mn>1</mn></math> only</p></article>") == f"{PARAGRAPH}\n\nfor x=1 only"
    assert main_text("<article><h1>T</h1><p>Xyzzy plugh.</p></article>") == "T\n\nXyzzy plugh."  # words of no known language


@pytest.mark.parametrize("part", ["<a ", '<a b="\'>', "<button>", "<div>", "</p><i>", '<a href="x>', "<!-- ", "<select><p>", "&amp", "<p a='", "<svg>", "<![CDATA["])
def test_hostile_pages_are_read_once(part):
    began = time.process_time()
    main_text(part * 100_000)
    assert time.process_time() - began < 4


def test_clashing_names(spark):
    pages = spark.createDataFrame([(1, "<p>" + PARAGRAPH, 2, 3)], "page_id long, html string, `a.b` long, c0 long")
    assert extract_html(pages).first().asDict() == {"page_id": 1, "html": "<p>" + PARAGRAPH, "a.b": 2, "c0": 3, "text": PARAGRAPH}


UNLISTED = "reader-comments user-comments article-comments post-comments related-posts privacy-notice gdpr-banner newsletter-signup google-ad ad-300x250 story-sidebar cookie-law signup toast alert".split()


@pytest.mark.parametrize("name", [*UNLISTED, "storyComments", "site-wide-alert", "very-long-made-up-name-for-an-ad", "page7-comment-thread"])
def test_names_of_parts_in_no_list(name):
    """Prose in such containers isn't the article's: beside an article, within one, and where no element says what it is."""
    other = f'<div class="{name}"><p>{PARAGRAPH * 2}</p><p>Short.</p></div>'
    own = f"<p>{PARAGRAPH}</p><p>Tail.</p>"
    for page in (f"{other}<article>{own}</article>{other}", f"<article>{own}{other}</article>", f"<div>{own}</div>{other}", f"{other}<div>{own}</div>"):
        assert main_text(f"<body>{page}</body>") == f"{PARAGRAPH}\n\nTail."


@pytest.mark.parametrize("name", ["social-science", "login-guide", "share-price-analysis", "menu-engineering", "notice-of-meeting"])
def test_names_that_touch_on_parts_leave_it_to_the_text(name):
    """The name alone doesn't decide: prose beside prose stays, a list of goods doesn't."""
    part = f'<div class="{name}"><p>{PARAGRAPH * 2}</p></div>'
    assert main_text(f"<body><p>{PARAGRAPH}</p>{part}<p>{PARAGRAPH}</p></body>") == f"{PARAGRAPH}\n\n{PARAGRAPH * 2}\n\n{PARAGRAPH}"
    goods = "Shoes, boots, sandals, socks, laces, polish, brushes, heels, insoles, buckles, straps, gaiters, slippers"
    assert main_text(f'<body><p>{PARAGRAPH}</p><div class="{name}"><p>{goods}</p></div><p>{PARAGRAPH}</p></body>') == f"{PARAGRAPH}\n\n{PARAGRAPH}"


class Plain(HTMLParser):
    """The rules once more, on well-formed pages: blocks with the elements around them, then sums, then neighbours."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks, self.text, self.linked, self.link, self.off = [], [], "", "", 0, 0
        self.feed(page)
        self.close()
        self.cut()

    def cut(self):
        text = " ".join(self.text.split())
        if text:
            self.blocks.append((text, len(" ".join(self.linked.split())), list(self.open)))
        self.text = self.linked = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.off += 1
        elif tag == "a":
            self.link += 1
        elif tag in ("div", "p", "section", "article", "nav", "aside", "footer", "ul", "li", "h1", "h2", "form"):
            self.cut()
            self.open.append((tag, dict(attrs)))
        elif tag == "br":
            self.text += " "

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.off -= 1
        elif tag == "a":
            self.link -= 1
        elif self.open and tag == self.open[-1][0]:
            self.cut()
            self.open.pop()

    def handle_data(self, data):
        if not self.off:
            self.text += data
            self.linked += data if self.link else ""


def plain_weight(around):
    worst = 0
    for tag, attrs in around:
        if tag == "form" or "hidden" in attrs:
            worst = min(worst, -6)
        for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split() if tag != "article" else ():
            words = re.findall("[a-z]+", name.lower())
            if words and words[0] not in H.SAYS_OF_PAGE and set(words) & H.HINTS:
                ends = next(w for w in reversed(words) if w not in H.LAYOUT)
                worst = min(worst, -6 if ends in H.HINTS or set(words) & H.ANYWHERE else -1)
    return worst


def plain_text(page):
    blocks = Plain(page).blocks
    tags = [[t for t, _ in around] for _, _, around in blocks]
    chrome = [bool({"nav", "aside", "footer"} & set(t)) for t in tags]
    main = ["article" in t for t in tags]
    head = [bool(t) and t[-1] in ("h1", "h2") for t in tags]

    def kinds(names):
        out = []
        for (text, linked, around), c, m, h in zip(blocks, chrome, main, head):
            n = m + min(-6 if c else 0, plain_weight(around) if names else 0) - 5 * (linked > 0.33 * len(text))
            if len(text) >= 70 and not h:
                words = re.findall(r"[^\W\d_]+", text.lower())
                share = sum(w in H.STOP_WORDS for w in words) / max(1, len(words))
                n += (2 if share >= 0.2 else 1 if share >= 0.12 else -2) + (len(text) >= 200 and share >= 0.12)
            out.append("good" if n >= 2 else "bad" if n <= -2 else "short")
        return out

    names = any(main) or "<article" in page or any(k != "bad" for k in kinds(True))
    first = kinds(names)
    tells = [i for i, k in enumerate(first) if k != "short" and not (k == "bad" and (chrome[i] or (names and plain_weight(blocks[i][2]) <= -6)))]
    inside, good = any(m and k != "bad" for m, k in zip(main, first)), []
    for i, k in enumerate(first):
        if k == "short":
            before, after = max((j for j in tells if j < i), default=None), min((j for j in tells if j > i), default=None)
            if inside and not main[i]:
                k = "bad"
            elif before is None and after is None:
                k = "good"
            elif before is None or after is None:
                k = first[after if before is None else before]
            elif i - before != after - i:
                k = first[before if i - before < after - i else after]
            elif head[i]:
                k = first[after]
            else:
                k = "good" if (first[before] == first[after] == "good") or (first[before] != first[after] and main[i]) else "bad"
        good.append(k == "good")
    return "\n\n".join(b[0] for b, g in zip(blocks, good) if g)


def made_page(seed):
    r = random.Random(seed)
    goods = "Shoes boots sandals socks laces polish brushes heels insoles buckles straps gaiters slippers "
    names = ["content", "story", "reader-comments", "social-science", "sidebar", "x", "related-posts", "no-comments", "login-guide", "ad-300x250"]

    def block():
        text = r.choice([PARAGRAPH, PARAGRAPH * 2, "Well then.", "Prices", goods, goods * 3, "The end of it &amp; all"])
        kind = r.choice(["p", "p", "p", "li", "h2", "div"])
        return f"<{kind}>{f'<a href=x>{text}</a>' if r.random() < 0.15 else text}{r.choice(['', '', '<br>more'])}</{kind}>"

    def part(depth):
        inner = "".join(part(depth - 1) if depth and r.random() < 0.4 else block() for _ in range(r.randint(1, 4)))
        tag = r.choice(["div", "div", "section", "ul", "nav", "aside", "form", "article"])
        return f'<{tag} class="{r.choice(names)} {r.choice(names)}">{inner}</{tag}>' if r.random() < 0.6 else f"<{tag}>{inner}</{tag}>"

    return f"<body>{''.join(part(2) for _ in range(r.randint(1, 4)))}<script>no</script></body>"


def test_made_pages_against_the_plain_rules():
    pages = [made_page(i) for i in range(1500)]
    wrong = [p for p in pages if main_text(p) != plain_text(p)]
    assert not wrong, (wrong[0], main_text(wrong[0]), plain_text(wrong[0]))
    # Every feature decides somewhere.
    for p in (BlockRules(max_link_density=9), BlockRules(stop_low=0, stop_high=0), BlockRules(short_chars=10_000)):
        assert sum(main_text(x, p) != main_text(x) for x in pages) > 20


def test_query_against_the_plain_rules(spark):
    rows = op1_html_extraction(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect()
    closed = [r for r in rows if re.search("</article>", r["html"])]
    n = sum(r["text"] == plain_text(re.sub(r"<p>((?:(?!</?p>|</article>).)*)(?=<p>)", r"<p>\1</p>", r["html"], flags=re.S)) for r in closed)
    assert n >= 0.9 * len(closed) > 0, (n, len(closed))
