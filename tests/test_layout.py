"""Layout operators against plain versions that go through a page or a document step by step."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import layout as L
from lectern.operators import locate

RUNS = "doc_id long, page int, ord int, str string, x double, y double, w double, h double, page_w double, page_h double, eol boolean"
LINES = "doc_id long, page int, line int, text string, x0 double, col int, page_w double"


def rows_of(runs, near):
    rows = []
    for r in runs:
        if rows and near(rows[-1][0], r):
            rows[-1].append(r)
        else:
            rows.append([r])
    return rows


def plain_page(runs, width):
    runs = [r for r in runs if (r["str"] or "").strip()]
    runs.sort(key=lambda r: (-r["y"], r["x"], r["ord"]))
    segs = []
    for row in rows_of(runs, lambda a, r: abs(a["y"] - r["y"]) <= max(2, max(a["h"], r["h"]) / 2)):
        row.sort(key=lambda r: r["x"])
        text, prev, first = "", None, None
        for r in [*row, None]:
            gap = r["x"] - (prev["x"] + prev["w"]) if r and prev else 0
            if prev and (r is None or gap > max(2, width * 0.012)):
                segs.append((" ".join(text.split()), first["y"], first["x"]))
                text, prev = "", None
            if r is None:
                break
            if prev is None:
                first = r
            elif gap > max(1, prev["h"] * 0.2) and not prev["str"][-1:].isspace() and not r["str"][:1].isspace():
                text += " "
            text, prev = text + r["str"], r
    left, right = [s for s in segs if s[2] < 0.45 * width], [s for s in segs if s[2] >= 0.45 * width]
    if len(left) >= 3 and len(right) >= 3:
        return sorted(left, key=lambda s: -s[1]) + sorted(right, key=lambda s: -s[1])
    return sorted(segs, key=lambda s: -s[1])


def made_runs(seed, pages=6):
    r, out = random.Random(seed), []
    for p in range(1, pages + 1):
        for i in range(r.choice([0, 1, 5, 40, 90])):
            x = r.choice([40, 300]) + r.randrange(0, 220, 11)
            out.append((1, p, i, r.choice(["a", "bc", " d", "e ", "xa", "aa-", "Über", "  "]), float(x), 700.0 - r.randrange(0, 90), float(r.choice([0, 5, 9, 11])), float(r.choice([0, 6, 10, 14])), 600.0, 800.0, r.random() < 0.1))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_reading_order(spark, seed):
    df = spark.createDataFrame(made_runs(seed), RUNS)
    got = {}
    for r in L.page_lines(df).orderBy("page", "line").collect():
        got.setdefault(r["page"], []).append((r["text"], r["x0"], r["col"]))
    want = {p: [(t, x, int(x >= 270)) for t, _, x in plain_page([r.asDict() for r in df.collect() if r["page"] == p], 600.0)] for p in range(1, 7)}
    assert got == {p: v for p, v in want.items() if v}


def test_reading_order_edges(spark):
    rows = [(1, 1, 0, None, 1.0, 1.0, 1.0, 1.0, 600.0, 800.0, None), (1, 1, 1, "IEEE: Licensed use limited to: X", 1.0, 1.0, 1.0, 1.0, 600.0, 800.0, None), (2, 1, 0, "alone", None, None, None, None, None, None, None)]
    assert [tuple(r)[:6] for r in L.page_lines(spark.createDataFrame(rows, RUNS)).collect()] == [(2, 1, 1, "alone", 0.0, 1)]
    assert L.page_lines(spark.createDataFrame([], RUNS)).count() == 0 and L.find_rects(spark.createDataFrame([], RUNS), "a").count() == 0 and L.row_rects(spark.createDataFrame([], RUNS)).count() == 0


def test_heading(spark):
    said = {"References": True, "REFERENCES:": True, "References and Notes": True, "references to the other work of others": False, "参考文献": True, "The references": False, "Ｒeferences": False, "[References]": False}
    got = spark.createDataFrame(list(enumerate(said)), "i int, t string").orderBy("i").select(L.is_heading(F.col("t"))).collect()
    assert [r[0] for r in got] == list(said.values())


START = re.compile(r"^[\[(]\s*(\d{1,4})\s*[\])]\s*(.*)$"), re.compile(r"^(\d{1,3})[.)]\s+([A-Z\[(“\"].*)$")


def plain_entries(lines):
    """num, raw, page, keys; and the pages that are list pages. lines: page, text, x0, col; the page is 600 wide."""
    heads = [i for i, l in enumerate(lines) if re.sub(r"[\s:.]+$", "", l[1].lower()) in ("references", "reference", "bibliography")]
    if not heads:
        return [], []
    region = [{"page": p, "text": t, "x": x, "col": c, "start": next((m for m in (s.match(" ".join(t.split())) for s in START) if m), None)} for p, t, x, c in lines[heads[-1] + 1 :]]

    def edges(some):
        out = {}
        for l in some:
            out[l["page"], l["col"]] = min(out.get((l["page"], l["col"]), 1e9), l["x"])
        return out

    off = lambda l, e: l["x"] > e.get((l["page"], l["col"]), l["x"]) + 4.8
    junk = lambda l: bool(re.fullmatch(r"\d{1,4}", l["text"].strip()))
    every, pages, seen = edges(region), [], False
    for p in dict.fromkeys(l["page"] for l in region):
        own = [l for l in region if l["page"] == p]
        starts, share = sum(bool(l["start"]) and not junk(l) for l in own), sum(off(l, every) for l in own) / len(own)
        if len(own) <= 250 and (starts >= 3 or share >= 0.15 or (seen and starts >= 1)):
            pages.append(p)
            seen = True
        elif seen:
            break
    starts = [l for l in region if l["start"]]
    kept = [l for l in region if l["page"] in pages and not junk(l)]
    stop = next((i for i, l in enumerate(kept) if re.match("(?i)appendix|acknowledg|supplementary|supporting information", l["text"])), len(kept))
    kept = [l for l in kept[:stop] if l["text"].strip()]
    numbered = len(starts) >= 3
    start_edge, cont_edge, own_edge = edges(starts), edges([l for l in kept if not l["start"]]), edges(kept)

    def walk(opens):
        out, ended = [], True
        for l in kept:
            raw = " ".join(l["text"].split())
            num = opens(l, raw, out, ended)
            ended = bool(re.search(r"[.?!][\"'”’)]?$", raw))
            if num is not None:
                out.append([num, (l["start"][2].strip() if numbered else raw), l["page"], []])
            elif out:
                e = out[-1]
                e[1] = raw if not e[1] else e[1][:-1] + raw if re.search("[a-zA-Z]-$", e[1]) and raw[0].islower() and raw[0].isascii() else f"{e[1]} {raw}"
            if out and (k := re.sub("[^a-z0-9一-鿿]", "", raw.lower())):
                out[-1][3].append(k)
        return out

    def by_number(l, strict, out):
        n = int(l["start"][1]) if l["start"] else None
        cont = cont_edge.get((l["page"], l["col"]))
        wrapped = strict and off(l, start_edge) and cont is not None and abs(l["x"] - cont) <= 4.8
        return n if n is not None and (not out or (n > out[-1][0] and not wrapped)) else None

    if numbered:
        found = walk(lambda l, raw, out, ended: by_number(l, True, out))
        if len(found) < min(3, len(starts) / 2):
            found = walk(lambda l, raw, out, ended: by_number(l, False, out))
        return found, pages
    if not kept or sum(off(l, own_edge) for l in kept) / len(kept) < 0.15:
        return [], pages
    named = lambda l, raw, out, ended: len(out) + 1 if re.match(r"[A-Z][A-Za-z'’\-]+ [A-Z]", raw) and (not out or (not off(l, own_edge) and ended)) else None
    return walk(named), pages


def placed(lines, per_page=24, **more):
    """Lines dealt over columns and pages."""
    out = []
    for i, (text, indent) in enumerate(lines):
        col = i // per_page % 2
        out.append((i // (2 * per_page) + 1, text, 50.0 + 280 * col + indent, col))
    return out


def numbered_list(n, per=3, wrapped=(), skip=()):
    """Entries of per lines; of those in wrapped the second line begins with a citation of a later one."""
    lines = [("Some text before", 0), ("References", 0)]
    for k in range(1, n + 1):
        if k in skip:
            continue
        lines.append((f"[{k}] Author{chr(96 + k % 26)} X, A Title of", 0))
        lines += [(f"[{k + 4}] in part {j} con-" if k in wrapped and j == 0 else f"line {j} of what follows con-" if j == 0 else "tinued here.", 14) for j in range(per - 1)]
    return lines


def made_lines(seed):
    r = random.Random(seed)
    lines = [(r.choice(["x y", "References"]), 0) for _ in range(r.randrange(4))] + [("References", 0)]
    kind = r.randrange(3)
    for k in range(r.randrange(3, 90)):
        c = r.random()
        if c < 0.05:
            lines.append((r.choice(["12", "Appendix A", "7", "[3]", "Plain Words here."]), r.choice([0, 14])))
        elif c < 0.4:
            lines.append(((f"[{k // 3 + r.randrange(3)}] Some", f"{k // 3}. Some", "Smith John on it.")[kind] + " Words", r.choice([0, 0, 0, 14])))
        else:
            lines.append((r.choice(["goes on con-", "tinued here.", "Und so", "(4) and others"]), r.choice([14, 14, 0])))
    return placed(lines, r.choice([4, 10, 30]))


CASES = {
    "26 entries": placed(numbered_list(26)), "wrapped": placed(numbered_list(26, wrapped=range(2, 20, 3))), "gaps": placed(numbered_list(20, skip=(4, 5, 11))),
    "all indented": placed([(t, 14 if i > 3 else 0) for i, (t, _) in enumerate(numbered_list(15))], 200), "page without": placed(numbered_list(20)[:48], 12) + [(9, "plain", 50.0, 0)] * 6 + [(10, f"[{i}] Later", 50.0, 0) for i in range(40, 50)],
    "names": placed([("References", 0), *[(t, n) for k in range(9) for t, n in ((f"Smith{k * 'a'} John and others on", 0), ("things con-", 14), ("tinued. 2001.", 14))]]), "none": placed([("no list", 0)] * 5),
    "many lines": placed([("References", 0), *[("[1] x", 0)] * 300], 1000), **{f"made {i}": made_lines(i) for i in range(40)},
}


def test_reference_lists(spark):
    """All cases at once, as documents."""
    rows = [(d, p, i, t, x, c, 600.0) for d, lines in enumerate(CASES.values()) for i, (p, t, x, c) in enumerate(lines)]
    df = spark.createDataFrame(rows, LINES)
    got, pages = {}, {}
    for r in L.reference_entries(df).orderBy("doc_id", "num").collect():
        got.setdefault(r["doc_id"], []).append([r["num"], r["raw"], r["page"], r["keys"]])
    for r in L.list_pages(df).where("is_list").orderBy("page").collect():
        pages.setdefault(r["doc_id"], []).append(r["page"])
    for d, (name, lines) in enumerate(CASES.items()):
        want, on = plain_entries(lines)
        assert got.get(d, []) == want, name
        assert pages.get(d, []) == on, name
    number = lambda name: [e[0] for e in got[list(CASES).index(name)]]
    assert number("26 entries") == number("wrapped") == list(range(1, 27)) and number("all indented") == list(range(1, 16)) and len(number("names")) == 9
    assert got[0][2][1] == "Authorc X, A Title of line 0 of what follows continued here."
    # A line of which four fifths are known leads to its own entry.
    index = L.reference_entries(df)
    key = got[0][18][3][0]
    asked = spark.createDataFrame([(1, 0, 7, None), (2, 0, None, key), (3, 0, None, key[: int(len(key) * 0.82)]), (4, 0, None, "nothing alike")], "ask_id long, doc_id long, num int, key string")
    assert [(r["entry"], r["how"]) for r in locate.looked_up(index, asked).orderBy("ask_id").collect()] == [(7, "number"), (19, "key"), (19, "likeness"), (None, None)]


def test_reference_lists_edges(spark):
    rows = [(1, 1, 1, "References", None, None, None, "x"), (1, 1, 2, None, None, None, None, "x"), (1, 1, 3, "[1] Ａ", 0.0, 0, 600.0, "x"), (1, 1, 4, "［２］ B", 0.0, 0, 600.0, "x"), (1, 1, 5, "(3) C", 0.0, 0, 600.0, "x")]
    df = spark.createDataFrame(rows, f"{LINES}, key string").withColumn("number", F.lit(1))
    assert [tuple(r) for r in L.reference_entries(df).orderBy("num").collect()] == [(1, 1, "Ａ", 1, ["1"]), (1, 2, "B", 1, ["2b"]), (1, 3, "C", 1, ["3c"])]
    assert L.reference_entries(spark.createDataFrame([], LINES)).count() == 0 and L.list_pages(spark.createDataFrame([], LINES)).count() == 0


def plain_find(runs, q):
    """hit, ord, from and size of the run's characters."""
    text, owner, prev = "", [], None
    for r in runs:
        if prev is not None and abs(r["y"] - prev) > max(r["h"], 2) * 0.6:
            text, owner = text + "\n", [*owner, None]
        text += r["str"].lower()
        owner += [(r["ord"], c) for c in range(len(r["str"]))]
        if r["eol"]:
            text, owner = text + "\n", [*owner, None]
        prev = r["y"]
    out, at, hit = [], text.find(q), 0
    while at >= 0:
        hit += 1
        for o in dict.fromkeys(x[0] for x in owner[at : at + len(q)] if x):
            own = [x[1] for x in owner[at : at + len(q)] if x and x[0] == o]
            out.append((hit, o, own[0], len(own)))
        at = text.find(q, at + 1)
    return out


@pytest.mark.parametrize("q", ["a", "aa", "axa", "a-x", "ü", "d e"])
def test_find(spark, q):
    df = spark.createDataFrame(made_runs(7), RUNS)
    got = {(r["page"], r["hit"], r["ord"]): (round(r["x"], 9), round(r["w"], 9), round(r["y"], 9)) for r in L.find_rects(df, q.upper(), width=4).collect()}
    want = {}
    for p in range(1, 7):
        runs = {r["ord"]: r for r in df.where(F.col("page") == p).orderBy("ord").collect()}
        for hit, o, a, n in plain_find(runs.values(), q):
            r = runs[o]
            want[p, hit, o] = round((r["x"] + r["w"] * a / len(r["str"])) / 600, 9), round(r["w"] * n / len(r["str"]) / 600, 9), round(1 - (r["y"] + r["h"] * 0.85) / 800, 9)
    assert got == want and (want or q != "a")
    pages = {r["page"]: r for r in L.hits_by_page(L.find_rects(df, q), F.col("hit") == 1).collect()}
    assert {p: len(r["rects"]) for p, r in pages.items()} == {p: sum(k[0] == p for k in want) for p in {k[0] for k in want}}
    assert all({x["hit"] for x in r["current_rects"]} == {1} for r in pages.values())


def test_row_rects(spark):
    df = spark.createDataFrame(made_runs(3), RUNS)
    got = {r["page"]: ([tuple(round(v, 9) for v in x) for x in r["rects"]], round(r["top"], 9), round(r["height"], 9)) for r in L.row_rects(df).collect()}
    want = {}
    for p in range(1, 7):
        runs = sorted((r.asDict() for r in df.where(F.col("page") == p).collect()), key=lambda r: (-r["y"], r["ord"]))
        for r in runs:
            r["h"] = r["h"] or 8.0
            r["w"] = r["w"] or len(r["str"]) * r["h"] / 2
        boxes = []
        for row in rows_of(runs, lambda a, r: abs(a["y"] - r["y"]) <= max(2, r["h"] * 0.45)):
            x0, x1 = min(r["x"] for r in row), max(r["x"] + r["w"] for r in row)
            y0, y1 = min(r["y"] for r in row), max(r["y"] + r["h"] for r in row)
            boxes.append((x0 / 600, (800 - y1) / 800, min(1 - x0 / 600, (x1 - x0) / 600), (y1 - y0) / 800))
        boxes = [b for b in boxes if b[2] > 0.002 and b[3] > 0.002]
        if boxes:
            top = min(b[1] for b in boxes)
            want[p] = [tuple(round(v, 9) for v in b) for b in boxes], round(top, 9), round(max(b[1] + b[3] for b in boxes) - top, 9)
    assert got == want


def test_margins_and_prompts(spark):
    at = [("12", 5.0), ("12", 300.0), ("12345", 5.0), (" ", 590.0), (None, 1.0), ("word", 5.0), ("1234", 580.0), ("1234", 579.0)]
    rows = [(1, 1, i, t, x, 1.0, 1.0, 1.0, 600.0, 800.0, i == 3) for i, (t, x) in enumerate(at)] + [(2, 1, 0, "7", 1.0, 1.0, 1.0, 1.0, None, None, None)]
    df = spark.createDataFrame(rows, RUNS)
    assert sorted((r["doc_id"], r["ord"]) for r in L.without_margin_junk(df).collect()) == [(1, 1), (1, 2), (1, 5), (1, 7), (2, 0)]
    assert {r["doc_id"]: r["text"] for r in L.prompt_text(df).collect()} == {1: "121212345\nword12341234", 2: "7"}
