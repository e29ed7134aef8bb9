"""Scalar functions, checks of answers, chunks and records, on made-up cases."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.models import embed, sse_deltas
from lectern.operators import bibliography as B
from lectern.operators import chunking as C
from lectern.operators import verify as V


def values(spark, f, *rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    return [r["v"] for r in df.select("i", f(F.col("c")).alias("v")).orderBy("i").collect()]


def test_scalars(spark):
    assert values(spark, X.estimate_tokens, "abcd", "abcde", "你好", "a你") == [1, 2, 2, 2]
    assert values(spark, X.slugify, "A Novel—Approach!", "漢字", "x" * 60) == ["a-novel-approach", "paper", "x" * 48]
    assert values(spark, X.clean_query, " [12]  a   b ", "3. x", "(4) y") == ["a b", "x", "y"]
    assert values(spark, X.intent, 'about "thermal design"', "IGBT losses", "see 3.2.1", "at 10kV", "what is it") == ["exact"] * 4 + ["semantic"]
    assert values(spark, X.keywords, '"thermal design" of IGBT is-a ab') == [["thermal design", "thermal", "design", "IGBT", "is-a"]]
    assert values(spark, X.title_from_slug, "2023-deep-lEarning-2") == ["Deep LEarning"]
    assert values(spark, X.ascii_fold, "Müller-Å", None) == ["Muller-A", None]
    assert values(spark, X.norm_text, "Ｃafé ﬁx") == ["cafefix"]
    assert values(spark, X.selection_text, "power-\n train is\nhere\n你\n好") == ["power-train is here 你好"]
    assert values(spark, X.loose_json, 'so {"a": {"b": 1}} end', "none", "{bad") == ['{"a": {"b": 1}}', None, None]
    assert values(spark, lambda c: X.version_newer(c, F.lit("1.2")), "1.10", "1.2.0", "v1.3", "1.1.9") == [True, False, True, False]
    night = spark.createDataFrame([("night", "nacht"), ("a", "ab"), ("ab", "ab")], "a string, b string")
    assert [r[0] for r in night.select(X.dice(X.bigrams(F.col("a")), X.bigrams(F.col("b")))).collect()] == [0.25, 0.0, 1.0]


def test_embeddings_are_unit_vectors(spark):
    v = spark.createDataFrame([("a b c",), ("a b d",), ("",)], "t string").select(embed("t").alias("v")).collect()
    assert sum(x * x for x in v[0]["v"]) == pytest.approx(1) and len(v[2]["v"]) == 64


def test_stream_lines():
    assert sse_deltas(['data: {"choices":[{"delta":{"content":"a"}}]}', "", ": ping", "data: {bad", 'data: {"choices":[{"delta":{}}]}', "data: [DONE]", 'data: {"choices":[{"delta":{"content":"z"}}]}']) == ["a"]


def test_citation_rules(spark):
    sources = "array(struct(1 AS n, 'A Thermal Study of Things' AS title), struct(2 AS n, 'Other' AS title))"
    df = spark.createDataFrame([("see [1] and [3], 《thermal study》 and 《Unknown work》",), ("fine [1][2]",), ("lists [1,3] don't count",)], "answer string").withColumn("sources", F.expr(sources))
    got = V.checked(df).collect()
    assert [(r["missing"], r["unused"], r["unknown_titles"], r["level"]) for r in got] == [([3], [2], ["Unknown work"], "error"), ([], [], [], "pass"), ([], [1, 2], [], "pass")]
    said = F.lit('{"issues":[{"type":"claim","severity":"warn","detail":"d","refs":["1","x"]},{"type":"odd","detail":"e"}]}')
    merged = V.merged(V.checked(df), said).collect()
    assert [r["level"] for r in merged] == ["error", "warn", "warn"] and merged[1]["issues"][0]["refs"] == [1] and len(merged[1]["issues"]) == 1


@pytest.mark.parametrize("text, once", [("a[7] b[7] c[7].", "a b c [7]."), ("x `a[1]` [1](u) [1]", "x `a[1]` [1](u) [1]"), ("你[2]好[2]。", "你好[2]。"), ("[1] then [2]", "[1] then [2]"), ("a [3] [3] (b)", "a   (b) [3]"), ("`[4]` [4] [4]!?", "`[4]`  [4]!?"), ("", ""), (None, None)])
def test_cites_once(text, once):
    assert V.cites_once(text) == once


@given(st.text(alphabet="ab [1]2`.。", max_size=40))
def test_cites_once_is_idempotent(text):
    once = V.cites_once(text)
    assert V.cites_once(once) == once


def test_headings(spark):
    page = "Title of it all here\n\n# Abstract\nWe say something of note.\n\n## 3.2 Method\nText of the method.\n\n![x](y)\n```\n  code of some length\n# no heading\n```\n## III. Results\nResults are all here.\n## V. X\nNo number is here.\n## 第三章 方法\nText of the chapter.\n## References\n[1] Left out of all.\n## Appendix A\nMore of the text.\n~~~\nnever closed at all"
    rows = C.blocks_of(spark.createDataFrame([(1, 1, page), (2, 1, None), (3, 1, "")], "doc_id long, page int, text string")).orderBy("seq").collect()
    assert [(b["kind"], b["number"], b["title"]) for b in rows] == [("abstract", "", ""), ("abstract", "", "Abstract"), ("body", "3.2", "Method"), ("body", "3.2", "Method"), ("body", "III", "Results"), ("body", "", "V. X"), ("body", "三", "方法"), ("body", "Appendix", "Appendix A")]
    assert rows[3]["text"] == "```\n  code of some length\n# no heading\n```"


def test_blocks_over_pages(spark):
    pages = [(1, 1, "Front of  it\tall\ngoes on here"), (1, 2, "and here again.\n```"), (1, 3, "in a fence\n```\nTable 2 has all the numbers")]
    rows = C.blocks_of(spark.createDataFrame(pages, "doc_id long, page int, text string")).orderBy("seq").collect()
    assert [(b["page"], b["kind"], b["text"]) for b in rows] == [(1, "abstract", "Front of it all goes on here"), (2, "abstract", "and here again."), (3, "abstract", "```\nin a fence\n```"), (3, "abstract", "Table 2 has all the numbers")]


def test_back_matter(spark):
    pages = spark.createDataFrame([(1, 1, "a\nb"), (1, 2, "c\nd\nReferences\ne"), (1, 3, "f"), (2, 1, "g")], "doc_id int, page int, text string")
    assert sorted(map(tuple, C.without_back_matter(pages).collect())) == [(1, 1, "a\nb"), (1, 2, "c\nd"), (1, 3, ""), (2, 1, "g")]
    items = spark.createDataFrame([(1, 1, 0, "a", 10.0), (1, 1, 1, "b", 11.0), (1, 1, 2, "c", 20.0)], "doc_id int, page int, ord int, str string, y double")
    assert sorted(r["text"] for r in C.lines_of(items).collect()) == ["a b", "c"]


def test_chunking_falls_back_to_lines(spark):
    pages = spark.createDataFrame([(1, 1, "\n".join(["this line has a good number of words in it " * 2] * 12))], "doc_id long, page int, text string")
    got = C.chunk_documents(pages).collect()
    assert len(got) == 1 and got[0]["page"] == 1 and C.chunk_documents(pages.limit(0)).count() == 0


ENTRY = """@article{Wang_2023, title={A {Nested {Deep}} Title}, volume=12, DOI="10.1/x{"}y", author={Wang, Xiao and Li, Ming},
 year = 2023}"""


def test_records(spark):
    e = B.parse_entry(ENTRY)
    assert (e["type"], e["key"], e["fields"]["year"], e["fields"]["title"]) == ("article", "Wang_2023", "2023", "A {Nested {Deep}} Title")
    assert B.parse_entry('@inproceedings(k, author = "A. B. Cee", year = 2020)')["fields"]["author"] == "A. B. Cee"
    assert [B.parse_entry(x) for x in ("@article{k, title = {Unclosed", "plain text", "", None, "@a{k", '@a{k, t = "x')] == [None] * 6
    df = spark.createDataFrame([(ENTRY,)], "s string").select(B.parsed("s").alias("e"))
    text = df.select(B.rendered(F.col("e.type"), F.col("e.key"), F.col("e.names"), F.col("e.fields"))).first()[0]
    assert B.parse_entry(text)["fields"] == e["fields"] and text.index("author") < text.index("title") < text.index("doi")


@pytest.mark.parametrize("who, year, title, key", [("Xiao Wang, Ming Li", 2023, "A Novel Approach to Junction", "wang2023approach"), ("Zhang, San and Li, Si", 2020, "Thermal Analysis", "zhang2020thermal"), ("San Zhang", None, "The IGBT", "zhangigbt"), ("Cee", 1999, "Design of something", "cee1999something"), ("", 2021, "Cooling", "anon2021cooling"), ("Müller, Jan", 2015, "Ein Versuch", "muller2015ein"), (None, None, None, "anonpaper")])
def test_keys(spark, who, year, title, key):
    df = spark.createDataFrame([(who, year, title)], "who string, year int, title string")
    assert df.select(B.cite_keys(F.col("who"), F.col("year"), F.col("title"))).first()[0] == key


@pytest.mark.parametrize("who, family", [("San Zhang, Si Li", "Zhang"), ("Zhang, San and Li, Si", "Zhang"), ("San Zhang and Si Li", "Zhang"), ("", ""), (None, ""), ("  Ana  Ruiz ", "Ruiz"), ("Anderson Sand", "Sand"), (", x", "")])
def test_family_names(spark, who, family):
    assert values(spark, B.family_name, who) == [family]


def test_latex(spark):
    assert B.latex_escape("A & B 100% C_D #x $y {z}") == "A \\& B 100\\% C\\_D \\#x \\$y \\{z\\}"
    assert B.fold_unicode("Café ünïcode Ångström") == "Caf\\'{e} \\'{u}n\\'{i}code {\\AA}ngstr\\'{o}m"
    assert B.fold_unicode("a—b–c… 5×7") == "a--b--c\\ldots{} 5$\\times$7" and B.fold_unicode("功率电子 thermal") == " thermal"
    assert [r["key"] for r in B.numbered_keys(spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4)], "key string, ord int")).orderBy("ord").collect()] == ["a", "a-2", "a-3", "b"]


def test_resolution(spark):
    papers = spark.createDataFrame([(1, "Deep Learning of Things", "A B", 2020, ""), (2, "An Invented Title Nobody Wrote", "", None, ""), (3, "Deep Learning of Things", "C D", 2010, "Proc. Conference on X"), (4, "Thermal Design & Co", "E F", 2019, "")], "id long, title string, authors string, year int, venue string")
    official = "@article{z, title={Deep Learning of Things}, author={B, A}, year={2020}, journal={J}, month={5}}"
    works = spark.createDataFrame([(1, 0, "Deep learning of things", "A B", 2021, "J", "10.1/a", "journal-article", official), (1, 1, "Other", "X", 2020, "", "", "", None), (3, 0, "Deep learning of things", "A B", 2021, "J", "10.1/a", "journal-article", official), (4, 0, "Thermal design & co", "E Fé", 2019, "K Workshop", "", "", None)], "id long, ordinal int, title string, authors string, year int, venue string, doi string, kind string, bibtex string")
    got = {r["id"]: r for r in B.resolved(papers, works).collect()}
    assert [(got[i]["source"], got[i]["type"]) for i in (1, 2, 3, 4)] == [("official", "article"), ("local", "misc"), ("local", "inproceedings"), ("web", "inproceedings")]
    assert got[2]["warnings"] == ["no-authors", "no-venue", "no-year", "unverified"] and got[1]["names"] == ["title", "author", "year", "journal"]
    assert got[4]["fields"] == {"author": B.latex_escape(B.fold_unicode("E Fé")), "title": "Thermal Design \\& Co", "booktitle": "K Workshop", "year": "2019"}
    # Official fields are in ASCII, others than the known ones go; a page's address stands for a doi that is missing.
    web = works.where("id = 4").withColumn("landing", F.lit("http://l/4")).unionByName(works.where("id = 1 AND ordinal = 0").withColumn("bibtex", F.lit("@article{z, title={Deep Learning of Things}, author={Müller–B, A}, year={2020}, publisher={É}, month={5}}")).withColumn("landing", F.lit("http://l/1")))
    more = {r["id"]: r for r in B.resolved(papers, web).collect()}
    assert more[1]["fields"] == {"title": "Deep Learning of Things", "author": "M\\'{u}ller--B, A", "year": "2020", "publisher": "\\'{E}"} and more[4]["fields"]["url"] == "http://l/4" and "url" not in more[2]["fields"]
    out = B.exported(B.resolved(papers, works)).collect()
    assert all(r["ok"] for r in out) and len({r["key"] for r in out}) == 4
    assert B.source_counts(B.resolved(papers, works)).first().asDict() == {"official": 1, "web": 1, "local": 2}


def test_no_candidate_is_lost(spark):
    import random

    rnd = random.Random(5)
    made = lambda: "".join(rnd.choice("abcde ") for _ in range(rnd.randrange(0, 40)))
    titles = [made() for _ in range(60)]
    near = ["".join(c if rnd.random() > 0.15 else rnd.choice("abcxyz") for c in t) for t in titles]
    papers = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    works = spark.createDataFrame(list(enumerate(near)), "ordinal long, title string")
    pairs = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    for least in (0.0, 0.3, 0.6):
        got = {(r["id"], r["ordinal"]) for r in B.candidates(papers, works, least).collect()}
        want = {(i, j) for i, a in enumerate(titles) for j, b in enumerate(near) if pairs(a) and pairs(b) and 2 * len(pairs(a) & pairs(b)) / (len(pairs(a)) + len(pairs(b))) > least}
        assert want == got and len(want) > 20
