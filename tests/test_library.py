"""Upkeep of a library, ranking, lookup and streaming, on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.models import word_overlap_reranker
from lectern.operators import chats, library, locate, retrieval, upkeep
from lectern.sources import library as files
from lectern.streaming import incremental


def test_scan(spark, tmp_path):
    for p in ("papers/01-power/2020-deep-work/x.pdf", "papers/01-power/2020-deep-work/paper.pdf", "papers/b/second/a.pdf", "papers/b/second/b.pdf", "papers/.hid/x/a.pdf", "papers/b/.h/a.pdf", "top.pdf", "papers/b/second/note.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    found = files.list_files(spark, str(tmp_path))
    got = sorted(map(tuple, files.scan(found).collect()))
    assert got == [("papers/01-power/2020-deep-work/paper.pdf", "power", "2020-deep-work"), ("papers/b/second/a.pdf", "b", "second")]
    assert [r["slug"] for r in files.scan_flat(found).collect()] == ["top"]
    assert [r["path"] for r in files.collect_imports(found, "papers").collect()] == ["top.pdf"]
    notes = spark.createDataFrame([("papers/b/second/note.md", "---\ntitle: 'Second: a note'\nauthors: [A B, \"C D\"]\nyear: 2019\nvenue: >\n  Journal of\n  Things\n---\n# Heading")], "path string, content string")
    rows = {r["slug"]: r for r in files.described(files.scan(found), notes).collect()}
    assert tuple(rows["second"])[3:] == ("Second: a note", "A B,C D", 2019, "Journal of Things")
    assert tuple(rows["2020-deep-work"])[3:] == ("Deep Work", "", 2020, "")
    assert files.parse_note("# Only a heading\ntext") == {"title": "Only a heading"}


def test_upkeep(spark):
    old = spark.createDataFrame([(1, "a", "keep"), (2, "b", "keep"), (3, "c", "keep")], "id long, t string, s string")
    new = spark.createDataFrame([(2, None), (4, "d")], "id long, t string")
    assert sorted(map(tuple, library.upsert(old, new, "id", ["t"]).collect())) == [(1, "a", "keep", "kept"), (2, None, "keep", "updated"), (3, "c", "keep", "kept"), (4, "d", None, "added")]
    assert [r["state"] for r in library.guarded_upsert(old, new, "id", ["t"], F.col("id") == 2).orderBy("id").collect()] == ["kept", "kept", "kept", "added"]
    paths = spark.createDataFrame([(1, "/l/a"), (2, "/l/gone"), (3, "/o/b")], "id long, path string")
    assert [r["id"] for r in library.drop_stale(paths, paths.where("id <> 2"), "/l/").collect()] == [1]
    assert sorted(r["id"] for r in library.without({"old": (old, "id")}, new, "id")["old"].collect()) == [1, 3]
    now = F.expr("timestamp '2024-01-08 00:00:00'")
    tried = spark.sql("SELECT * FROM VALUES (1L, timestamp '2024-01-01 00:00:01'), (2L, timestamp '2023-12-31 23:59:59') AS t(id, at)")
    assert sorted(r["id"] for r in library.due(old, tried, "id", now).collect()) == [2, 3]
    slugs = spark.createDataFrame([("a", 1), ("a", 2), ("a-2", 3)], "slug string, path int")
    assert len({r["slug"] for r in files.unique_slugs(slugs).collect()}) == 3
    assert library.extended_schema(old, {"x": ("int", 5), "t": ("string", "")}).first()["x"] == 5
    built = {"dim": 64}
    assert library.needs_rebuild(old.withColumn("indexed", F.lit(True)), new.withColumn("paper_id", F.col("id")), built, {"dim": 32})


def brute_bm25(rows, terms):
    import math

    n, mean = len(rows), sum(max(len(t) - 2, 0) for _, t in rows) / len(rows)
    out = {}
    for k in terms:
        count = {i: sum(t.lower().startswith(k, j) for j in range(len(t))) for i, t in rows}
        df = sum(c > 0 for c in count.values())
        idf = math.log((n - df + 0.5) / (df + 0.5))
        for i, t in rows:
            if count[i]:
                tf = count[i]
                out[i] = out.get(i, 0) + (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * max(len(t) - 2, 0) / mean))
    return out


def test_bm25(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choices(["aaa", "aaaa", "thermal", "the", "x-ray", "Pöl"], k=rnd.randrange(1, 20)))) for i in range(60)]
    got = {r["id"]: r["score"] for r in retrieval.bm25(spark.createDataFrame(rows, "id long, text string"), ["text"], ["aaa", "x-ray", "pöl", "th", "thermal"], "id").collect()}
    assert got == pytest.approx(brute_bm25(rows, ["aaa", "x-ray", "pöl", "thermal"]), abs=1e-8)
    assert retrieval.bm25(spark.createDataFrame(rows, "id long, text string"), ["text"], ["ab"], "id").count() == 0


def test_ranking(spark):
    a = spark.createDataFrame([(i, i) for i in range(10)], "id long, pos long")
    b = spark.createDataFrame([(9, 0), (20, 1)], "id long, pos long")
    fused = {r["id"]: r["score"] for r in retrieval.fuse([(a, 0.75), (b, 1.25)], "id").collect()}
    assert fused[9] == pytest.approx(0.75 / 69 + 1.25 / 60, abs=1e-9) and fused[20] == pytest.approx(1.25 / 61, abs=1e-9)
    rows = spark.createDataFrame([(i, "p" if i < 6 else "q", 10.0 - i, i) for i in range(8)], "id long, paper string, score double, pos long")
    assert [r["id"] for r in retrieval.capped(rows, "paper", 4, [F.col("pos")]).orderBy("pos").collect()] == [0, 1, 2, 3, 6, 7]
    texts = rows.withColumn("text", F.when(F.col("id") == 3, "heat flow").otherwise("none"))
    assert [r["id"] for r in retrieval.rerank(texts, word_overlap_reranker("heat flow"), head=5).orderBy("pos").collect()] == [3, 0, 1, 2, 4, 5, 6, 7]
    assert retrieval.rerank(texts, None) is texts
    chunks = spark.createDataFrame([(1, "s", 0, "a"), (1, "s", 1, "b"), (1, "s", 3, "d"), (1, "t", 4, "e")], "paper_id long, section string, ord int, text string")
    assert [r["context"] for r in retrieval.expanded(retrieval.neighbours(chunks)).orderBy("ord").collect()] == ["a\nb", "a\nb", "d", "e"]


def test_recall(spark):
    s = lambda rows: spark.createDataFrame(rows, "paper_id long, score double")
    got = retrieval.recall(s([(1, 0.2), (2, 0.5), (3, 0.9)]), s([(2, 0.6), (4, 0.3), (5, 0.31)]), s([(1, 0.0)]), s([(3, 0.0)]), 9, F.col("chunk_score").isNotNull()).collect()
    assert [tuple(r) for r in got] == [(2, 0.6), (1, 0.55), (5, 0.31)]


def test_places(spark):
    text = "x" * 95 + "the exact passage that is looked for stands here in the text" + "y" * 90
    df = spark.createDataFrame([(1, text), (2, "nothing")], "id long, text string")
    assert [r[0] for r in df.orderBy("id").select(locate.find_count(F.col("text"), "XX")).collect()] == [94, 0]
    assert [r[0] for r in df.orderBy("id").select(locate.snippet_place(F.col("text"), F.lit("the exact passage that is looked for stands here"))).collect()] == [96, None]
    got = locate.alike_windows(df, "the exakt passage that was looked for stands here in the text").collect()
    assert len(got) == 1 and 85 <= got[0]["start"] <= 105
    assert [r[0] for r in spark.createDataFrame([("see [1-3, 5] and ［７］",)], "t string").select(locate.markers(F.col("t"))).collect()] == [[1, 3, 5, 7]]


def test_chats(spark):
    none = F.lit(None).cast("timestamp")
    made = spark.createDataFrame([(1, "a"), (2, "b")], "id long, title string").select("id", "title", none.alias("created_at"), none.alias("updated_at"))
    said = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "chat_id long, turn int, text string")
    assert [(r["id"], r["n"]) for r in chats.listed(made, said).collect()] == [(2, 0), (1, 2)]


def test_stream_indexes_each_file_once(spark, tmp_path):
    docs = spark.range(10).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    derive = lambda b: b.selectExpr("doc_id", "length(text) AS n")
    for part in ("doc_id < 4", "doc_id >= 4"):
        docs.where(part).write.mode("append").parquet(source)
        incremental.index_new(incremental.read_new(spark, source, docs.schema), derive, out, state)
    incremental.index_new(incremental.read_new(spark, source, docs.schema), derive, out, state)
    assert sorted(map(tuple, spark.read.parquet(out).select("doc_id", "n").collect())) == sorted(map(tuple, derive(docs).collect()))


def test_stream_lifetime(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES ('a', timestamp '2024-01-01'), ('a', timestamp '2024-01-05'), ('a', timestamp '2024-01-09'), ('b', timestamp '2024-01-02') AS t(k, ts)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = incremental.first_in_lifetime(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "k", "ts")
    q = stream.writeStream.format("memory").queryName("chosen").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["key"], r["at"].day) for r in spark.table("chosen").collect()) == [("a", 1), ("a", 9), ("b", 2)]


def test_stream_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = incremental.windowed_counts(spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001"))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()


def test_upkeep(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    p = df([(1, "Old", "a", None, "", ""), (2, "A Thing of Note", "b", 2020, "V", "A B")], "id long, title string, slug string, year int, venue string, authors string")
    assert [r["id"] for r in upkeep.without_venue(p).collect()] == [1]
    assert [r["id"] for r in upkeep.catalogue(p.withColumn("category", F.lit("c"))).collect()] == [1, 2]
    found = df([(1, "old", "Faculty Opinions", "C D", 1999), (2, "a thing of note", "W", "X", 2021)], "id long, title string, venue string, authors string, year int")
    assert [tuple(r) for r in upkeep.gated_fills(p, found).collect()] == [(1, None, "C D", 1999)]
    titles = df([("a <i>b</i>",), ("Recommendation of b",), ("<b></b>",)], "t string")
    assert [r[0] for r in titles.select(upkeep.clean_title(F.col("t"))).collect()] == ["a b", None, None]
    names = df([([("A", "B"), (None, "C"), ("", "")],)], "a array<struct<given:string,family:string>>")
    assert names.select(upkeep.author_names(F.col("a"))).first()[0] == "A B, C"
    places = df([(1, "u ", ["v", "", None, "u"]), (2, None, None)], "key int, best string, locations array<string>")
    assert [r["url"] for r in upkeep.open_access(places).orderBy("ord").collect()] == ["u", "v", "u"]
    urls = df([("http://x/a.PDF",), ("http://arxiv.org/pdf/1",), ("http://x/a",)], "u string")
    assert [r[0] for r in urls.select(upkeep.direct_pdf(F.col("u"))).collect()] == ["http://x/a.PDF", "http://arxiv.org/pdf/1", None]
    files_ = df([(bytearray(b"x" * 900 + b"%PDF-1"),), (bytearray(b"<html>"),)], "c binary")
    assert [r[0] for r in files_.select(upkeep.is_pdf(F.col("c"))).collect()] == [True, False]


def test_bib_file(spark):
    entry = "@article{%s,\n  title = {T},\n}\n"
    rows = [(0, "A", "a", entry % "a", "official"), (1, "B", "b", "@article{b, title = {", "web"), (2, "C", "a", entry % "a", "local")]
    text, errors = upkeep.bib_file(spark.createDataFrame(rows, "ord int, title string, key string, bibtex string, source string"), "2024-01-02")
    assert [r["text"] for r in text.orderBy("line").collect()] == ["% BibTeX export, 2024-01-02\n% 3 entries, official 1, web 1, local 1", (entry % "a").rstrip(), (entry % "a").rstrip()]
    assert [tuple(r) for r in errors.orderBy("ord").collect()] == [(1, "B: does not parse"), (2, "C: key repeated (a)")]


def test_chat_changes(spark):
    c = spark.createDataFrame([(1, "First Chat", None), (2, "second", None)], "id long, title string, updated_at timestamp")
    assert [r["id"] for r in upkeep.chats_named(c, "CHAT").collect()] == [1]
    said = spark.createDataFrame([(1, ""), (2, "x" * 70)], "id long, title string")
    assert [r["title"] for r in upkeep.chats_renamed(c, said).orderBy("id").collect()] == ["New chat", "x" * 60]
    m = spark.createDataFrame([(2,)], "chat_id long").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    assert [r["updated_at"] is None for r in upkeep.touched(c, m).orderBy("id").collect()] == [True, False]
    marks = spark.createDataFrame([(1, 2, [(1.0, 2.0)], "y" * 600)], "paper_id long, page int, rects array<struct<x:double,y:double>>, text string")
    assert tuple(upkeep.highlighted(marks).first()) == (1, 2, '[{"x":1.0,"y":2.0}]', "y" * 500)


def test_words_for_places(spark):
    df = spark.createDataFrame([("The IGBT+ losses of the igbt+ 热设计 x",)], "t string")
    assert df.select(X.locate_words(F.col("t"))).first()[0] == ["igbt+", "losses", "热设", "设计"]
    assert df.select(X.merged_keywords(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))).first()[0] == ["a", "b", "c"]
    assert df.select(upkeep.with_category(F.lit("t"), F.lit("inbox"))).first()[0] == "【unsorted】t"


def test_marks(spark):
    marks = spark.createDataFrame([(1, 7, 2, [(0.1, 0.2, 0.3, 0.4)], "x" * 600, 2), (2, 7, 1, [], "b", 3), (3, 8, 1, [], "c", 1), (4, 7, 2, [], None, 1)], "id long, paper_id long, page int, rects array<struct<x: double, y: double, w: double, h: double>>, text string, created_at int")
    kept = upkeep.highlighted(marks.select("paper_id", "page", "rects", "text", "id", "created_at"))
    assert max(len(r["text"] or "") for r in kept.collect()) == 500
    stored = marks.withColumn("rects", F.to_json("rects"))
    got = upkeep.marks_of(stored, 7).collect()
    assert [r["id"] for r in got] == [2, 4, 1] and tuple(got[2]["rects"][0]) == (0.1, 0.2, 0.3, 0.4)
    assert sorted(r["id"] for r in upkeep.marks_without(stored, spark.createDataFrame([(2,), (2,), (9,)], "id long")).collect()) == [1, 3, 4]


def test_contexts_and_cards(spark):
    hits = spark.createDataFrame([(1, 0, "a" * 30), (1, 1, None), (1, 2, "b" * 9), (1, 3, "c" * 50), (2, 0, "d")], "n int, pos int, text string")
    for size in (5, 30, 33, 36, 40, 45, 200):
        whole = "\n\n".join(["a" * 30, "", "b" * 9, "c" * 50])
        assert {r["n"]: r["text"] for r in upkeep.paper_contexts(hits, size).collect()} == {1: whole[:size], 2: "d"}
    papers = spark.createDataFrame([(5, "s", "T", "", None, None)], "id long, slug string, title string, venue string, authors string, year int")
    assert [tuple(r) for r in upkeep.source_cards(spark.createDataFrame([(1, 5), (2, 6)], "n int, paper_id long"), papers).collect()] == [(1, "s", "T", 1, None, None, None)]


def test_category_names(spark):
    of = lambda *names: spark.createDataFrame([(n,) for n in names], "category string")
    assert [r["category"] for r in library.category_names(of("b", "Z", "a", "a", None), of("Ä", "A", "", "b")).collect()] == ["a", "A", "Ä", "b", "Z"]
