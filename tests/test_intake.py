"""What a model says about files, records of two services, notes, versions, memos, paced questions, jumps."""

import json
import re
import time

import pytest
from pyspark.sql import functions as F

from lectern.functions.text import norm_title
from lectern.operators import intake, locate
from lectern.sources import versions
from lectern.streaming import lookups

ITEMS = "ord int, path string, category string, title string, authors string, year int, venue string"


def test_answers(spark):
    said = {
        "fenced": '```json\n{"title": "T", "category_slug": "A B"}\n```', "plain": '{"title": "T", "authors": "X, Y", "year": 2024, "venue": "V", "category_slug": "ts/x", "paper_slug": "2024-short"}', "year": '{"title": "T", "year": "2019b", "category_slug": "c"}',
        "no year": '{"title": "T", "year": "n.d.", "category_slug": "c"}', "no title": '{"title": "", "category_slug": "c"}', "no category": '{"title": "T"}', "broken": '{"title": "T", "category_slug"', "none": None, "empty": "", "words": "I can't say",
    }
    got = {r["path"]: r["said"] for r in intake.read_answers(spark.createDataFrame(list(said.items()), "path string, out string")).collect()}
    assert {k for k, v in got.items() if v} == {"fenced", "plain", "year", "no year"}
    assert tuple(got["plain"]) == ("T", "X, Y", 2024, "V", "ts-x", "2024-short") and tuple(got["fenced"]) == ("T", "", None, "", "a-b", "")
    assert (got["year"]["year"], got["no year"]["year"]) == (2019, None)


def test_precedence(spark):
    """What is given holds over the model, the model over the file's name; a chosen category over the model's."""
    good = json.dumps({"title": "By Model", "authors": "M", "year": 2001, "venue": "MV", "category_slug": "area"})
    items = [
        (1, "/a/2010 Name.pdf", "", None, None, None, None), (2, "/a/two.pdf", "", None, None, None, None), (3, "/a/three.pdf", "area", None, None, None, None), (4, "/a/four.pdf", "Other", None, None, None, None),
        (5, "/a/five.pdf", "inbox", None, None, None, None), (6, "/a/six.pdf", "", "Given", "G", 1990, "GV"), (7, "/A/TWO.pdf", "x", None, None, None, None), (8, "/a/1999.pdf", "", "Given", None, None, None), (9, "/a/nine.pdf", "", "Given", "G", 1990, None),
    ]
    answers = [(f"/a/{n}.pdf", good) for n in ("two", "three", "four", "five", "six")] + [("/a/2010 Name.pdf", "no JSON")]
    plan = intake.import_plan(spark.createDataFrame(items, ITEMS), spark.createDataFrame(answers, "path string, out string"), spark.createDataFrame([("inbox", "1999-given")], "category string, slug string"))
    got = {r["path"][3:]: tuple(r)[1:] for r in plan.collect()}
    assert got == {
        "2010 Name.pdf": ("2010 Name", "", 2010, "", "inbox", "2010-name", False), "two.pdf": ("By Model", "M", 2001, "MV", "area", "2001-by-model", True), "three.pdf": ("By Model", "M", 2001, "MV", "area", "2001-by-model-2", True),
        "four.pdf": ("By Model", "M", 2001, "MV", "Other", "2001-by-model", False), "five.pdf": ("By Model", "M", 2001, "MV", "inbox", "2001-by-model", False), "six.pdf": ("Given", "G", 1990, "GV", "inbox", "1990-given", True),
        "1999.pdf": ("Given", "", 1999, "", "inbox", "1999-given-2", True), "nine.pdf": ("Given", "G", 1990, "", "inbox", "1990-given-2", True),
    }
    assert intake.import_plan(spark.createDataFrame([], ITEMS), spark.createDataFrame([], "path string, out string")).count() == 0


def test_equal_paths_have_answers_of_their_own(spark):
    good = lambda t: json.dumps({"title": t, "category_slug": "c"})
    files = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "ord int, path string")
    answers = spark.createDataFrame([(1, "p", "no JSON"), (2, "p", good("Two")), (3, "q", "")], "ord int, path string, out string")
    got = sorted(map(tuple, intake.import_preview(files, answers, "ord").collect()))
    assert got == [("p", False, "inbox", None), ("p", True, "c", "Two"), ("q", False, "inbox", None)]


def test_useless_answers_of_a_path_count_for_nothing(spark):
    items = spark.createDataFrame([(1, "/p.pdf", "", None, None, None, None), (2, "/q.pdf", "", None, None, None, None)], ITEMS)
    answers = [("/p.pdf", "no JSON"), ("/p.pdf", json.dumps({"title": "T", "category_slug": "c"})), ("/q.pdf", ""), ("/q.pdf", None)]
    got = sorted(intake.import_plan(items, spark.createDataFrame(answers, "path string, out string")).select("path", "title", "slug", "classified").collect())
    assert list(map(tuple, got)) == [("/p.pdf", "T", "t", True), ("/q.pdf", "q", "q", False)]


def test_files_of_a_path_are_told_apart(spark, tmp_path):
    listing = lambda rows: spark.createDataFrame(rows, "path string, n int, mtime int, text string")
    derive = lambda run: lambda due: due.select("path", "n", F.lit(run).alias("run"), F.length("text").alias("size"))
    key = ["path", "n"]
    versions.memoised(spark, str(tmp_path / "m"), listing([("a", 1, 1, "x"), ("a", 2, 1, "yy"), ("b", 3, 1, "")]), derive("first"), key=key)
    got = versions.memoised(spark, str(tmp_path / "m"), listing([("a", 2, 1, "yy"), ("b", 3, 2, "zzz")]), derive("second"), key=key)
    assert sorted(map(tuple, got.select("path", "n", "mtime", "run", "size").collect())) == [("a", 2, 1, "first", 2), ("b", 3, 2, "second", 3)]


def test_merged_lookup(spark):
    record = "key string, ord int, doi string, cited_by int, title string"
    first = spark.createDataFrame([("a", 0, "10.1/A", None, "A"), ("a", 1, "10.1/other", 1, "later"), ("b", 0, "", 3, "B"), ("e", 0, "10.1/e", 5, "E")], record)
    second = spark.createDataFrame([("a", 0, "", 9, "never"), ("c", 0, "10.1/a", None, "C")], record)
    places = spark.createDataFrame([("10.1/a", 0, "http://x/1"), ("10.1/A", 1, "HTTP://X/1"), ("10.1/a", 2, "ftp://no"), ("10.1/e", 0, "")], "doi string, ord int, url string")
    cited = spark.createDataFrame([("10.1/a", 7, "http://y/z.pdf"), ("10.1/a", None, None), ("10.1/e", 8, None)], "doi string, cited_by int, url string")
    got = {r["key"]: tuple(r)[1:] for r in intake.merged_lookup(spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("a",), ("e",), (None,)], "key string"), first, second, places, cited).collect()}
    assert got == {"a": ("first", "10.1/A", 7, "A", ["http://x/1", "http://y/z.pdf"]), "b": ("first", "", 3, "B", []), "c": ("second", "10.1/a", None, "C", []), "e": ("first", "10.1/e", 5, "E", [])}


NOTES = [None, "", "# only text\n- **发表:** old", "---\ntitle: a\n---", "---\ntitle: a\ntags: [x]\nyear: 3\ntitle: b\n---\nbody\n---\nmore", "---\nno end\ntitle: x", "---\nvenue: \"v\"\n---\n\n- **发表:** (?)\n- **发表:** 2", "---\r\ntitle: a\r\n---\r\n", "---\n---\nx"]


def plain_note(raw, title, authors, year, venue, touched):
    q = lambda s: (s or "").replace('"', "'")
    values = [("title", q(title)), ("authors", q(authors)), ("year", "null" if year is None else str(year)), ("venue", q(venue))]
    m = re.match(r"---\n(.*?)\n---(?=\n|$)", raw or "", re.S)
    if m:
        lines = m[1].split("\n")
        for k, v in values:
            at = next((i for i, x in enumerate(lines) if x.startswith(f"{k}:")), None)
            if at is None:
                lines.append(f'{k}: "{v}"')
            else:
                lines[at] = f'{k}: "{v}"'
        out = "---\n" + "\n".join(lines) + "\n---" + raw[m.end() :]
    else:
        out = "---\n" + "".join(f"{k}: {v}\n" if k == "year" else f'{k}: "{v}"\n' for k, v in values) + f"---\n\n# {title or ''}\n"
    if touched:
        lines = out.split("\n")
        at = next((i for i, x in enumerate(lines) if x.startswith("- **发表:** ")), None)
        if at is not None:
            lines[at] = "- **发表:** " + " · ".join(str(x) for x in (venue or None, year) if x is not None)
            out = "\n".join(lines)
    return out


@pytest.mark.parametrize("known", [('A "b" $1 \\2', "X, Y", 2020, "V & W", True), (None, None, None, "", True), ("T", "", 1999, None, False)])
def test_notes(spark, known):
    title, authors, year, venue, touched = known
    lit = lambda v, t="string": F.lit(v).cast(t)
    note = lambda c: intake.note_rewritten(c, lit(title), lit(authors), lit(year, "int"), lit(venue), lit(touched, "boolean"))
    df = spark.createDataFrame(list(enumerate(NOTES)), "i int, raw string").orderBy("i")
    once = [r[0] for r in df.select(note(F.col("raw"))).collect()]
    assert once == [plain_note(raw, *known) for raw in NOTES]
    again = spark.createDataFrame(list(enumerate(once)), "i int, raw string").orderBy("i")
    twice = [r[0] for r in again.select(note(F.col("raw"))).collect()]
    assert [b for a, b, raw in zip(once, twice, NOTES) if (raw or "").startswith("---\n") and re.match(r"---\n.*?\n---(\n|$)", raw, re.S)] == [a for a, raw in zip(once, NOTES) if (raw or "").startswith("---\n") and re.match(r"---\n.*?\n---(\n|$)", raw, re.S)]


def test_note_paths(spark):
    files = ["/l/a/paper.pdf", "/l/b/paper.pdf", "/l/c/x.y.pdf", "/l/d/z.pdf", "/l/d/PAPER.pdf"]
    there = ["/l/b/paper.md", "/l/d/d.md"]
    got = {r["path"]: r["note"] for r in intake.note_paths(spark.createDataFrame([(f,) for f in files], "path string"), spark.createDataFrame([(f,) for f in there], "path string")).collect()}
    assert got == dict(zip(files, ["/l/a/a.md", "/l/b/paper.md", "/l/c/x.y.md", "/l/d/d.md", "/l/d/d.md"]))


def test_versions(spark, tmp_path):
    root, of = f"{tmp_path}/v", lambda n: {"t": spark.range(n), "u": spark.range(1)}
    assert versions.manifest(spark, root) is None
    with pytest.raises(FileNotFoundError):
        versions.current(spark, root, "t")
    built = []
    build = lambda n: lambda: built.append(n) or of(n)
    assert versions.rebuilt(spark, root, {"dim": "64"}, build(3)) and not versions.rebuilt(spark, root, {"dim": "64"}, build(4)) and built == [3]
    old = versions.current(spark, root, "t")
    with pytest.raises(Exception, match="cancelled"):
        versions.publish(spark, root, {"t": spark.range(9), "u": spark.range(5).select(F.raise_error(F.lit("cancelled")).cast("int").alias("x"))})
    assert versions.current(spark, root, "t").count() == 3 and versions.manifest(spark, root)["stamp"] == {"dim": "64"}
    assert versions.rebuilt(spark, root, {"dim": "128"}, build(7)) and versions.current(spark, root, "t").count() == 7
    assert old.count() == 3  # a reader of the old version goes on
    assert versions.clear_old(spark, root) == 2 and versions.current(spark, root, "t").count() == 7 and versions.clear_old(spark, root) == 0


def test_two_runs_publish_at_once(spark, tmp_path, monkeypatch):
    """The one that comes second fails, and what the first wrote holds."""
    root = f"{tmp_path}/v"
    versions.publish(spark, root, {"t": spark.range(1)})
    seen = versions._manifests(spark, root)
    versions.publish(spark, root, {"t": spark.range(2)})
    monkeypatch.setattr(versions, "_manifests", lambda *_: seen)
    with pytest.raises(RuntimeError):
        versions.publish(spark, root, {"t": spark.range(3)})
    monkeypatch.undo()
    assert versions.current(spark, root, "t").count() == 2


def test_memo(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def derive(due):
        def run(batches):
            for b in batches:
                asked.add(len(b))
                yield b[["path"]].assign(size=b["body"].str.len())

        return due.mapInPandas(run, "path string, size long")

    listing = lambda rows: spark.createDataFrame(rows, "path string, mtime int, body string")
    of = lambda df: sorted((r["path"], r["mtime"], r["size"]) for r in df.collect())
    root = f"{tmp_path}/m"
    assert of(versions.memoised(spark, root, listing([("a", 1, "x"), ("b", 1, "xx"), ("c", 1, "")]), derive)) == [("a", 1, 1), ("b", 1, 2), ("c", 1, 0)] and asked.value == 3
    assert of(versions.memoised(spark, root, listing([("a", 1, "ignored, as it is unchanged"), ("b", 2, "xxxx"), ("d", 1, "y"), ("d", 2, "yy")]), derive)) == [("a", 1, 1), ("b", 2, 4), ("d", 2, 2)] and asked.value == 5
    assert of(versions.memoised(spark, root, listing([("a", 1, ""), ("b", 2, ""), ("d", 2, "")]), derive)) == [("a", 1, 1), ("b", 2, 4), ("d", 2, 2)] and asked.value == 5
    assert of(versions.memoised(spark, root, listing([]), derive)) == []


def failing(row):
    if row["n"] % 3 == 1:
        raise KeyError(row["n"])
    return None if row["n"] % 3 == 2 else {"twice": row["n"] * 2}


def test_paced(spark):
    rows = spark.range(6).withColumnRenamed("id", "n")
    began = time.monotonic()
    got = {r["n"]: (r["twice"], r["error"]) for r in lookups.paced(rows, failing, "twice bigint", gap=0.1, lanes=1).collect()}
    assert time.monotonic() - began > 0.5
    assert got == {0: (0, None), 1: (None, "KeyError: 1"), 2: (None, None), 3: (6, None), 4: (None, "KeyError: 4"), 5: (None, None)}
    assert lookups.paced(rows.limit(0), failing, "twice bigint", gap=0).count() == 0


def test_lookups_go_on_after_failures(spark, tmp_path):
    src, out, at = (f"{tmp_path}/{x}" for x in ("src", "out", "at"))
    put = lambda a, b: spark.range(a, b).withColumnRenamed("id", "n").write.mode("append").parquet(src)
    go = lambda f: lookups.run_lookups(spark.readStream.schema("n bigint").parquet(src), f, "twice bigint", out, at, gap=0)
    put(0, 6)
    go(failing)
    go(failing)  # nothing new
    assert sorted(r["n"] for r in lookups.answered(spark, out).collect()) == [0, 2, 3, 5]
    assert sorted((r["n"], r["error"]) for r in lookups.failed(spark, out, "n").collect()) == [(1, "KeyError: 1"), (4, "KeyError: 4")]
    lookups.failed(spark, out, "n").select("n").where("n = 1").write.mode("append").parquet(src)
    put(6, 8)
    go(lambda row: {"twice": 0})
    assert sorted(r["n"] for r in lookups.answered(spark, out).collect()) == [0, 1, 2, 3, 5, 6, 7]
    assert [r["n"] for r in lookups.failed(spark, out, "n").collect()] == [4]


def test_jumps(spark):
    said = "The converter's junction temperature rises with the load, as the measured curves in this section show for all devices."
    pages = [(1, 1, "front " * 60), (1, 2, f"{'x ' * 200}{said}{' y' * 200}"), (1, 3, "thermal model, junction and load " * 9), (2, 1, None), (3, 1, "only page with thermal load")]
    asks = [
        (1, 1, 2, said, ["thermal"]), (2, 1, 2, said.replace("rises", "risen").replace("show", "shows").replace("devices", "device") + " Also", None), (3, 1, 2, "nothing of the kind is said anywhere in it, nor alike", ["Thermal", "junction", "zzz"]), (4, 1, 1, None, ["thermal", "junction"]),
        (5, 1, 99, "", []), (6, 2, 1, said, ["a", "b"]), (7, 9, 1, said, ["a"]), (8, 3, -4, None, ["thermal", "load"]), (9, 1, 2, "short", None),
    ]
    got = {r["ask_id"]: (r["page"], r["how"], r["start"]) for r in locate.jumps(spark.createDataFrame(pages, "doc_id long, page int, text string"), spark.createDataFrame(asks, "ask_id long, doc_id long, page int, snippet string, words array<string>")).collect()}
    assert {k: v[:2] for k, v in got.items()} == {1: (2, "exact"), 2: (2, "alike"), 3: (3, "words"), 4: (1, "top"), 5: (3, "top"), 6: (1, "top"), 8: (1, "words"), 9: (2, "top")}
    norm = spark.createDataFrame([(pages[1][2],)], "t string").select(norm_title(F.col("t"))).first()[0]
    assert norm[got[1][2] :].startswith("theconvertersjunction") and abs(got[2][2] - got[1][2]) <= 10
