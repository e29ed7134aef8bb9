from collections import Counter

from tests.llm.plain import EDGES, blank_words, docs_of

from lectern.llm.quality_rules import QualityRules, quality_rules


def plain(text):
    w = blank_words(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    repeated = {i + j for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if blank_words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def test_counts(spark):
    texts = [*EDGES, "a b c a b c d e f", "a a a a", "x y", "l1\nl1\n l1\n\n\nl1", " ".join(str(i % 100) for i in range(900)), " ".join(f"{i % 211} {i % 7}" for i in range(2000))]
    got = {r["doc_id"]: r for r in quality_rules(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain(t), repr((t or "")[:30])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


GOOD = " ".join(f"word{i}" for i in range(60)) + "."


def test_lines(spark):
    menu = "Home | News | About | Contact | Help"
    texts = [GOOD, f"{GOOD}\n{menu}\nAll rights reserved.", "\n".join(f"{menu}{i}" for i in range(90)), GOOD[:-1]]
    got = {r["doc_id"]: r for r in quality_rules(docs_of(spark, texts)).collect()}
    assert [got[i]["kept"] for i in range(4)] == [True, True, False, False]
    assert got[1]["line_faults"] == ["navigation", "boilerplate"] and got[1]["cleaned_text"] == GOOD
    assert got[3]["line_faults"] == ["unfinished"]


def test_shape(spark):
    docs = docs_of(spark, [GOOD, GOOD]).withColumnRenamed("lang", "kept")
    out = quality_rules(docs)
    assert out.where("kept").count() == 2 and out.columns.count("kept") == 1
    assert quality_rules(docs.limit(0)).count() == 0
    assert quality_rules(spark.createDataFrame([(None, None, 1)], "doc_id long, text string, n_words int")).first()["n_words"] == 0


def test_phrases_of_all_languages(spark):
    lines = ["Alle Rechte vorbehalten.", "TOUS DROITS RÉSERVÉS.", "Lea el Aviso legal.", "Copyright (c) 2020.", "Copyright c 2020.", "Condiciones de uso: all."]
    faults = lambda p: quality_rules(docs_of(spark, [f"{GOOD}\n{x}" for x in lines]), p).orderBy("doc_id").collect()
    assert [r["line_faults"] for r in faults(QualityRules())] == [["boilerplate"]] * 4 + [[], ["boilerplate"]]
    assert [r["line_faults"] for r in faults(QualityRules(boilerplate=("c 2020",)))] == [[], [], [], [], ["boilerplate"], []]
    assert not any(r["line_faults"] for r in faults(QualityRules(boilerplate=())))


def test_results_are_computed_once(spark):
    """A filter on a result stays above the row's arrays."""
    plan = quality_rules(docs_of(spark, [GOOD])).where("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert "monotonically" not in plan and plan.index("Filter") < plan.index("Generate")
