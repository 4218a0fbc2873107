import pytest
from cases import collected, documents, empty, rows, words

from latebound.llm.quality import RULES, SYMBOLS, Rule, passing_documents, quality_rules


def plain(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    covered = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_counts_equal_the_plain_ones(spark):
    docs = documents(spark)
    extra = ["a # b\n$ % & | < >\n" * 3, "same line here\nother\nsame line here\n same line here", "\n\n \n", "q " * 50,
             "one two three four five six seven eight nine " * 2]
    more = spark.createDataFrame([(1000 + i, t, "x") for i, t in enumerate(extra)], "doc_id long, text string, n_words string")
    for df, want in ((docs, {(r[0], *plain(r[1])) for r in rows()}), (more, {(1000 + i, *plain(t)) for i, t in enumerate(extra)})):
        out = quality_rules(df)
        assert {tuple(r) for r in out.select("doc_id", *COUNTS).collect()} == want
        assert out.count() == df.count()


def test_base_rule_and_table(spark):
    out = {r["doc_id"]: r for r in quality_rules(documents(spark)).collect()}
    for ident, text, *_ in rows():
        n, _, _, _, rep = plain(text)
        assert out[ident]["base_failed"] == (n < 20 or 100 * rep > 30 * n)
        assert not (out[ident]["kept"] and out[ident]["base_failed"])
    flags = [f"ok_{r.name}" for r in RULES]
    assert all(r["kept"] == (not r["base_failed"] and all(r[f] for f in flags)) for r in out.values())


def test_own_table(spark):
    rules = (Rule("short", "word_chars / nullif(n_words, 0)", None, 3.0),)
    df = spark.createDataFrame([(1, "aa " * 21 + " ".join(f"b{i}" for i in range(9)), "n"), (2, " ".join(f"word{i}" for i in range(40)), "n")],
                               "doc_id long, text string, kept string")
    got = {r["doc_id"]: (r["ok_short"], r["kept"]) for r in quality_rules(df, rules=rules).collect()}
    assert got[2] == (False, False)


def test_no_user_functions_and_no_shuffle(spark):
    plan = quality_rules(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and plan.count("Exchange") == 1  # the fixture's own


def good(n, k, lang="en"):
    glue = {"en": ["the", "of", "and"], "pl": ["jest", "nie", "się"], None: ["xx", "yy", "zz"]}[lang]
    return "\n".join(" ".join(f"{glue[(i + j) % 3]} word{k}x{i}y{j}" for j in range(4)) for i in range(n))


def mixed(spark):
    """Documents that are kept and that are not, many of them with repeated windows."""
    out = [(i, good(6 + i, i), "en", "n") for i in range(8)]
    out += [(100 + i, good(6 + i, i, "pl"), "pl", "n") for i in range(4)] + [(150, good(9, 1, None), None, "n"), (151, good(9, 1, None), "EN-gb", "n")]
    out += [(200 + i, f"one two three four five six seven eight nine {i} " * n, "en", "n") for i, n in enumerate((2, 4, 40, 400))]
    out += [(300, good(40, 9) + "\n" + good(40, 9)[:180] + "\n" + good(40, 10), "en", "n")]
    return spark.createDataFrame(out, "doc_id long, text string, lang string, kept string").repartition(2)


def test_result_can_be_filtered_counted_and_joined(spark):
    docs = mixed(spark)
    judged = quality_rules(docs)
    want = {r["doc_id"]: r for r in judged.collect()}
    kept = {i for i, r in want.items() if r["kept"]}
    assert kept == {*range(8), *range(100, 104), 150, 300} and want[300]["n_repeat_words"] > 8
    assert {r["doc_id"] for r in judged.filter("kept").collect()} == kept
    assert judged.filter("kept").count() == len(kept) and judged.filter("not kept").count() == len(want) - len(kept)
    assert judged.filter("n_repeat_words > 0").count() == sum(r["n_repeat_words"] > 0 for r in want.values())
    assert judged.filter("ok_stop_word_share and not base_failed").count() == len(kept)
    assert docs.join(judged.filter("kept").select("doc_id"), "doc_id", "left_semi").count() == len(kept)
    assert judged.groupBy("kept").count().count() == 2
    assert sorted(map(tuple, passing_documents(docs).collect())) == sorted(
        (tuple(r) for r in docs.collect() if r["doc_id"] in kept))


def test_stop_words_by_language(spark):
    got = {r["doc_id"]: r["n_stop_words"] for r in quality_rules(mixed(spark)).collect()}
    assert got[0] == 24 and got[100] is None and got[150] is None and got[151] == 0
    assert all(r["n_stop_words"] is None for r in quality_rules(mixed(spark).drop("lang")).collect())


@pytest.mark.parametrize("make", [documents, empty])
def test_passing_documents(spark, make):
    docs = make(spark)
    kept = passing_documents(docs)
    assert kept.columns == docs.columns
    want = [r["doc_id"] for r in quality_rules(docs).filter("kept").select("doc_id").collect()] if docs.count() else []
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    assert collected(kept) == collected(docs.join(kept.select("doc_id").distinct(), "doc_id", "left_semi").select(*docs.columns))
