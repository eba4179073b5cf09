import re

from pyspark.sql import functions as F

from finsieve.llm.quality_rules import RULES, Rule, judge

from helpers import awkward, documents, prose, words


def expected(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    spots = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)} if len(w) < 2000 else None
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)), None if spots is None else len(spots),
    )


def test_measures_are_those_of_brute_force(spark):
    line = prose(5, 12)
    rows = awkward() + [(30, f"{line}\n{line}\n \nx"), (31, "a b c d e f a b c d e"), (32, "a b a b a b a b"), (33, "\n\n")]
    rows = [(n, t) for n, (_, t) in enumerate(rows)]
    for r in judge(documents(spark, rows)).collect():
        m, want = r.measures, expected(rows[r.doc_id][1])
        got = (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words)
        assert got[:4] == want[:4]
        if want[4] is not None:
            assert got[4] == want[4], rows[r.doc_id][1]
            assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_rules_and_their_table(spark):
    good = "the cat of the house and the dog in it " * 1 + prose(8, 70, 5000) + " the of and in"
    rows = [(1, good), (2, good.replace(" ", "### ")), (3, prose(9, 100, 5000)), (4, "x" * 20)]
    out = {r.doc_id: r for r in judge(documents(spark, rows)).collect()}
    assert out[1].kept and not out[1].broken_rules
    assert "symbols" in out[2].broken_rules and not out[2].kept
    assert out[3].broken_rules == ["stop_words"]
    assert out[4].base_failed
    none = judge(documents(spark, rows), rules=()).where("size(broken_rules) = 0").count()
    assert none == 4
    strict = judge(documents(spark, rows), rules=[*RULES, Rule("few", "n_words", most=5)])
    assert strict.where("array_contains(broken_rules, 'few')").count() == 3


def test_empty_table_and_no_python_in_the_plan(spark):
    empty = judge(documents(spark, []))
    assert empty.count() == 0
    plan = empty._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_columns_with_the_names_of_helpers_stay(spark):
    docs = documents(spark, [(1, "a b"), (2, None)])
    for name in ("words_", "_words_", "lines_", "_words", "_lines"):
        docs = docs.withColumn(name, F.lit(name))
    out = judge(docs)
    assert set(out.columns) - set(docs.columns) == {"measures", "broken_rules", "base_failed"}
    for r in out.collect():
        assert [r[n] for n in ("words_", "_words_", "lines_", "_words", "_lines", "words")] == [
            "words_", "_words_", "lines_", "_words", "_lines", None,
        ]
