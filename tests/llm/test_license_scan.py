from finsieve.llm.license_scan import CONTAINED, TEMPLATES, Template, bands_for, plain_words, scan

from helpers import awkward, documents, prose


def test_notices_are_found_wherever_they_stand(spark):
    rows = awkward()
    for n, t in enumerate(TEMPLATES):
        for at in (0, 3, 8, 40):
            text = f"{prose(n, at)} {t.text.upper()} {prose(n + 90, 30)}"
            rows.append((1000 + 10 * n + min(at, 9), text))
    out = scan(documents(spark, rows)).collect()
    found = {(r.doc_id, r.template) for r in out}
    for n in range(len(TEMPLATES)):
        for at in (0, 3, 8, 9):
            assert (1000 + 10 * n + at, n) in found
    assert not any(i in {r[0] for r in awkward()} for i, _ in found)
    assert all(CONTAINED <= r.containment <= 1 for r in out)


def test_most_of_a_long_notice_is_enough_and_half_is_not(spark):
    words = TEMPLATES[8].text.split()
    rows = [(1, " ".join(words[:-3])), (2, " ".join(words[: len(words) // 2])), (2, "x"), (3, " ".join(words[::-1]))]
    out = scan(documents(spark, rows)).collect()
    assert {(r.doc_id, r.template) for r in out} == {(1, 8)}


def test_bands_repeated_rows_own_templates_and_empty_tables(spark):
    assert bands_for(5) > bands_for(8)
    text = "do not copy this very short text please"
    rows = [(1, text), (1, text), (None, text)]
    out = scan(documents(spark, rows), [Template("own", text), Template("short", "too short")]).collect()
    assert {(r.doc_id, r.license, r.containment) for r in out} == {(1, "own", 1.0), (None, "own", 1.0)}
    assert scan(documents(spark, [])).count() == 0
    assert plain_words("CC BY-NC 4.0.") == ["cc", "by", "nc", "4", "0"]
