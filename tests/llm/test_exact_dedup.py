import re
from collections import defaultdict

from finsieve.llm.exact_dedup import DigestIndex, deduplicate, keep_first, new_index

from helpers import awkward, documents, prose


def by_text(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return groups


def test_every_row_is_decided_and_one_of_each_text_stays(spark):
    rows = awkward()
    out = deduplicate(documents(spark, rows), new_index(spark)).collect()
    groups = by_text(rows)
    assert len(out) == len(rows)
    assert sum(r.kept for r in out) == len(groups)
    smallest = {min((i for i in g if i is not None), default=None): len(g) for g in groups.values()}
    assert {(r.keep_id, r.group_size) for r in out} == set(smallest.items())
    assert all(r.keep_id == r.doc_id for r in out if r.kept)


def test_later_batches_meet_the_index(spark, tmp_path):
    path = str(tmp_path / "index")
    index = DigestIndex(spark, path, buckets=4)
    first = documents(spark, [(1, "a b"), (2, "c")])
    assert {r.doc_id: r.kept for r in deduplicate(first, index).collect()} == {1: True, 2: True}
    again = DigestIndex(spark, path, buckets=4)
    second = documents(spark, [(0, "a  b"), (3, "d"), (4, "d")])
    out = {r.doc_id: (r.keep_id, r.kept) for r in deduplicate(second, again).collect()}
    assert out == {0: (1, False), 3: (3, True), 4: (3, False)}
    # The same batch once more, as after a crash: the same answers, and no more digests.
    assert {r.doc_id: (r.keep_id, r.kept) for r in deduplicate(second, again).collect()} == out
    assert again.read().count() == 3
    plan = again.read().join(first.selectExpr("unhex(text) AS digest").hint("merge"), "digest", "left_anti")
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_stage_keeps_columns_and_one_row_each(spark):
    docs = documents(spark, awkward())
    kept = keep_first(docs, new_index(spark))
    assert kept.columns == docs.columns
    assert kept.count() == len(by_text(awkward()))


def test_empty_table_and_a_hot_text(spark):
    assert deduplicate(documents(spark, []), new_index(spark)).count() == 0
    assert keep_first(documents(spark, []), new_index(spark)).count() == 0
    rows = [(i, "the same") for i in range(500)] + [(1000 + i, prose(i, 9)) for i in range(300)]
    out = deduplicate(documents(spark, rows), new_index(spark)).collect()
    assert sum(r.kept for r in out) == 301
    assert {r.group_size for r in out if r.keep_id == 0} == {500}
