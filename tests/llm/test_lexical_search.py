"""Lexical search against scoring every document for every item."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, documents, prose

from finsieve.llm import lexical_search as L


def plain_terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def replay(docs, items, k=10):
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        rows = []
        for doc_id, b in bags:
            n = sum(b.values())
            m = 25 + (75 * n * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m))
                for t in plain_terms(text) if b[t]
            )
            if score > 0:
                rows.append((-score, doc_id is None, doc_id, doc_id))
        rows.sort(key=lambda r: r[:2] + (r[2] or 0,))
        out += [(item, rank, r[3], -r[0]) for rank, r in enumerate(rows[:k], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("options", [{}, {"block_bytes": 200, "task_docs": 40}])
def test_equals_brute_force(spark, options):
    rows = awkward() + [(1000 + i, prose(i, 5 + 7 * (i % 40), 150)) for i in range(250)]
    # A third of the rows are copies of one text; they tie.
    rows += [(5000 + i, prose(77, 60, 150)) for i in range(130)]
    items = [(i, prose(i, 25, 150)) for i in range(12)]
    items += [(20, prose(77, 60, 150)), (21, "w1 w1 w1 W2 w3"), (22, "nowhere"), (23, ""), (24, None), (25, "Über")]
    queries = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS rank", "'x' AS score")
    assert found(L.search(documents(spark, rows), queries, **options)) == replay(rows, items)


def test_nothing_to_find(spark):
    schema = "item_id long, text string"
    none, one = spark.createDataFrame([], schema), spark.createDataFrame([(1, "w1")], schema)
    assert found(L.search(documents(spark, [(1, "w1")]), none)) == []
    assert found(L.search(documents(spark, []), one)) == []
    assert found(L.search(documents(spark, [(1, None), (2, "...")]), one)) == []


def test_same_item_id_and_null_id(spark):
    queries = spark.createDataFrame([(1, "w1"), (1, "w0"), (None, "w1")], "item_id long, text string")
    docs = documents(spark, [(7, "w0 x"), (8, "w1 x"), (9, "y z"), (8, "w1 x")])
    got = L.search(docs, queries).select("item_id", "rank", "doc_id").collect()
    assert sorted(map(tuple, got), key=str) == [(1, 1, 7), (None, 1, 8), (None, 2, 8)]


def test_bounds_never_lose_a_document():
    rng = np.random.default_rng(3)
    weights = rng.integers(1, 9000, 60)
    roots = np.sqrt(weights.astype(float))
    sizes = rng.integers(1, 20, 300)
    flat = np.concatenate([rng.choice(60, s, replace=False) for s in sizes])
    tfs, m = rng.integers(1, 6, len(flat)), rng.integers(26, 400, 300)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    p = L._impacts(flat, tfs, np.repeat(m, sizes), weights) / roots[flat]
    norms = np.sqrt(L._sums(p * p, starts))
    bucket = L.Bucket(list(range(300)), m, norms, flat, tfs, starts, weights, roots)
    for size in (1, 5, 30):
        columns = rng.choice(60, size, replace=False)
        counts = rng.integers(1, 4, size)
        dense = np.zeros(60, np.int64)
        dense[columns] = counts
        scores = bucket.exact(np.arange(300), dense)
        q = counts * roots[columns]
        order = np.argsort(-q)
        for take in {1, (size + 1) // 2, size}:
            focus, rest = order[:take], order[take:]
            for least in np.quantile(scores, [0.5, 0.9, 1.0]):
                kept = bucket.reaching(columns[focus], q[focus], math.sqrt((q[rest] ** 2).sum()), max(1.0, least))
                assert set(np.flatnonzero(scores >= max(1.0, least))) <= set(kept.tolist())
