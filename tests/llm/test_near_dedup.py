import random
from itertools import combinations

import numpy as np
import pytest

from finsieve.llm.common import keyed
from finsieve.llm.near_dedup import (
    REGISTERS,
    _shingle_rows,
    keep_one_of_each,
    near_duplicates,
    rare_pairs,
    shingles_of,
    signatures,
    similarity,
)

from helpers import awkward, components, documents, prose, words


def counted(text):
    w = [x.encode() for x in words(text)]
    _, h, c = shingles_of([w])
    return h, c


def brute_similarity(a, b):
    """Probability Jaccard by its definition, over dictionaries shingle -> count."""
    total = 0.0
    for d in a.keys() & b.keys():
        total += 1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys())
    return total


def test_exact_similarity_is_its_definition():
    for seed in range(6):
        rng = random.Random(seed)
        text = [f"w{rng.randrange(6)}" for _ in range(60)]
        other = text[:40] + [f"w{rng.randrange(6)}" for _ in range(25)]
        (ha, ca), (hb, cb) = counted(" ".join(text)), counted(" ".join(other))
        weighted, plain = similarity(ha, ca, hb, cb)
        a, b = dict(zip(ha.tolist(), ca.tolist())), dict(zip(hb.tolist(), cb.tolist()))
        assert weighted == pytest.approx(brute_similarity(a, b))
        assert plain == pytest.approx(len(a.keys() & b.keys()) / len(a.keys() | b.keys()))


def test_signatures_estimate_the_weighted_similarity():
    rng = random.Random(7)
    text = [f"w{rng.randrange(5)}" for _ in range(150)]
    texts = [" ".join(text), " ".join(text[:110] + [f"w{rng.randrange(5)}" for _ in range(40)]), "a b"]
    bags = [[x.encode() for x in words(t)] for t in texts]
    owner, h, c = shingles_of(bags)
    signed = signatures(owner, h, c, 3)
    assert signed.shape == (3, REGISTERS)
    (ha, ca), (hb, cb) = counted(texts[0]), counted(texts[1])
    share = (signed[0] == signed[1]).mean()
    assert share == pytest.approx(similarity(ha, ca, hb, cb)[0], abs=0.13)
    alone = signatures(*shingles_of(bags[1:2]), 1)
    assert np.array_equal(alone[0], signed[1])


def near_corpus():
    rows = awkward()
    for g in range(12):
        base = prose(50 + g, 150, 5000).split()
        for k in range(6):
            rng = random.Random(g * 100 + k)
            copy = list(base)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = f"edit{g}x{k}"
            rows.append((1000 + 10 * g + k, " ".join(copy)))
    return rows


def test_classes_are_those_of_brute_force(spark):
    rows = near_corpus()
    docs, key = keyed(documents(spark, rows))
    out = near_duplicates(docs, key).collect()
    assert len(out) == len(rows)
    texts = [t for _, t in rows]
    sets = [counted(t) for t in texts]
    bags = [tuple(words(t)) for t in texts]
    pairs = [
        (a, b) for a, b in combinations(range(len(rows)), 2)
        if bags[a] == bags[b] or max(similarity(*sets[a], *sets[b])) >= 0.8
    ]
    groups = components(pairs, range(len(rows)))
    want = sorted(
        (min((rows[n][0] for n in g if rows[n][0] is not None), default=-1), len(g))
        for g in {tuple(g) for g in groups.values()}
    )
    assert sorted((-1 if r.class_id is None else r.class_id, r.class_size) for r in out if r.kept) == want
    assert all(r.class_id == r.doc_id for r in out if r.kept)


def test_links_between_copies_that_differ_from_the_smallest(spark):
    # b is like a and like c, c is not like a: one class all the same.
    a = prose(1, 200, 5000).split()
    b = a[:182] + [f"x{i}" for i in range(18)]
    c = b[18:182] + [f"y{i}" for i in range(18)] + b[182:]
    rows = [(1, " ".join(a)), (3, " ".join(b)), (2, " ".join(c))]
    docs, key = keyed(documents(spark, rows))
    sets = {i: counted(t) for i, t in rows}
    assert max(similarity(*sets[1], *sets[2])) < 0.8 <= max(similarity(*sets[1], *sets[3]))
    out = {r.doc_id: r.class_id for r in near_duplicates(docs, key).collect()}
    linked = max(similarity(*sets[2], *sets[3])) >= 0.8
    assert out == {1: 1, 3: 1, 2: 1 if linked else 2}


def test_copies_that_repeat_a_line_differently_often(spark):
    # The same set of shingles, so plain Jaccard 1, but far apart by counts.
    rows = []
    for g in range(12):
        head, line, tail = (prose(900 + 3 * g + k, n, 50_000) for k, n in enumerate((40, 10, 40)))
        rows += [(100 * g + k, " ".join([head, *[line] * k, tail])) for k in (2, 40)]
    sets = [counted(t) for _, t in rows]
    for a, b in zip(sets[::2], sets[1::2]):
        weighted, plain = similarity(*a, *b)
        assert weighted < 0.5 and plain == 1
    docs, key = keyed(documents(spark, rows))
    out = near_duplicates(docs, key).collect()
    assert {r.class_size for r in out} == {2}
    assert all(r.class_id == r.doc_id // 100 * 100 + 2 for r in out)


def test_rare_shingles_bring_all_similar_pairs_together(spark):
    # Families of copies of one passage at all distances, some with lines repeated or cut off.
    rows, rng = [], random.Random(5)
    for g in range(6):
        base = prose(300 + g, 90, 5000).split()
        for k in range(25):
            copy = list(base[: rng.randrange(60, 91)])
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = rng.choice(["same", f"own{g}x{k}"])
            copy += copy[:12] * rng.choice([0, 0, 0, 1, 9])
            rows.append((1000 * g + k, " ".join(copy)))
    shingles = spark.createDataFrame(rows, "node long, text string").mapInArrow(
        _shingle_rows, "node long, hashes binary, counts binary"
    )
    sets = [counted(t) for _, t in rows]
    alike = {
        (rows[a][0], rows[b][0]) for a, b in combinations(range(len(rows)), 2)
        if max(similarity(*sets[a], *sets[b])) >= 0.8
    }
    nodes = spark.createDataFrame([(i, i) for i, _ in rows], "node long, label long")
    found = {(r.a, r.b) for r in rare_pairs(nodes, shingles).collect()}
    assert len(alike) > 50 and alike <= found
    assert len(found) < 6 * 25 * 24 / 2 / 2
    # Within one label nothing is compared; between labels nothing is lost.
    half = spark.createDataFrame([(i, i % 2) for i, _ in rows], "node long, label long")
    found = {(r.a, r.b) for r in rare_pairs(half, shingles).collect()}
    assert {(a, b) for a, b in alike if (a - b) % 2} <= found and all((a - b) % 2 for a, b in found)


def test_stage_and_empty_table(spark):
    docs = documents(spark, near_corpus())
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    full, key = keyed(docs)
    assert kept.count() == near_duplicates(full, key).where("kept").count()
    empty, key = keyed(documents(spark, []))
    assert near_duplicates(empty, key).count() == 0
