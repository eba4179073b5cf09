"""Code lengths against a tree walked byte by byte; languages on held-out rows."""

import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import pyarrow as pa
import pytest
from helpers import awkward, documents

from finsieve.llm import language_id as P

WORDS = {
    "en": "the of and to in that it was for with as his on be at by had not are but".split(),
    "de": "der die und das ist nicht für über straße größe ein eine auch noch schon aber".split(),
    "el": "και το να του η της με που είναι για από στο δεν".split(),
}


def text(lang, seed, n):
    rng = random.Random(f"{lang}{seed}")
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def counts_of(samples, order):
    rows = Counter()
    for lang, t in samples:
        data = t.encode()
        for n in range(1, order + 2):
            for i in range(len(data) - n + 1):
                rows[lang, n, int.from_bytes(data[i : i + n], "big")] += 1
    lang, n, key, count = zip(*[(*k, v) for k, v in rows.items()])
    return pa.table({"lang": pa.array(lang), "n": pa.array(n, pa.int32()), "key": pa.array(key, pa.int64()), "count": pa.array(count, pa.int64())})


class PlainTree:
    def __init__(self, texts, order):
        self.order, self.next = order, defaultdict(Counter)
        for t in texts:
            data = t.encode()
            for i in range(len(data)):
                for k in range(min(i, order) + 1):
                    self.next[data[i - k : i]][data[i]] += 1

    def p(self, context, byte):
        seen = self.next.get(context)
        shorter = (lambda b: self.p(context[1:], b)) if context else (lambda b: 1 / 256)
        if not seen:
            return shorter(byte)
        n, d = sum(seen.values()), len(seen)
        if byte in seen:
            return seen[byte] / (n + d)
        return d / (n + d) * shorter(byte) / (1 - sum(shorter(b) for b in seen))

    def bits(self, data):
        return -sum(math.log2(self.p(data[max(0, i - self.order) : i], data[i])) for i in range(len(data)))


@pytest.mark.parametrize("order", [0, 1, 3])
def test_code_lengths_are_exact(order):
    samples = [(lang, text(lang, s, 40)) for lang in WORDS for s in range(3)]
    trees = P.build_trees(counts_of(samples, order), order)
    plain = {lang: PlainTree([t for l, t in samples if l == lang], order) for lang in WORDS}
    asked = [text("en", 9, 20), text("el", 9, 20), "x", "zzz the ß \x00\x7f", "qqqq" * 5]
    got = P.code_lengths(trees, [t.encode() for t in asked])
    for row, t in zip(got, asked):
        for bits, lang in zip(row, trees.languages):
            assert bits == pytest.approx(plain[lang].bits(t.encode()), rel=1e-4)


def test_probabilities_sum_to_one():
    samples = [("en", text("en", s, 60)) for s in range(3)]
    trees = P.build_trees(counts_of(samples, 2), 2)
    for context in (b"th", b"zz", b" t"):
        both = P.code_lengths(trees, [context + bytes([b]) for b in range(256)]) - P.code_lengths(trees, [context])
        assert sum(2.0 ** -both[:, 0]) == pytest.approx(1, rel=1e-3)


def test_long_texts_are_scored_in_slices(monkeypatch):
    trees = P.build_trees(counts_of([(l, text(l, 1, 80)) for l in WORDS], 3), 3)
    texts = [text(l, s, n).encode() for l in WORDS for s, n in ((2, 3), (3, 400), (4, 1))]
    whole = P.code_lengths(trees, texts)
    monkeypatch.setattr(P, "SLICE", 97)
    assert P.code_lengths(trees, texts) == pytest.approx(whole, rel=1e-5)


def test_table_finds_all_and_only_its_strings():
    import numpy as np

    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 5000))
    held = P.Strings(keys)
    assert (held.find(keys) == np.arange(len(keys))).all()
    others = np.setdiff1d(np.arange(5000), keys)
    assert (held.find(others) == -1).all()
    assert (P.Strings(keys[:0]).find(keys) == -1).all()


def labelled(spark, rows):
    return spark.createDataFrame([(i, t, l, 3, "z") for i, t, l in rows], "doc_id long, text string, lang string, score int, utf8 string")


def test_held_out_rows_and_awkward_ones(spark):
    rows = [(5000 + i, text(list(WORDS)[i % 3], i, 5 + i % 30), list(WORDS)[i % 3]) for i in range(300)]
    rows += [(1000 + i, text("en", 5, 12), "en") for i in range(150)]  # copies
    odd = [(i, t, None) for i, t in awkward()] + [(2000, "12 34 !!", "de"), (2001, "x" * 300_000, None)]
    docs = labelled(spark, rows + odd)
    trees = P.train_trees(docs, ~P.is_held_out())
    assert trees.languages == sorted(WORDS)
    got = P.identify(docs, trees).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
        assert 0 <= r.score <= 1 and r.utf8 == "z"
    held = [(i, l) for i, _, l in rows if crc32(str(i).encode()) % 4 == 2]
    assert sum(by_id[i][0].lang_pred == l for i, l in held) >= 0.97 * len(held)
    assert {r.lang_pred for i in (10, 11, 12, 2000) for r in by_id[i]} == {"und"}
    assert all(r.score == 0 for r in got if r.lang_pred == "und")


def test_sample_is_bounded_and_without_copies(spark):
    rows = [(i, text("en", i % 40, 20), "en") for i in range(200)] + [(500 + i, text("de", i, 30), "de") for i in range(60)]
    docs = labelled(spark, rows)
    from pyspark.sql import functions as F

    took = P.sample(docs, F.lit(True), 25, 1_000_000).groupBy("lang").agg(F.count("*"), F.count_distinct("text")).collect()
    assert sorted(map(tuple, took)) == [("de", 25, 25), ("en", 25, 25)]
    few = P.sample(docs, F.lit(True), 25, 150).groupBy("lang").count().collect()
    assert all(1 <= r["count"] <= 3 for r in few)


def test_nothing_learned(spark):
    docs = documents(spark, [(1, "hello"), (2, None)])
    trees = P.train_trees(docs.where("false"), ~P.is_held_out())
    assert trees.languages == []
    assert {(r.lang_pred, r.score) for r in P.identify(docs, trees).collect()} == {("und", 0.0)}
    learned = P.train_trees(docs, ~P.is_held_out("n_chars"))
    assert P.identify(docs.where("false"), learned).collect() == []
