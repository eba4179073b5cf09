import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from finsieve.llm.language_model import good_turing, score_documents

from helpers import awkward, documents, prose, words


class Brute:
    """The same model over dictionaries, recursion and all."""

    def __init__(self, texts, order):
        self.order = order
        bags = [self.tokens(t) for t in texts]
        self.counts = [Counter() for _ in range(order + 1)]
        for bag in bags:
            for n in range(1, order + 1):
                padded = (["<s>"] if n > 1 else []) + bag
                self.counts[n].update(tuple(padded[i : i + n]) for i in range(len(padded) - n + 1))
        self.total = sum(self.counts[1].values())
        self.d = {}
        for n in range(1, order + 1):
            found = [sum(v == r for v in self.counts[n].values()) for r in range(1, 7)]
            d = good_turing(found)
            self.d[n] = [0.0, *([0.0] + d[1:] if n > 1 else d)]
        self.history = [Counter(), Counter({(): 0})] + [Counter() for _ in range(order)]
        for n in range(2, order + 1):
            for g, c in self.counts[n].items():
                self.history[n][g[:-1]] += c
        self.followers = defaultdict(list)
        for n in range(2, order + 1):
            for g, c in self.counts[n].items():
                if c >= 2:
                    self.followers[g[:-1]].append(g[-1])
        self.known = {}
        self.unknown = 1 - sum(self.less(1, c) for c in self.counts[1].values()) / self.total

    @staticmethod
    def tokens(text):
        return [w.encode().lower() for w in words(text)] + ["<e>"]

    def less(self, n, c):
        return c * (self.d[n][c] if c < len(self.d[n]) else 1.0)

    def p(self, history, word):
        n = len(history) + 1
        if n == 1:
            c = self.counts[1][word,]
            return self.less(1, c) / self.total if c else self.unknown
        h, took, lower = self.weights(history)
        c = self.counts[n][(*history, word)]
        return self.less(n, c) / h if c >= 2 else (h - took) / h / (1 - lower) * self.p(history[1:], word)

    def weights(self, history):
        if history not in self.known:
            n, found = len(history) + 1, self.followers.get(history, [])
            h = self.history[n][history]
            took = sum(self.less(n, self.counts[n][(*history, w)]) for w in found)
            lower = sum(self.p(history[1:], w) for w in found)
            self.known[history] = (h if h - took >= 1e-9 else h + 1, took, lower)
        return self.known[history]

    def score(self, text):
        bag = ["<s>"] + self.tokens(text)
        return sum(
            math.log10(self.p(tuple(bag[max(0, i - self.order + 1) : i]), bag[i])) for i in range(1, len(bag))
        )


def rows_for(n):
    return awkward() + [(100 + i, prose(i % 40, 60, 80)) for i in range(n)]


@pytest.mark.parametrize("order", [2, 3])
def test_scores_and_sums_are_those_of_brute_force(spark, order):
    rows = [(n, t) for n, (_, t) in enumerate(rows_for(60))]
    train = [t for i, t in rows if i % 5]
    brute = Brute(train, order)
    out = score_documents(documents(spark, rows), F.col("doc_id") % 5 != 0, order).collect()
    assert len(out) == len(rows)
    types = len(brute.counts[1])
    for r in out:
        bag = brute.tokens(rows[r.doc_id][1])
        assert (r.n_tokens, r.train_tokens) == (len(bag), brute.total)
        assert r.n_known == sum((w,) in brute.counts[1] for w in bag)
        base = sum(math.log10((brute.counts[1][w,] + 0.5) / (brute.total + 0.5 * (types + 1))) for w in bag)
        assert r.base_score == pytest.approx(base, abs=1e-6)
        assert r.score == pytest.approx(brute.score(rows[r.doc_id][1]), abs=1e-6)
    for history in [("<s>",), (b"w0",), (b"w3", b"w1"), (b"never",)]:
        history = history[: order - 1]
        mass = sum(brute.p(history, w) for (w,) in brute.counts[1]) + brute.p(history, "never seen")
        assert mass == pytest.approx(1)


def test_discounts_stay_within_bounds():
    assert good_turing([0, 0, 0, 0, 0, 0]) == [(r - 0.5) / r for r in range(1, 6)]
    assert all(0 < d < 1 for d in good_turing([100, 40, 20, 12, 8, 5]))


def test_null_ids_empty_tables_and_nothing_to_learn_from(spark):
    docs = documents(spark, awkward())
    out = score_documents(docs, F.col("doc_id") > 12).collect()
    assert len(out) == len(awkward()) and sum(r.doc_id is None for r in out) == 2
    assert not any(r.training for r in out if r.doc_id is None)
    assert score_documents(documents(spark, []), F.lit(True)).count() == 0
    blind = score_documents(docs, F.lit(False)).collect()
    assert {(r.score, r.train_tokens, r.n_known) for r in blind} == {(0.0, 0, 0)}
