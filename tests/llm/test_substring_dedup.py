import random

import pyarrow as pa

from finsieve.llm import substring_dedup
from finsieve.llm.common import keyed
from finsieve.llm.substring_dedup import SuffixAutomaton, deduplicate, without_repeats

from helpers import awkward, documents, prose, words


def expected(rows, window=20):
    """Kept words per row, rows in the order of (id, place); brute force over all windows."""
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, rows[n][0] or 0, n))
    seen, out = set(), {}
    for n in order:
        w = words(rows[n][1])
        gone = set()
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            if g in seen:
                gone.update(range(i, i + window))
            seen.add(g)
        out[n] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def corpus():
    rng = random.Random(5)
    passages = [prose(100 + i, rng.randrange(15, 60), 5000) for i in range(6)]
    rows = []
    for i in range(60):
        parts = [prose(i, rng.randrange(1, 60), 5000), rng.choice(passages), prose(1000 + i, 10, 5000), rng.choice(passages)]
        if i % 5 == 0:
            parts.append(" ".join(["p q r"] * rng.randrange(5, 15)))
        text = " ".join(parts).split()
        if i % 3 == 0:
            text[rng.randrange(len(text))] = "edit"
        rows.append((i * 7 % 60, " ".join(text)))
    return rows


def check(spark, rows):
    docs, key = keyed(documents(spark, rows))
    out, cut = deduplicate(docs, key)
    got = sorted((r.doc_id is None, r.doc_id, *r[cut]) for r in out.select("doc_id", cut).collect())
    want = sorted((rows[n][0] is None, rows[n][0], *v) for n, v in expected(rows).items())
    assert [g[:1] + g[2:] if g[0] else g for g in got] == [w[:1] + w[2:] if w[0] else w for w in want]


def test_removed_words_are_those_of_brute_force(spark):
    check(spark, corpus())


def test_awkward_rows(spark):
    check(spark, awkward() + [(40, prose(2, 30_000)), (41, "")])


def test_split_anchors_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECES_PER_SHARD", 2)
    base = prose(1, 60, 5000).split()
    rows = []
    for i in range(40):
        text = list(base)
        text[random.Random(i).randrange(60)] = f"e{i % 4}"
        rows.append((i, " ".join(text)))
    check(spark, rows)


def test_a_passage_in_many_rows_meets_in_no_task(spark, monkeypatch):
    # Different neighbours make every row's piece at the passage's edges another one.
    most, passage, make = 8, prose(1, 40, 5000), substring_dedup._beaten

    def limited(window):
        run = make(window)

        def checked(group):
            assert len(group) <= 2 * most, f"{len(group)} pieces in one task"
            return run(group)

        return checked

    monkeypatch.setattr(substring_dedup, "PIECES_PER_SHARD", most)
    monkeypatch.setattr(substring_dedup, "_beaten", limited)
    check(spark, [(i, f"{prose(100 + i, 30, 50_000)} {passage} {prose(500 + i, 30, 50_000)}") for i in range(40)])


def test_words_leave_the_texts_only_for_pieces_with_variants(spark, monkeypatch):
    store, worded = substring_dedup.store, {}

    def counted(df, name):
        out = store(df, name)
        if "words" in out.columns:
            worded[name] = out.count()
        return out

    monkeypatch.setattr(substring_dedup, "store", counted)
    text = prose(1, 300, 5000)
    check(spark, [(i, text) for i in range(30)])
    assert sum(worded.values()) == 0
    check(spark, [(i, text if i else text.replace(text.split()[150], "edit", 1)) for i in range(30)])
    assert 0 < sum(worded.values()) < 30


def test_a_words_hash_does_not_depend_on_its_neighbours():
    texts = [f"  {prose(1, 30_000)}\t\n", None, "", " \v\f\r", "ü" * 40_000 + " x " + "y" * 65_536 + " ü", "x"]
    flat, bounds, first = substring_dedup.flat_words([t.encode() if t else None for t in texts])
    spelt = [flat[a : b - 1].tobytes() for a, b in zip(bounds, bounds[1:])]
    assert [spelt[a:b] for a, b in zip(first, first[1:])] == [[w.encode() for w in words(t)] for t in texts]
    hashes, alone = substring_dedup.word_hashes(flat, bounds).tolist(), {}
    for w in {*spelt}:
        alone[w] = int(substring_dedup.word_hashes(*substring_dedup.flat_words([w])[:2])[0])
    assert hashes == [alone[w] for w in spelt]
    assert len({*alone.values()}) == len(alone)


def test_ranges_are_cut_out_of_texts():
    texts = ["a b\n c d", "", "x", " a  b c ", "a b"]
    spans = [[(1, 2), (1, 3)], None, [(0, 1)], [(2, 3)], []]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    given = pa.array([None, *[s and [{"start": a, "end": b} for a, b in s] for s in spans]], kind).slice(1)
    cut = substring_dedup.without_spans([t.encode() for t in texts], given)
    assert [tuple(r.values()) for r in cut.to_pylist()] == [(4, 2, "a d"), (0, 0, ""), (1, 1, ""), (3, 1, "a b"), (2, 0, "a b")]


def test_automaton_has_matching_statistics():
    rng = random.Random(3)
    texts = [[bytes([97 + rng.randrange(3)]) for _ in range(40)] for _ in range(4)]
    automaton = SuffixAutomaton()
    for n, t in enumerate(texts):
        automaton.add(t, 1000 * n)
    automaton.finish()
    probe = [bytes([97 + rng.randrange(4)]) for _ in range(80)]
    for at, (matched, key) in enumerate(automaton.matches(probe, 6)):
        best = max(
            (k for k in range(0, min(6, at + 1) + 1)
             if k == 0 or any(t[j : j + k] == probe[at - k + 1 : at + 1] for t in texts for j in range(len(t)))),
        )
        assert matched == best
        if best == 6:
            assert key == min(
                1000 * n + j + 5 for n, t in enumerate(texts) for j in range(35) if t[j : j + 6] == probe[at - 5 : at + 1]
            )


def test_stage_keeps_rows_and_columns(spark):
    rows = corpus()
    docs = documents(spark, rows)
    out = without_repeats(docs)
    assert out.columns == docs.columns
    kept = {rows[n][0]: (v, rows[n][1]) for n, v in expected(rows).items()}
    for r in out.collect():
        (_, removed, text), old = kept[r.doc_id]
        assert r.text == (text if removed else old) and r.n_chars == len(r.text)
    assert without_repeats(documents(spark, [])).count() == 0
