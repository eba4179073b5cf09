"""Importance resampling against a plain replay of its definition."""

import hashlib
import math
import re
import zlib
from collections import Counter

from helpers import awkward, documents, prose

from finsieve.llm import resampling
from finsieve.llm.terms import terms


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_features(text):
    w = plain_words(text)
    return [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def replay(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(plain_features(text))
    for text in target:
        t.update(plain_features(text))
    s_all, t_all = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        f = plain_features(text)
        total = sum(
            math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in f
        )
        weight = total // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(plain_words(text)), len(f), weight, score, None])
    long = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    for place, row in enumerate(long[: 25 * len(long) // 100], 1):
        row[5] = place
    return rows


def test_words_and_features():
    for text in ("Über ÄPFEL, x1y2\x7f\x00 A-b_c", "straße weit", "", "...", "z"):
        assert [w.decode() for w in terms(text.encode())] == plain_words(text)
    words = [b"a", b"bc", b"d"]
    joined = [b"a", b"bc", b"d", b"a bc", b"bc d", b"a bc d"]
    assert resampling.feature_crcs(words, 3) == [zlib.crc32(f) for f in joined]
    assert resampling.feature_crcs([], 2) == []
    assert terms(None) == []


def test_equals_replay(spark):
    rows = awkward() + [(100 + i, prose(40 + i, 30 + i)) for i in range(60)]
    target = [prose(41, 50), prose(45, 80), None, ""]
    items = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    got = resampling.resample(documents(spark, rows), items)
    got = [tuple(r) for r in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    # Rows with the same id and score may swap their ranks.
    assert sorted((r[:5] for r in got), key=key) == sorted((tuple(r[:5]) for r in replay(rows, target)), key=key)
    ranks = sorted(r[5] for r in got if r[5] is not None)
    assert ranks == list(range(1, len(ranks) + 1))
    placed = lambda rs: {r[5]: (r[0], r[4]) for r in rs if r[5] is not None}
    assert placed(got) == placed(replay(rows, target))


def test_draw_leans_to_the_target_and_keeps_columns(spark):
    rows = [(i, prose(i, 60, 50)) for i in range(200)] + [(1000 + i, " ".join(f"t{(i * k) % 13}" for k in range(40))) for i in range(50)]
    items = spark.createDataFrame([(i, rows[200 + i][1]) for i in range(20)], "item_id long, text string")
    docs = documents(spark, rows)
    drawn = resampling.drawn_documents(docs, items)
    assert set(drawn.columns) == set(docs.columns) - {"score"}
    taken = [r.doc_id for r in drawn.collect()]
    assert len(taken) == 250 * 25 // 100
    assert sum(t >= 1000 for t in taken) >= 45


def test_empty_tables(spark):
    none = documents(spark, [])
    items = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(none, items).collect() == []
    one = resampling.resample(documents(spark, [(1, prose(1, 30))]), items).collect()
    assert [(r.n_features, r["rank"]) for r in one] == [(59, None)]
