"""Rings, chains and networks against brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from finsieve.operators import detectors as D
from finsieve.operators import graph as G
from finsieve.operators import network as N
from finsieve.operators import rings as R
from finsieve.options import DetectionOptions

SCHEMA = "src string, dst string, transaction_id string, timestamp timestamp, amount double"
START = datetime(2024, 1, 1)


def graph(seed, nodes, n, hub=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.randrange(nodes), rng.randrange(nodes)
        if hub and i % 3 == 0:
            a, b = (0, b) if rng.random() < 0.5 else (a, 0)
        when = START + timedelta(hours=rng.randrange(500))
        rows.append((f"N{a}", f"N{b}", f"T{i:03d}", when, float(rng.randrange(100, 5000))))
    return rows


def closed_walks(rows, low, high, hours=None):
    """All closed walks over different transactions, from every start."""
    out_edges = {}
    for r in rows:
        out_edges.setdefault(r[0], []).append(r)
    found = []

    def go(start, walk):
        last = walk[-1][1]
        if last == start and len(walk) >= low:
            found.append(tuple(walk))
        if len(walk) < high:
            for e in out_edges.get(last, []):
                if e not in walk:
                    go(start, [*walk, e])

    for r in rows:
        go(r[0], [r])
    if hours is not None:
        span = timedelta(hours=hours)
        found = [w for w in found if max(e[3] for e in w) - min(e[3] for e in w) < span]
    return found


def ids(walk):
    return tuple(e[2] for e in walk)


@pytest.mark.parametrize("hours", [None, 168])
def test_every_ring_once(spark, hours):
    rows = graph(1, 12, 36, hub=True)
    rings = R.find_rings(
        spark.createDataFrame(rows, SCHEMA), 3, 5, window_hours=hours
    ).collect()
    wanted = {ids(w) for w in closed_walks(rows, 3, 5, hours) if ids(w)[0] == min(ids(w))}
    assert sorted(tuple(r["transaction_ids"]) for r in rings) == sorted(wanted)
    assert all(r["path"][0] == r["path"][-1] and len(r["path"]) == r["hops"] + 1 for r in rings)


def test_simple_rings(spark):
    rows = graph(2, 8, 26)
    rings = R.find_rings(spark.createDataFrame(rows, SCHEMA), 2, 4, simple=True).collect()
    wanted = {
        ids(w) for w in closed_walks(rows, 2, 4)
        if ids(w)[0] == min(ids(w)) and len({e[0] for e in w}) == len(w)
    }
    assert {tuple(r["transaction_ids"]) for r in rings} == wanted


def test_largest_rings_with_parallel_edges(spark):
    rows = graph(3, 4, 24)
    top = R.all_rings(spark.createDataFrame(rows, SCHEMA), 3, 4, 1000, limit=5).collect()
    walks = [w for w in closed_walks(rows, 3, 4) if ids(w)[0] == min(ids(w))]
    walks = [w for w in walks if sum(e[4] for e in w) >= 1000]
    walks.sort(key=lambda w: (-sum(e[4] for e in w), sorted(ids(w)), ids(w)))
    assert [tuple(r["transaction_ids"]) for r in top] == [ids(w) for w in walks[:5]]


@pytest.mark.parametrize("simple", [False, True])
def test_largest_rings_lose_nothing(spark, monkeypatch, simple):
    """The bound from the heaviest transfers drops no ring that belongs to the answer."""
    monkeypatch.setattr(R, "FIRST_HEAVY", 4)
    monkeypatch.setattr(R, "HEAVY_GROWTH", 2)
    rows = graph(6, 11, 60, hub=True)
    rows += [(a, b, f"{i}x", t, amount) for a, b, i, t, amount in rows[:6]]  # equal totals
    walks = [w for w in closed_walks(rows, 3, 5) if ids(w)[0] == min(ids(w)) and sum(e[4] for e in w) >= 1000]
    if simple:
        walks = [w for w in walks if len({e[0] for e in w}) == len(w)]
    walks.sort(key=lambda w: (-sum(e[4] for e in w), sorted(ids(w)), ids(w)))
    frame = spark.createDataFrame(rows, SCHEMA)
    top = R.all_rings(frame, limit=7, simple=simple).collect()
    assert [tuple(r["transaction_ids"]) for r in top] == [ids(w) for w in walks[:7]]
    spun = R.all_rings(frame, limit=7, simple=simple, dedupe=False).collect()
    turned = [ids(w[i:] + w[:i]) for w in walks[:7] for i in range(len(w))]
    turned.sort(key=lambda i: (-sum(r[4] for r in rows if r[2] in i), sorted(i), i))
    assert [tuple(r["transaction_ids"]) for r in spun] == turned[:7]


def test_longest_rings(spark):
    rows = graph(8, 9, 26)
    as_of = START + timedelta(hours=400)
    recent = [r for r in rows if as_of - timedelta(days=14) < r[3] <= as_of]
    walks = [w for w in closed_walks(recent, 3, 6) if ids(w)[0] == min(ids(w))]
    walks.sort(key=lambda w: (-len(w), -sum(e[4] for e in w), sorted(ids(w)), ids(w)))
    assert len({len(w) for w in walks[:200]}) > 1
    found = R.longest_rings(spark.createDataFrame(rows, SCHEMA), F.lit(as_of), days=14, limit=200).collect()
    assert [tuple(r["transaction_ids"]) for r in found] == [ids(w) for w in walks[:200]]


def test_no_rings_at_all(spark):
    rows = [("A", "B", "1", START, 5000.0), ("B", "C", "2", START, 5000.0)]
    for data in (rows, []):
        frame = spark.createDataFrame(data, SCHEMA)
        assert R.all_rings(frame).collect() == []
        assert R.longest_rings(frame, F.lit(START + timedelta(hours=1))).collect() == []


def test_largest_ring_at_every_moment(spark, monkeypatch):
    monkeypatch.setattr(R, "CELLS", 16)
    rows = graph(5, 9, 70, hub=True)
    hours = 100
    window_us = hours * 3600 * 10**6
    walks = closed_walks(rows, 3, 4, hours)
    wanted = {}
    for r in rows:
        best = None
        for w in walks:
            last = max((e[3], e[2]) for e in w)
            if w[0][0] == r[0] and last <= (r[3], r[2]) and r[3] < min(e[3] for e in w) + timedelta(hours=hours):
                best = max(best or (0, ()), (sum(e[4] for e in w), ids(w)))
        if best:
            wanted[r[2]] = best
    frame = spark.createDataFrame(rows, SCHEMA)
    numbered = R.Numbered(R.cycle_core(G._core(frame)), None)
    rings = R.closed_walks(numbered, 3, 4, window_us, False, None)
    moments = frame.select(F.col("src").alias("account"), "transaction_id", F.unix_micros("timestamp").alias("t"))
    found = R.largest_at(numbered, rings, moments, window_us).collect()
    assert {r["transaction_id"]: (float(r["total"]), tuple(r["ids"])) for r in found} == wanted
    assert len(wanted) > 10


def test_rings_through_one_account(spark):
    rows = graph(4, 10, 34)
    as_of = START + timedelta(hours=480)
    found = G.rings_through(
        spark.createDataFrame(rows, SCHEMA), "N1", F.lit(as_of), window_hours=400, limit=10_000
    ).collect()
    recent = [r for r in rows if as_of - timedelta(hours=400) < r[3] <= as_of]
    wanted = {ids(w) for w in closed_walks(recent, 3, 5) if w[0][0] == "N1"}
    assert {tuple(r["transaction_ids"]) for r in found} == wanted


def test_known_ring(spark):
    rows = [("A", "B", "1", START, 10_000.0), ("B", "C", "2", START, 10_000.0)]
    assert R.find_rings(spark.createDataFrame(rows, SCHEMA)).count() == 0
    rows.append(("C", "A", "3", START, 10_000.0))
    (ring,) = R.find_rings(spark.createDataFrame(rows, SCHEMA)).collect()
    assert ring["path"] == ["A", "B", "C", "A"] and float(ring["total_amount"]) == 30_000


def test_ring_alerts_match_replay(spark):
    rows = graph(5, 9, 60, hub=True)
    tx = spark.createDataFrame(rows, SCHEMA).select(
        F.col("src").alias("sender_iban"), F.col("dst").alias("receiver_iban"), "transaction_id",
        "timestamp", "amount", F.lit("").alias("description"), F.lit(None).cast("string")
        .alias("fraud_type"),
    )
    found = D.ring_alerts(tx, DetectionOptions(ring_max_hops=4)).select(
        "transaction_id", F.get_json_object("details", "$.total_amount").cast("double").alias("v")
    ).collect()
    walks = closed_walks(rows, 3, 4, 168)
    wanted = {}
    for r in rows:
        now = (r[3], r[2])
        live = [
            sum(e[4] for e in w) for w in walks
            if w[0][0] == r[0] and max((e[3], e[2]) for e in w) <= now
            and min(e[3] for e in w) > r[3] - timedelta(hours=168)
        ]
        if live:
            wanted[r[2]] = max(live)
    assert {r["transaction_id"]: r["v"] for r in found} == wanted


def test_communities_and_clustering(spark):
    rng = random.Random(9)
    pairs = [(f"N{i}", f"N{i + 1}") for i in range(40)] + [("X", "Y"), ("Y", "Z"), ("Z", "X")]
    rng.shuffle(pairs)
    df = spark.createDataFrame(pairs, "src string, dst string")
    groups = {r["node"]: r["community"] for r in N.communities(df).collect()}
    assert set(groups) == {n for p in pairs for n in p}
    assert {groups[f"N{i}"] for i in range(41)} == {"N0"}
    assert {groups[n] for n in "XYZ"} == {"X"}
    shape = {r["node"]: r for r in N.clustering(df).collect()}
    assert shape["X"]["triangles"] == 1 and shape["X"]["clustering_coefficient"] == 1.0
    assert shape["N3"]["clustering_coefficient"] == 0.0
    ranks = N.pagerank(df, 5).agg(F.sum("pagerank")).first()[0]
    assert ranks == pytest.approx(1.0)
