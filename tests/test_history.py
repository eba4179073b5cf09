"""History features: fixed vectors, a naive full scan, hot keys, causality."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from golden import EXPECTED, TRANSACTIONS
from pyspark.sql import functions as F

from finsieve import schemas, vocab
from finsieve.operators.canonical import InputError, accepted, canonicalize, rejected, require_valid
from finsieve.operators.history import (
    arrival_counters,
    build_features,
    cold_start,
    transaction_features,
    what_if_features,
)

SCHEMA = schemas.CANONICAL_TRANSACTION.strip() + ", seq LONG"


def canonical(spark, rows):
    numbered = [(*r, i) for i, r in enumerate(rows)]
    return accepted(canonicalize(spark.createDataFrame(numbered, SCHEMA), keep=("seq",)))


def vectors(features):
    rows = features.orderBy("seq").collect()
    return [[float(r[name]) for name in vocab.FEATURE_NAMES] for r in rows]


def events(seed, n=300, accounts=7):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.05:
            rows.append(rng.choice(rows))
            continue
        t = start + timedelta(hours=6 * rng.randrange(80), seconds=rng.choice((-1, 0, 0, 1)))
        rows.append(
            (
                f"TX{rng.randrange(10**6):06d}-{i}", t.isoformat(), f"A{rng.randrange(accounts)}",
                f"A{rng.randrange(accounts)}", round(rng.uniform(1, 9999), 2), "TRY", "TRY", "TR",
                "TR", "ach",
            )
        )
    rng.shuffle(rows)
    return rows


def naive(rows):
    """Full scan per row, straight from the window definition."""
    parsed = [(datetime.fromisoformat(r[1]), r[0], r[2], r[3], r[4], i) for i, r in enumerate(rows)]
    first, recorded = set(), []
    for t, tid, s, r, a, i in sorted(parsed, key=lambda p: (p[0], p[1], p[5])):
        if tid not in first:
            first.add(tid)
            recorded.append((t, tid, s, r, a))
    day, week = timedelta(hours=24), timedelta(days=7)
    out = []
    for t, tid, s, r, a, _ in parsed:
        past = [e for e in recorded if (e[0], e[1]) < (t, tid)]
        mine = [e for e in past if e[2] == s]
        theirs = [e for e in past if e[3] == r]
        week_mine = [e for e in mine if e[0] >= t - week]
        out.append(
            [
                sum(e[0] >= t - day for e in mine),
                round(sum(e[4] for e in mine if e[0] >= t - day), 2),
                len({e[3] for e in week_mine}),
                sum(e[0] >= t - day for e in theirs),
                len({e[2] for e in theirs if e[0] >= t - week}),
                sum(e[3] == r for e in week_mine),
                (t - max(e[0] for e in mine)).total_seconds() if mine else -1.0,
            ]
        )
    return out


def close(found, wanted):
    for a, b in zip(found, wanted, strict=True):
        assert a == pytest.approx(b, rel=1e-6)


def test_golden_vectors(spark):
    close(vectors(build_features(canonical(spark, TRANSACTIONS))), EXPECTED)


def test_golden_vectors_in_tiny_chunks(spark):
    rows = canonical(spark, TRANSACTIONS)
    close(vectors(build_features(rows, hot_rows=1, chunk_us=3_600_000_000)), EXPECTED)


@pytest.mark.parametrize("hot_rows", [10**6, 20])
def test_random_events_match_full_scan(spark, hot_rows):
    rows = events(3)
    found = vectors(build_features(canonical(spark, rows), hot_rows=hot_rows))
    close([v[8:] for v in found], naive(rows))


def test_prior_history_continues(spark):
    rows = sorted(events(4), key=lambda r: (r[1], r[0]))
    df = canonical(spark, rows)
    early, late = df.where("seq < 150"), df.where("seq >= 150")
    whole = {r["seq"]: r for r in build_features(df).collect()}
    part = build_features(late, prior=early).collect()
    assert len(part) == 150
    assert all(whole[r["seq"]] == r for r in part)


def test_what_if_leaves_no_trace(spark):
    rows = events(5, 120)
    history = canonical(spark, rows)
    asked = canonical(spark, [("ASK", "2024-01-30T00:00:00Z", "A1", "A2", 5.0, *["TRY"] * 2,
                               "TR", "TR", "ach")] * 2)
    asked = asked.withColumn("transaction_id", F.concat("transaction_id", F.col("seq")))
    one, two = what_if_features(asked, history).orderBy("seq").collect()
    assert one[2:] == two[2:]


def test_later_rows_change_nothing(spark):
    rows = [r for r in events(6) if r[1] < "2024-01-15"]
    extra = [("ZZ", "2024-02-01T00:00:00+00:00", "A1", "A2", 1.0, "TRY", "TRY", "TR", "TR", "ach")]
    before = vectors(build_features(canonical(spark, rows)))
    after = vectors(build_features(canonical(spark, rows + extra)))
    assert after[: len(before)] == before


def test_counters_and_cold_start(spark):
    rows = events(7, 150)
    df = canonical(spark, rows)
    seen, latest, recorded, late = set(), {}, 0, 0
    for r in rows:
        if r[0] in seen:
            continue
        seen.add(r[0])
        recorded += 1
        key = (datetime.fromisoformat(r[1]), r[0])
        ends = (("out", r[2]), ("in", r[3]))
        late += any(key < latest[e] for e in ends if e in latest)
        for e in ends:
            latest[e] = max(latest.get(e, key), key)
    for hot in (10**6, 5):
        found = arrival_counters(df, hot_rows=hot, chunk_rows=10).first()
        assert tuple(found) == (recorded, len(rows) - recorded, late)
    cold = {r["seq"]: r["cold_start"] for r in cold_start(df).collect()}
    first = min(range(len(rows)), key=lambda i: (rows[i][1], rows[i][0]))
    assert cold[first] and not all(cold.values())


def test_transaction_features_hot_equals_plain(spark):
    df = canonical(spark, events(8))
    plain = transaction_features(df).orderBy("seq").collect()
    hot = transaction_features(df, hot_rows=10).orderBy("seq").collect()
    for a, b in zip(plain, hot, strict=True):
        assert a[:2] == b[:2] and a[3:8] == b[3:8]
        assert (a[2] or 0.0) == pytest.approx(b[2] or 0.0, rel=1e-6)


def test_rows_are_checked(spark):
    bad = [
        ("T1", "2024-01-01T00:00:00", "A", "B", 1.0, "TRY", None, None, None, None, 0),
        ("T2", "2024-01-01T00:00:00Z", " ", "B", -1.0, "TRY", None, None, None, None, 1),
        ("T3", "2024-01-01T00:00:00Z", "A", "B", 1.0, "try ", " ", None, None, "Cash-Deposit", 2),
    ]
    rows = canonicalize(spark.createDataFrame(bad, SCHEMA), keep=("seq",))
    reasons = {r["seq"]: r["errors"] for r in rejected(rows).collect()}
    assert reasons == {
        0: "timestamp must carry an offset",
        1: "missing sender_account; amount must be finite and > 0",
    }
    good = accepted(rows).first()
    assert (good["payment_currency"], good["received_currency"]) == ("TRY", "TRY")
    assert (good["sender_country"], good["payment_type"]) == ("TR", "cash_deposit")
    with pytest.raises(Exception, match="bad transaction"):
        require_valid(rows).collect()
    with pytest.raises(InputError):
        canonicalize(rows.drop("amount"))
