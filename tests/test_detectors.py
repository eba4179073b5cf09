"""Travel, keywords, alerts and their store."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from finsieve.functions import scalars as S
from finsieve.functions.identity import display_identity
from finsieve.operators import alerts as A
from finsieve.operators import detectors as D
from finsieve.options import DetectionOptions
from finsieve.sources import alert_store

START = datetime(2024, 1, 1, 12)
SCHEMA = """transaction_id string, timestamp timestamp, sender_iban string, sender_city string,
            receiver_iban string, amount double, description string"""


def rows_of(spark, items):
    return spark.createDataFrame(items, SCHEMA)


def move(n, minutes, city, sender="S1"):
    return (f"T{n:02d}", START + timedelta(minutes=minutes), sender, city, "R1", 10.0, "")


def test_travel(spark):
    rows = rows_of(spark, [
        move(1, 0, "Istanbul"), move(2, 1, "Tokyo"), move(3, 2, "Nowhere"), move(4, 3, "Tokyo"),
        move(5, 0, "Ankara", "S2"), move(6, 60 * 25, "Tokyo", "S2"), move(7, 0, "Paris", "S3"),
        move(8, 0, "London", "S3"),
    ])
    found = D.impossible_travel(rows).collect()
    assert {r["transaction_id"] for r in found} == {"T02", "T08"}
    hot = D.impossible_travel(rows, hot_rows=1, chunk_us=60_000_000).collect()
    assert {r["details"] for r in hot} == {r["details"] for r in found}
    first = next(r for r in found if r["transaction_id"] == "T02")
    assert '"from_city":"Istanbul"' in first["details"] and first["severity"] == "high"


def test_keywords(spark):
    rows = rows_of(spark, [
        ("T1", START, "S", "", "R", 1.0, "Bahis komisyon"), ("T2", START, "S", "", "R", 1.0, None),
        ("T3", START, "S", "", "R", 1.0, "my CASINO secret"), ("T4", START, "S", "", "R", 1.0, "kira"),
    ])
    found = {r["transaction_id"]: r for r in D.blacklisted(rows).collect()}
    assert set(found) == {"T1", "T3"}
    assert found["T1"]["severity"] == "medium" and found["T3"]["severity"] == "critical"
    assert '["casino","secret"]' in found["T3"]["details"]


def test_store_is_idempotent(spark, tmp_path):
    rows = rows_of(spark, [
        (f"T{i}", START + timedelta(minutes=i), "S", "Istanbul", "R", 1.0, "casino")
        for i in range(5)
    ])
    batch = D.to_alerts(D.blacklisted(rows.unionByName(rows)))
    path = str(tmp_path / "alerts")
    for _ in range(2):
        alert_store.write_alerts(batch, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 5 and stored.select("alert_id").distinct().count() == 5
    other = batch.withColumn("severity", F.lit("low"))
    kept = alert_store.resolve_alerts(other, stored)
    assert {r["severity"] for r in kept.collect()} == {"critical"}


def test_all_detectors_and_counters(spark):
    rows = rows_of(spark, [
        ("T1", START, "A", "Istanbul", "B", 9.0, "casino"),
        ("T2", START + timedelta(minutes=1), "B", "Ankara", "C", 9.0, ""),
        ("T3", START + timedelta(minutes=2), "C", "Ankara", "A", 9.0, ""),
        ("T4", START + timedelta(minutes=3), "A", "Tokyo", "B", 9.0, ""),
    ])
    found = D.run_detectors(rows)
    kinds = sorted((r["transaction_id"], r["fraud_type"]) for r in found.collect())
    assert kinds == [
        ("T1", "blacklist_keyword"), ("T3", "circular_ring"), ("T4", "circular_ring"),
        ("T4", "impossible_travel"),
    ]
    totals = D.detection_counters(rows, found).first()
    assert totals["fraud_rate"] == 1.0 and totals["circular_rings"] == 2
    newest = A.latest_ring(D.to_alerts(found)).first()
    assert newest["path"][0] == newest["path"][-1] == "A"


def test_options_are_checked():
    try:
        DetectionOptions(ring_min_hops=6, ring_max_hops=5)
    except ValueError:
        return
    raise AssertionError("bad hops were accepted")


def test_scalars(spark):
    row = spark.range(1).select(
        S.clean_iban(F.lit(" tr33 0006 1005 1978 6457 8413 26 ")).alias("iban"),
        S.clean_iban(F.lit("tr1")).alias("short"),
        S.normal_name(F.lit("  Ahmet-O'Neil   İŞIK ")).alias("name"),
        S.name_similarity(F.lit("a b c d"), F.lit("d c b x")).alias("overlap"),
        S.utc_timestamp(F.lit("2024-01-01T03:00:00.5+03:00"), True).alias("zoned"),
        S.utc_timestamp(F.lit("2024-01-01T00:00:00.5"), True).alias("naive"),
        S.scaled_amount(F.lit(1437.79)).alias("scaled"),
        S.sigmoid(F.lit(-800.0)).alias("tiny"),
        display_identity(F.lit("8724731955")).alias("who"),
        S.alert_title(F.lit("impossible_travel")).alias("title"),
    ).first()
    assert row["iban"] == "TR330006100519786457841326" and row["short"] is None
    assert row["name"] == "ahmetoneil işik" or row["name"].startswith("ahmetoneil i")
    assert row["overlap"] == 75.0 and row["zoned"] == row["naive"]
    assert row["scaled"] == 71889.5 and row["tiny"] == 0.0
    assert row["title"] == "Impossible Travel Detected"
    digits = row["who"]["iban"][4:] + "2927" + row["who"]["iban"][2:4]
    assert int(digits) % 97 == 1
