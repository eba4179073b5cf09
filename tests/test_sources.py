"""Files and streams: row numbers, messages, micro-batches equal one batch."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_history import canonical, events, vectors

from finsieve import schemas, vocab
from finsieve.operators import canonical as C
from finsieve.operators import dataset as B
from finsieve.operators import detectors as D
from finsieve.operators.feature_store import FeatureGroup
from finsieve.operators.canonical import accepted, canonicalize, from_received
from finsieve.operators.history import build_features
from finsieve.operators.training import explain_linear
from finsieve.options import DetectionOptions
from finsieve.plans.models import stored_model
from finsieve.sources import files, streams
from finsieve.streaming import jobs as J
from finsieve.streaming.online import OnlineHistory
from finsieve.streaming.travel import travel_stream
from finsieve.streaming.unique import SeenIds

START = datetime(2024, 1, 1)


def raw_csv(path, n=200, header=vocab.RAW_COLUMNS):
    lines = [",".join(header)]
    for i in range(n):
        row = dict(
            Time="10:00:00", Date=f"2022-10-{i % 28 + 1:02d}", Sender_account=str(1000 + i),
            Receiver_account="0042", Amount="10.5", Payment_currency="UK pounds",
            Received_currency="Peso", Sender_bank_location="UK",
            Receiver_bank_location="Atlantis", Payment_type="Cash Deposit",
            Is_laundering=str(i % 2), Laundering_type="Fan_Out",
        )
        lines.append(",".join(row[c] for c in header))
    path.write_text("\n".join(lines) + "\n")


def test_raw_csv_to_dataset(spark, tmp_path):
    path = tmp_path / "raw.csv"
    raw_csv(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        raw = files.read_labelled_csv(spark, str(path))
        assert raw.select("_block").distinct().count() > 2
        C.check_raw(raw)
        rows = C.from_raw(C.with_source_row(raw)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 << 20))
    assert len(rows) == 200
    for r in rows:
        assert int(r["transaction_id"][6:]) == int(r["sender_account"]) - 1000
    first = rows[0]
    assert (first["amount"], first["payment_currency"], first["received_currency"]) == (
        525.0, "TRY", "unknown")
    assert first["receiver_account"] == "0042" and first["sender_country"] == "TR"
    raw_csv(tmp_path / "short.csv", 3, vocab.RAW_COLUMNS[:-1])
    with pytest.raises(C.InputError):
        files.read_labelled_csv(spark, str(tmp_path / "short.csv"))


def test_dataset_write_reads_only_one_split(spark, tmp_path):
    path = tmp_path / "raw.csv"
    raw_csv(path)
    rows = C.from_raw(C.with_source_row(files.read_labelled_csv(spark, str(path))))
    rows = B.assign_split(rows, B.split_boundaries(rows))
    target = str(tmp_path / "set")
    files.write_dataset(rows, target)
    test = files.read_dataset(spark, target, ["test"], ["amount", "split"])
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan or "PartitionFilters: [(split" in plan
    assert test.columns == ["amount", "split"] and test.count() > 0
    with pytest.raises(C.InputError):
        files.read_dataset(spark, target, ["other"])
    one = files.cache_features(rows, str(tmp_path / "f"), "id1")
    assert one.count() == 200
    assert files.cache_features(rows.limit(1), str(tmp_path / "f"), "id1").count() == 200


def test_groups_and_reports(spark, tmp_path):
    group = FeatureGroup("g", "e", "ts", ("v",))
    df = spark.createDataFrame([("a", START, 1)], "e string, ts timestamp, v int")
    for _ in range(2):
        files.ingest(group, df, str(tmp_path))
    assert files.read_group(spark, group, str(tmp_path)).count() == 2
    for i in range(3):
        files.append_report(df, str(tmp_path / "r"), "data", f"R{i}", f"2024-01-0{i + 1}")
    found = files.list_reports(spark, str(tmp_path / "r"), "data", 2).collect()
    assert [r["report_id"] for r in found] == ["R2", "R1"]


def run(writer, checkpoint):
    writer.option("checkpointLocation", str(checkpoint)).trigger(
        availableNow=True).start().awaitTermination()


def test_messages(spark, tmp_path):
    topic = tmp_path / "topic"
    topic.mkdir()
    good = {"transaction_id": "T1", "amount": 5.0}
    (topic / "a.txt").write_text(json.dumps(good) + "\nnot json\n")
    parsed = streams.parse_messages(streams.read_messages(spark, "text", {}, str(topic)))
    seen = {}

    def handle(batch, _):
        seen["good"] = [r["transaction_id"] for r in streams.good_messages(batch).collect()]
        seen["bad"] = [r["value"] for r in streams.bad_messages(batch).collect()]

    run(parsed.writeStream.foreachBatch(handle), tmp_path / "c")
    assert seen == {"good": ["T1"], "bad": ["not json"]}


def in_parts(df, folder, parts, order):
    """Write rows in order into ``parts`` folders that a stream reads one by one."""
    rows = df.orderBy(*order).collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        part = df.sparkSession.createDataFrame(rows[i * size : (i + 1) * size], df.schema)
        part.coalesce(1).write.mode("append").parquet(str(folder))
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(
        str(folder))


def test_online_history_equals_batch(spark, tmp_path):
    rows = canonical(spark, events(11, 120)).select(*schemas.CANONICAL_COLUMNS, "seq")
    wanted = vectors(build_features(rows))
    stream = in_parts(rows, tmp_path / "in", 3, ["timestamp", "transaction_id", "seq"])
    history = OnlineHistory(spark, str(tmp_path / "history"))
    out = str(tmp_path / "out")

    def handle(batch, batch_id):
        for _ in range(2 if batch_id == 1 else 1):  # a repeated batch changes nothing
            scored = history.score_and_record(batch, batch_id)
        scored.write.mode("overwrite").parquet(f"{out}/b={batch_id}")

    run(stream.writeStream.foreachBatch(handle), tmp_path / "c")
    assert vectors(spark.read.parquet(out)) == wanted


def test_late_and_repeated_rows_of_a_stream(spark, tmp_path):
    """No row is lost however late, none is taken twice, and a repeated batch changes nothing."""
    day = timedelta(days=1)
    batches = [
        [("a", START), ("b", START + day), ("a", START + 2 * day)],
        [("c", START + 40 * day), ("b", START + day)],
        [("d", START - 20 * day), ("c", START + 41 * day), ("e", START + 50 * day)],
        [("d", START - 20 * day), ("d", START + 30 * day), ("f", START + 49 * day)],
        [],
    ]
    seen = SeenIds(spark, str(tmp_path / "seen"))
    taken = []
    for number, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "transaction_id string, timestamp timestamp")
        for _ in range(2 if number == 2 else 1):
            new = sorted(r["transaction_id"] for r in seen.take(frame, number).collect())
        taken.append(new)
    # Within a batch an id counts once; the copy of "d" 50 days away is no copy, but its batch has one.
    assert taken == [["a", "b"], ["c"], ["d", "e"], ["f"], []]
    counts = {r["batch_id"]: (r["rows"], r["kept"], r["repeated"], r["late"]) for r in seen.counts().collect()}
    assert counts == {0: (3, 2, 1, 0), 1: (2, 1, 1, 1), 2: (3, 2, 1, 1), 3: (3, 1, 2, 3), 4: (0, 0, 0, 0)}


def test_model_watch_scores_like_a_batch(spark, tmp_path):
    rows = received(spark, 50).withColumn("seq", F.regexp_extract("transaction_id", "[0-9]+", 0).cast("long"))
    model = stored_model()
    canonical_rows = accepted(canonicalize(from_received(rows), keep=("seq",)))
    wanted = {
        r["transaction_id"]: round(r["score"], 9)
        for r in explain_linear(build_features(canonical_rows), model).collect()
    }
    stream = in_parts(rows, tmp_path / "in", 3, ["timestamp", "transaction_id"])
    found, silent = {}, []
    watch = J.ModelWatch(
        OnlineHistory(spark, str(tmp_path / "h")), lambda f: explain_linear(f, model), 0.0, "v")
    blind = J.ModelWatch(OnlineHistory(spark, str(tmp_path / "b")), None, 0.0, "v")

    def handle(batch, batch_id):
        for r in watch.alerts(batch, batch_id).select("transaction_id", "confidence").collect():
            found[r["transaction_id"]] = round(r["confidence"], 9)
        silent.append(blind.alerts(batch, batch_id))

    run(stream.writeStream.foreachBatch(handle), tmp_path / "c")
    assert found == wanted and len(silent) == 3 and not any(silent)
    assert spark.read.parquet(str(tmp_path / "b" / "events")).count() == 50


def received(spark, n=60):
    cities = ("Istanbul", "Tokyo", "Paris", "Nowhere")
    rng = random.Random(13)
    rows = [
        (f"T{i:03d}", START + timedelta(minutes=17 * i), f"S{rng.randrange(9)}",
         f"S{rng.randrange(9)}", rng.choice(cities), float(i + 1),
         "casino" if i % 9 == 0 else "rent")
        for i in range(n)
    ]
    df = spark.createDataFrame(
        rows, "transaction_id string, timestamp timestamp, sender_iban string, "
        "receiver_iban string, sender_city string, amount double, description string")
    empty = F.lit("")
    return df.withColumns({
        "sender_name": empty, "receiver_name": empty, "receiver_city": empty,
        "currency": F.lit("TRY"), "fraud_type": F.lit("none")})


def test_stream_detection_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    rows = received(spark)
    stream = in_parts(rows, tmp_path / "in", 2, ["timestamp", "transaction_id"])
    options = DetectionOptions(ring_max_hops=3)
    wanted = {
        (r["transaction_id"], r["fraud_type"])
        for r in D.run_detectors(rows, options).collect()
    }
    sent = []
    writers = J.detection_writers(
        stream, str(tmp_path / "alerts"), str(tmp_path / "edges"), str(tmp_path / "c"), options,
        publish=lambda messages: sent.extend(r["key"] for r in messages.collect()))
    for writer in writers:
        writer.trigger(availableNow=True).start().awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "alerts"))
    found = {(r["transaction_id"], r["fraud_type"]) for r in stored.collect()}
    assert found == wanted and len(sent) == len(wanted)
    assert {k for _, k in wanted} == {"circular_ring", "impossible_travel", "blacklist_keyword"}
    travel = travel_stream(stream, options)
    assert travel.isStreaming


def test_waves_are_one_batch_each(spark, tmp_path):
    """Waves of one row and of many, and rows without a wave, each end with their batch."""
    from finsieve.plans.streams import _in_waves

    rows = [(i, 0) for i in range(300)] + [(1000, 1)] + [(2000 + i, 2) for i in range(5)] + [(9, None)]
    frame = spark.createDataFrame(rows, "id long, wave long").coalesce(1)
    read = {}

    def handle(batch, batch_id):
        read[batch_id] = (sorted(r["id"] for r in batch.collect()), batch.rdd.getNumPartitions())

    run(_in_waves(spark, frame, "wave", "test-waves").writeStream.foreachBatch(handle), tmp_path / "c")
    assert [read[i][0] for i in sorted(read)] == [
        [9], list(range(300)), [1000], [2000 + i for i in range(5)]]
    assert read[1][1] > 1  # a span of one input file is no longer one task


def test_travel_state_is_shared_by_buckets(spark, tmp_path):
    """As many senders as there are in a bucket: one call, the right last place, late rows too."""
    from finsieve.streaming import travel

    rows = received(spark, 60).withColumn(
        "sender_iban", F.concat("sender_iban", F.lit("-"), F.col("amount").cast("int") % 50))
    rows = rows.unionByName(rows.withColumns({
        "transaction_id": F.concat("transaction_id", F.lit("b")), "sender_city": F.lit("Tokyo"),
        "timestamp": F.col("timestamp") + F.expr("INTERVAL 1 HOUR")}))
    rows = rows.unionByName(rows.limit(1).withColumns({
        "transaction_id": F.lit("none"), "timestamp": F.lit(None).cast("timestamp")}))
    wanted = {r["transaction_id"] for r in D.impossible_travel(rows.where("timestamp IS NOT NULL")).collect()}
    stream = in_parts(rows, tmp_path / "in", 2, ["timestamp", "transaction_id"])
    found = travel_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    run(found, tmp_path / "c")
    got = [r["transaction_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(wanted) > 10 and sorted(got) == sorted(wanted)
    states = spark.read.format("statestore").load(str(tmp_path / "c")).count()
    assert 0 < states <= travel.BUCKETS
