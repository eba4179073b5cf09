"""Queries that run the streaming jobs over the driver's tables until all is read."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsieve.operators import detectors as D
from finsieve.operators import training as M
from finsieve.operators.canonical import accepted, canonicalize, from_received
from finsieve.options import DetectionOptions
from finsieve.plans import tables as T
from finsieve.plans.alerts import _HALF_WALKS, _TRAVEL
from finsieve.plans.models import _SCORED, stored_model
from finsieve.plans.registry import query
from finsieve.plans.transactions import _HISTORY_SQL, _history_columns
from finsieve.session import work_folder
from finsieve.sources import streams
from finsieve.streaming import jobs as J
from finsieve.streaming.online import OnlineHistory
from finsieve.streaming.travel import travel_stream
from finsieve.streaming.unique import SeenIds

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_WAVE_FILES = 8


def _in_waves(spark: SparkSession, rows: DataFrame, wave: str, name: str) -> DataFrame:
    """``rows`` as a stream of one micro-batch per value of ``wave``, in order.

    The rows are read once and dealt out by wave; each wave then arrives as the same number
    of files, so that its batch is read by many tasks and ends where the wave does.
    """
    columns = [c for c in rows.columns if c != wave]
    staged, out = work_folder(spark, f"{name}-staged"), work_folder(spark, name)
    rows.write.partitionBy(wave).parquet(staged)
    held = spark.read.schema(rows.schema).parquet(staged)
    found = [r[0] for r in held.select(wave).distinct().collect()]  # calendar spans
    files = max(_WAVE_FILES, spark.sparkContext.defaultParallelism)
    arrived = 0
    for value in sorted(found, key=lambda v: (v is not None, v)):
        part = held.where(F.col(wave).eqNullSafe(F.lit(value))).select(*columns)
        part.repartition(files).write.mode("append").parquet(out)
        arrived += files
        # A wave of few rows may leave files out; empty ones take their places.
        while len(spark.read.schema(part.schema).parquet(out).inputFiles()) < arrived:
            part.limit(0).coalesce(1).write.mode("append").parquet(out)
    arriving = spark.readStream.schema(held.select(*columns).schema)
    return arriving.option("maxFilesPerTrigger", files).parquet(out)


def received_stream(spark: SparkSession, sf_dir: str, days: int = 8) -> DataFrame:
    """The events table as a stream of received transactions, in several micro-batches.

    Spans of some days are stored one after another and arrive in that order, so each
    batch but the first meets what the ones before have left.
    """
    events = T.table(spark, sf_dir, "events")
    span = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (days * 86_400))
    return T.received_rows(_in_waves(spark, events.withColumn("span", span), "span", "arrivals"))


def _run(writer, checkpoint: str | None = None) -> None:
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB for the queries started inside; the session is left as it was."""
    settings = {
        "spark.sql.streaming.stateStore.providerClass": _ROCKS,
        # State with processing-time timeouts asks for empty batches for ever; a run that
        # ends with its input must not wait for them.
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


@query(
    "F3 I1",
    T.with_ctes(
        _TRAVEL,
        """
        SELECT transaction_id, sender_iban, last.city AS from_city, sender_city AS to_city,
               last.id AS last_transaction_id
        FROM moves WHERE km / hours > 900
        """,
    ),
)
def stream_travel_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impossible travel with the last location of each sender as stream state."""
    out = work_folder(spark, "travel")
    with _state_store(spark):
        found = travel_stream(received_stream(spark, sf_dir))
        _run(found.writeStream.format("parquet").option("path", f"{out}/rows"), f"{out}/state")
    rows = spark.read.parquet(f"{out}/rows")
    place = F.from_json(
        "details", "from_city string, to_city string, last_transaction_id string"
    )
    return rows.select("transaction_id", "sender_iban", place.alias("d")).select(
        "transaction_id", "sender_iban", "d.*"
    )


#: Rows of the events table by the wave in which they arrive: eight days each, in order, but
#: every 37th event comes up to two waves (over two weeks) late and every 41st once more at the end.
_WAVES = """
spans AS (SELECT *, CAST(floor(epoch(ts) / 691200) AS BIGINT) AS span FROM events),
ends AS (SELECT max(span) AS final FROM spans),
arrivals AS (
  SELECT event_id, ts, CASE WHEN event_id % 37 = 5 THEN least(span + 2, final) ELSE span END AS wave
  FROM spans, ends
  UNION ALL
  SELECT event_id, ts, final FROM spans, ends WHERE event_id % 41 = 7),
timed AS (SELECT wave, date_trunc('hour', ts) AS t,
                 event_id - CASE WHEN event_id % 50 = 49 THEN 1 ELSE 0 END AS tid FROM arrivals)"""


def late_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream in waves, one micro-batch each, with late and repeated rows."""
    events = T.table(spark, sf_dir, "events")
    span = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (8 * 86_400))
    final = events.agg(F.max(span)).first()[0]
    late = F.when(F.col("event_id") % 37 == 5, F.least(span + 2, F.lit(final))).otherwise(span)
    again = events.where(F.col("event_id") % 41 == 7).withColumn("wave", F.lit(final))
    arriving = events.withColumn("wave", late).unionByName(again)
    return T.received_rows(_in_waves(spark, arriving, "wave", "waves"))


def _taken(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """First copies of :func:`late_stream` and the counts of its batches."""
    out = work_folder(spark, "unique")
    seen = SeenIds(spark, f"{out}/seen")

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = seen.take(batch, batch_id)
        rows.write.mode("overwrite").parquet(f"{out}/rows/batch_id={batch_id}")

    _run(late_stream(spark, sf_dir).writeStream.foreachBatch(handle), f"{out}/state")
    return spark.read.parquet(f"{out}/rows"), seen.counts()


@query(
    "C3",
    T.with_ctes(T.RECEIVED, "SELECT DISTINCT transaction_id FROM received"),
)
def stream_unique_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transaction ids of a stream with rows weeks late and repeated, each once."""
    return _taken(spark, sf_dir)[0].select("transaction_id")


@query(
    "C3 I4",
    T.with_ctes(
        _WAVES
        + """,
        latest AS (SELECT wave, max(max(t)) OVER (
          ORDER BY wave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM timed GROUP BY wave),
        firsts AS (SELECT tid, min(wave) AS wave FROM timed GROUP BY tid)""",
        """
        SELECT row_number() OVER (ORDER BY wave) - 1 AS batch_id, n AS rows, kept,
               n - kept AS repeated, late
        FROM (SELECT t.wave, count(*) AS n, count(*) FILTER (t.t < l.seen) AS late
              FROM timed t JOIN latest l ON l.wave = t.wave GROUP BY t.wave)
        JOIN (SELECT wave, count(*) AS kept FROM firsts GROUP BY wave) USING (wave)
        """,
    ),
)
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, first copies, repeated and late rows of every micro-batch."""
    return _taken(spark, sf_dir)[1]


@query(
    "D12 I4 I7",
    T.with_ctes(T.CANONICAL, _HISTORY_SQL.format(probes="tx", history="rec")),
)
def stream_history_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History features scored batch by batch against the recorded past."""
    out = work_folder(spark, "online")
    history = OnlineHistory(spark, f"{out}/history")
    rows = accepted(
        canonicalize(from_received(received_stream(spark, sf_dir)), keep=("seq",))
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        scored = history.score_and_record(batch, batch_id)
        scored.write.mode("overwrite").parquet(f"{out}/rows/batch_id={batch_id}")

    _run(rows.writeStream.foreachBatch(handle), f"{out}/state")
    return _history_columns(spark.read.parquet(f"{out}/rows"))


@query(
    "A4",
    T.with_ctes(
        T.RECEIVED,
        """
        SELECT transaction_id, amount, true AS parsed FROM received WHERE seq % 10 <> 3
        UNION ALL
        SELECT NULL, NULL, false FROM received WHERE seq % 10 = 3
        """,
    ),
)
def stream_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All transactions as JSON messages, every tenth one broken, parsed from a stream."""
    out = work_folder(spark, "messages")
    rows = T.received(spark, sf_dir)
    body = F.to_json(F.struct("transaction_id", "sender_iban", "receiver_iban", "amount"))
    broken = F.when(F.col("seq") % 10 == 3, F.concat(F.lit("{bad "), body)).otherwise(body)
    rows.select(broken.alias("value")).write.text(f"{out}/topic")
    parsed = streams.parse_messages(streams.read_messages(spark, "text", {}, f"{out}/topic"))
    flat = parsed.select(
        "parsed.transaction_id", "parsed.amount",
        F.col("parsed").isNotNull().alias("parsed"),
    )
    _run(flat.writeStream.format("parquet").option("path", f"{out}/rows"), f"{out}/state")
    return spark.read.parquet(f"{out}/rows")


@query(
    "A5 A6",
    T.with_ctes(
        T.RECEIVED,
        """
        SELECT DISTINCT 'ALERT-' || upper(substr(sha256(transaction_id || chr(31)
                 || 'blacklist_keyword'), 1, 12)) AS alert_id, transaction_id, 'medium' AS severity,
               sender_iban, list_contains(['error'], description) AS named
        FROM received WHERE description = 'error'
        """,
    ),
)
def stream_published_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword alerts published as messages and read back as alert rows from their stream."""
    out = work_folder(spark, "published")
    options = DetectionOptions(blacklist=("error",))
    alerts = D.to_alerts(D.blacklisted(received_stream(spark, sf_dir), options))
    _run(J.publish_alerts(alerts, "text", {"path": f"{out}/topic"}), f"{out}/state-out")
    got = streams.read_alert_messages(spark, "text", {}, f"{out}/topic")
    _run(got.writeStream.format("parquet").option("path", f"{out}/rows"), f"{out}/state-in")
    found = F.from_json(
        F.get_json_object(F.col("evidence")[0]["details"], "$.keywords_found"), "array<string>"
    )
    return spark.read.parquet(f"{out}/rows").select(
        "alert_id", "transaction_id", "severity", "sender_iban",
        F.array_contains(found, "error").alias("named"),
    ).distinct()


_RING_OF_THREE = _HALF_WALKS.split("rings AS (")[0].strip().rstrip(",")


@query(
    "I1 D12 F1 F3 F4 F5",
    T.with_ctes(
        _SCORED
        + ","
        + _TRAVEL.removeprefix(T.RECEIVED).lstrip(",\n")
        + """,
        edges AS (SELECT sender AS src, receiver AS dst, transaction_id AS id, ts, amount FROM rec),"""
        + _RING_OF_THREE,
        """
        SELECT transaction_id, 'ml_model' AS fraud_type, round(score, 6) AS confidence
        FROM scored WHERE score >= 0.6 AND is_first
        UNION ALL
        SELECT DISTINCT transaction_id, 'blacklist_keyword', 0.85 FROM received WHERE description = 'error'
        UNION ALL
        SELECT DISTINCT transaction_id, 'impossible_travel', 0.9 FROM moves WHERE km / hours > 900
        UNION ALL
        SELECT DISTINCT t.id, 'circular_ring', 0.95 FROM edges t JOIN w3 r ON r.last = r.root
          AND r.root = t.src AND (t.ts, t.id) >= r.k_max AND t.ts < r.t_min + INTERVAL 168 HOUR
        """,
    ),
)
def stream_detection_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four detectors over the same micro-batches; rings of three transfers in a week."""
    out = work_folder(spark, "job")
    options = DetectionOptions(blacklist=("error",), ring_max_hops=3)
    model = J.ModelWatch(
        OnlineHistory(spark, f"{out}/history"),
        lambda rows: M.explain_linear(rows, stored_model()), 0.6, "lr-1",
    )
    with _state_store(spark):
        writers = J.detection_writers(
            received_stream(spark, sf_dir, days=15), f"{out}/alerts", f"{out}/edges",
            f"{out}/state", options, model=model,
        )
        running = [w.trigger(availableNow=True).start() for w in writers]
        for job in running:
            job.awaitTermination()
    return spark.read.parquet(f"{out}/alerts").select(
        "transaction_id", "fraud_type", F.round("confidence", 6).alias("confidence")
    )


@query(
    "I6",
    T.with_ctes(
        T.CANONICAL,
        "SELECT transaction_id, CAST(epoch(ts) AS BIGINT) AS unix_time, amount, false AS scored FROM rec",
    ),
)
def stream_without_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's part of the job without a model: the history grows, nothing is scored."""
    out = work_folder(spark, "blind")
    watch = J.ModelWatch(OnlineHistory(spark, f"{out}/history"), None, 0.6, "none")
    scored = []

    def handle(batch: DataFrame, batch_id: int) -> None:
        scored.append(watch.alerts(batch, batch_id) is not None)

    _run(received_stream(spark, sf_dir).writeStream.foreachBatch(handle), f"{out}/state")
    return spark.read.parquet(f"{out}/history/events").select(
        "transaction_id", T.short_time(F.col("timestamp")).alias("unix_time"), "amount",
        F.lit(any(scored)).alias("scored"),
    )


@query(
    "A7 I1",
    T.with_ctes(
        T.RECEIVED,
        """
        SELECT DISTINCT 'ALERT-' || upper(substr(sha256(transaction_id || chr(31)
                 || 'blacklist_keyword'), 1, 12)) AS alert_id, transaction_id, 'medium' AS severity
        FROM received WHERE description = 'error'
        """,
    ),
)
def stream_keyword_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword alerts in the alert table, each once; the travel detector runs at the same time."""
    out = work_folder(spark, "detect")
    options = DetectionOptions(blacklist=("error",))
    with _state_store(spark):
        writers = J.detection_writers(
            received_stream(spark, sf_dir), f"{out}/alerts", f"{out}/edges", f"{out}/state", options
        )
        running = [w.trigger(availableNow=True).start() for w in writers[:2]]
        for job in running:
            job.awaitTermination()
    stored = spark.read.parquet(f"{out}/alerts").where("fraud_type = 'blacklist_keyword'")
    return stored.select("alert_id", "transaction_id", "severity")


_WINDOWS = """
marks AS (
  SELECT epoch_us(ts) AS us, event_type = 'error' AS hit FROM events),
ends AS (
  SELECT (us // 30000000 + r.i) * 30 AS window_end, hit FROM marks CROSS JOIN range(1, 11) AS r(i)),
windows AS (
  SELECT window_end, count(*) AS rows, count(*) FILTER (hit) AS hits FROM ends GROUP BY 1),
fired AS (SELECT *, CAST(hits AS DOUBLE) / rows > 0.1 AS firing FROM windows)"""


@query(
    "I2",
    T.with_ctes(
        _WINDOWS,
        """
        SELECT f.window_end, f.rows, f.hits FROM fired f
        WHERE (SELECT count(*) FROM fired p WHERE p.firing
               AND p.window_end BETWEEN f.window_end - 120 AND f.window_end) = 5
        """,
    ),
)
def high_fraud_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times at which the share of error events stayed above a tenth for two minutes."""
    rows = T.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = J.high_fraud_rate(rows, "ts", F.col("event_type") == "error")
    return found.select(F.unix_seconds("window_end").alias("window_end"), "rows", "hits")


@query(
    "I3",
    T.with_ctes(
        _WINDOWS.replace("FROM events", "FROM events WHERE event_type = 'error'"),
        """
        SELECT f.window_end, f.hits FROM windows f
        WHERE (SELECT count(*) FROM windows p WHERE p.hits / 300.0 > 0.009
               AND p.window_end BETWEEN f.window_end - 120 AND f.window_end) = 5
        """,
    ),
)
def high_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times at which rejects kept coming faster than allowed."""
    rows = T.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = J.high_error_rate(rows.where("event_type = 'error'"), "ts", 0.009)
    return found.select(F.unix_seconds("window_end").alias("window_end"), "hits")


@query(
    "H15",
    T.with_ctes(
        T.RECEIVED,
        """
        SELECT 'blacklist_keyword' AS fraud_type, 'medium' AS severity, count(*) AS alerts
        FROM received WHERE contains(description, 'i')
        """,
    ),
)
def stream_live_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running tallies of keyword alerts in complete mode."""
    out = work_folder(spark, "live")
    found = D.to_alerts(
        D.blacklisted(received_stream(spark, sf_dir), DetectionOptions(blacklist=("i",)))
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/view")

    writer = J.live_view(found).writeStream.outputMode("complete").foreachBatch(handle)
    with _state_store(spark):
        _run(writer, f"{out}/state")
    return spark.read.parquet(f"{out}/view").select("fraud_type", "severity", "alerts")


@query("I5", None)
def stream_drift_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of the newest thousand events against all of them."""
    out = work_folder(spark, "drift")
    names = ("timestamp", "amount", "seq")
    reference = T.received(spark, sf_dir).select(*names)
    watch = J.DriftWatch(reference, f"{out}/windows", "timestamp")

    def handle(batch: DataFrame, batch_id: int) -> None:
        report = watch.add(batch.select(*names), batch_id)
        if report is not None:
            report.drop("drifted").write.mode("overwrite").parquet(f"{out}/reports")

    _run(received_stream(spark, sf_dir).writeStream.foreachBatch(handle), f"{out}/state")
    return spark.read.parquet(f"{out}/reports")
