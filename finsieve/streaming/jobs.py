"""Continuous jobs: detection by rules and model, duplicates, rate rules, drift watch, counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from finsieve.operators import detectors as D
from finsieve.operators import drift as drift_ops
from finsieve.operators.alerts import alert_messages
from finsieve.operators.canonical import accepted, canonicalize, from_received
from finsieve.operators.ordering import mark_first
from finsieve.options import DetectionOptions
from finsieve.session import cut_lineage
from finsieve.sources.alert_store import write_alerts
from finsieve.sources.files import path_exists
from finsieve.streaming.online import OnlineHistory
from finsieve.streaming.travel import travel_stream


# --- duplicates --------------------------------------------------------------------------------
def deduplicated(rows: DataFrame, horizon: str = "7 days") -> DataFrame:
    """First copy of each transaction id; ids are remembered for the horizon of event time.

    For streams in order: rows older than the horizon are dropped. :class:`SeenIds` keeps them.
    """
    return rows.withWatermark("timestamp", horizon).dropDuplicatesWithinWatermark(
        ["transaction_id"]
    )


# --- rings over stored edges -------------------------------------------------------------------------------
def edges_near(edges: DataFrame, accounts: DataFrame, hops: int) -> DataFrame:
    """Edges that can lie on a ring of up to ``hops`` transfers through ``accounts(node)``."""

    def reach(start: str, end: str) -> DataFrame:
        seen = accounts.select("node").distinct()
        for _ in range(hops - 1):
            ahead = edges.join(
                seen.select(F.col("node").alias(start)), start, "left_semi"
            ).select(F.col(end).alias("node"))
            seen = cut_lineage(seen.unionByName(ahead).distinct())
        return seen

    forward = reach("src", "dst").select(F.col("node").alias("src"))
    backward = reach("dst", "src").select(F.col("node").alias("dst"))
    return edges.join(forward, "src", "left_semi").join(backward, "dst", "left_semi")


class RingWatch:
    """Ring alerts per micro-batch against a stored table of recent transfers."""

    def __init__(self, path: str, options: DetectionOptions = DetectionOptions()) -> None:
        self._path = path.rstrip("/")
        self._options = options

    def alerts(self, batch: DataFrame, batch_id: int) -> DataFrame | None:
        """Detections of the batch's transactions; its rows join the stored table."""
        spark = batch.sparkSession
        # A message delivered again is one transfer, not two.
        order = ["timestamp", *[c for c in ("seq",) if c in batch.columns]]
        batch = mark_first(batch, "transaction_id", order).where("is_first").drop("is_first")
        batch = cut_lineage(batch.dropDuplicates(["transaction_id"]))
        span = batch.agg(F.min("timestamp")).first()[0]
        if span is None:
            return None
        rows = batch
        if path_exists(spark, self._path):
            window = F.expr(f"INTERVAL {self._options.ring_window_hours} HOURS")
            since = F.lit(span) - window
            stored = spark.read.parquet(self._path).where(F.col("batch_id") < batch_id)
            recent = stored.where(
                (F.col("day") >= F.to_date(since)) & (F.col("timestamp") > since)
            )
            recent = recent.select(*batch.columns)
            known = recent.select("transaction_id")
            batch = cut_lineage(batch.join(known, "transaction_id", "left_anti"))
            rows = recent.unionByName(batch.select(*recent.columns))
        senders = batch.select(F.col("sender_iban").alias("node"))
        named = rows.withColumnsRenamed({"sender_iban": "src", "receiver_iban": "dst"})
        near = edges_near(named, senders, self._options.ring_max_hops)
        near = near.withColumnsRenamed({"src": "sender_iban", "dst": "receiver_iban"})
        found = D.ring_alerts(near.select(*batch.columns), self._options)
        mine = batch.select("transaction_id").distinct()
        found = cut_lineage(found.join(mine, "transaction_id", "left_semi"))
        batch.withColumn("day", F.to_date("timestamp")).write.mode("overwrite").partitionBy(
            "day"
        ).parquet(f"{self._path}/batch_id={batch_id}")
        return found


# --- model -----------------------------------------------------------------------------------------
class ModelWatch:
    """Model alerts per micro-batch: history features against the stored past, then scores.

    ``explain`` adds score (and base_value, top_features) to feature rows; without it the
    history still grows and nothing is scored. Repeated ids leave no trace in the history
    and raise nothing.
    """

    def __init__(
        self, history: OnlineHistory, explain: Callable[[DataFrame], DataFrame] | None,
        threshold: float, version: str,
    ) -> None:
        self._history, self._explain = history, explain
        self._threshold, self._version = threshold, version

    def alerts(
        self, batch: DataFrame, batch_id: int, options: DetectionOptions = DetectionOptions()
    ) -> DataFrame | None:
        """Detections of a batch of received rows with ``seq``, None without a model."""
        batch = cut_lineage(batch)
        rows = accepted(canonicalize(from_received(batch), keep=("seq",)))
        features = self._history.score_and_record(rows, batch_id)
        if self._explain is None:
            return None
        first = self._history.recorded(batch_id).select("seq", F.lit(True).alias("is_first"))
        scored = self._explain(features).join(first, "seq")
        return D.model_alerts(batch, scored, self._threshold, self._version, options)


# --- detection job --------------------------------------------------------------------------------
def detection_writers(
    rows: DataFrame, alert_path: str, edge_path: str, checkpoint: str,
    options: DetectionOptions = DetectionOptions(),
    publish: Callable[[DataFrame], None] | None = None, model: ModelWatch | None = None,
) -> list[DataStreamWriter]:
    """Writers of the continuous detection job, one query per detector family; the model's
    only if there is a ``model`` watch.

    Each query stores new alerts once per (transaction, type) and hands the batch's
    alert messages to ``publish``. Start them with the trigger of your choice. As they
    commit files at the same time, each has a folder ``detector=<name>`` of its own below
    ``alert_path``; all of them are read as one table with the column ``detector``.
    """

    def store(detections: DataFrame, name: str) -> None:
        alerts = cut_lineage(D.to_alerts(detections.select(*_columns(detections))))
        write_alerts(alerts, f"{alert_path.rstrip('/')}/detector={name}")
        if publish is not None:
            publish(alert_messages(alerts))

    def words(batch: DataFrame, batch_id: int) -> None:
        store(D.blacklisted(batch, options), "words")

    def travel(batch: DataFrame, batch_id: int) -> None:
        store(batch, "travel")

    watch = RingWatch(edge_path, options)

    def rings(batch: DataFrame, batch_id: int) -> None:
        found = watch.alerts(batch, batch_id)
        if found is not None:
            store(found, "rings")

    def scores(batch: DataFrame, batch_id: int) -> None:
        found = model.alerts(batch, batch_id, options)
        if found is not None:
            store(found, "model")

    def writer(df: DataFrame, handle, name: str) -> DataStreamWriter:
        return df.writeStream.foreachBatch(handle).option(
            "checkpointLocation", f"{checkpoint.rstrip('/')}/{name}"
        )

    writers = [
        writer(rows, words, "words"),
        writer(travel_stream(rows, options), travel, "travel"),
        writer(rows, rings, "rings"),
    ]
    return writers if model is None else [*writers, writer(rows, scores, "model")]


def _columns(detections: DataFrame) -> list[str]:
    return [c for c in detections.columns if not c.startswith("_")]


def publish_alerts(alerts: DataFrame, target: str, options: dict[str, str]) -> DataStreamWriter:
    """Stream of alerts to keyed JSON messages on a topic, or to text files of JSON lines."""
    messages = alert_messages(alerts)
    if target == "text":
        messages = messages.select("value")
    return messages.writeStream.format(target).options(**options)


# --- rate rules --------------------------------------------------------------------------------
def rate_windows(
    rows: DataFrame, time: str, hit: Column, width: str = "5 minutes", every: str = "30 seconds"
) -> DataFrame:
    """(window_end, rows, hits, ratio) of sliding windows, batch or streaming."""
    slid = F.window(time, width, every)
    return rows.groupBy(slid.alias("w")).agg(
        F.count("*").alias("rows"), F.count_if(hit).alias("hits")
    ).select(
        F.col("w.end").alias("window_end"), "rows", "hits",
        (F.col("hits") / F.col("rows")).alias("ratio"),
    )


def held(windows: DataFrame, firing: Column, every_seconds: int = 30, hold: int = 5) -> DataFrame:
    """Windows at which the rule held for ``hold`` evaluations in a row without a gap:
    held for two minutes, an evaluation every 30 seconds, is true at 0, 30, 60, 90 and 120.

    Rows are one per evaluation time. They are spread by day; the few rows at the start
    of a day see the end of the day before through copies.
    """
    t = F.unix_seconds("window_end")
    day = F.floor(t / 86_400)
    marked = windows.select("*", firing.alias("firing"), t.alias("_t"), day.alias("_day"))
    tail = (F.pmod("_t", F.lit(86_400)) >= 86_400 - hold * every_seconds)
    copies = marked.where(tail).withColumns({"_day": F.col("_day") + 1, "_own": F.lit(False)})
    rows = marked.withColumn("_own", F.lit(True)).unionByName(copies)
    order = Window.partitionBy("_day").orderBy("_t").rangeBetween(
        -(hold - 1) * every_seconds, 0
    )
    streak = F.count_if("firing").over(order)
    return rows.withColumn("_streak", streak).where(
        F.col("_own") & (F.col("_streak") == hold)
    ).drop("_t", "_day", "_own", "_streak", "firing")


def high_fraud_rate(rows: DataFrame, time: str, fraud: Column, limit: float = 0.1) -> DataFrame:
    """Evaluation times at which the fraud share of five minutes stayed above the limit."""
    return held(rate_windows(rows, time, fraud), F.col("ratio") > limit)


def high_error_rate(rejects: DataFrame, time: str, per_second: float = 10.0) -> DataFrame:
    """Evaluation times at which more errors per second than allowed kept coming in."""
    windows = rate_windows(rejects, time, F.lit(True))
    return held(windows, F.col("hits") / 300.0 > per_second)


# --- drift watch --------------------------------------------------------------------------------
class DriftWatch:
    """Checks the newest ``size`` rows against a reference once that many have come."""

    def __init__(
        self, reference: DataFrame, path: str, time: str, size: int = 1000,
        categorical: tuple[str, ...] = (), threshold: float = 0.05,
    ) -> None:
        self._reference, self._path, self._time = reference, path.rstrip("/"), time
        self._size, self._categorical, self._threshold = size, categorical, threshold

    def add(self, batch: DataFrame, batch_id: int) -> DataFrame | None:
        """Report after this batch, or None while the window is not full."""
        spark = batch.sparkSession
        rows = batch.withColumn("_batch", F.lit(batch_id).cast("long"))
        # Equal times are common; all columns together leave no tie but equal rows.
        newest = [F.desc(self._time), F.desc("_batch"), F.desc(F.struct(*sorted(batch.columns)))]
        if batch_id > 0 and path_exists(spark, f"{self._path}/window={batch_id - 1}"):
            rows = spark.read.parquet(f"{self._path}/window={batch_id - 1}").unionByName(rows)
        kept = rows.orderBy(*newest).limit(self._size)
        target = f"{self._path}/window={batch_id}"
        kept.write.mode("overwrite").parquet(target)
        window = spark.read.parquet(target)
        if window.count() < self._size:
            return None
        features = drift_ops.feature_report(
            self._reference, window.drop("_batch"), self._categorical, (self._time,),
            self._threshold,
        )
        return drift_ops.data_recommendations(drift_ops.data_report(features))


# --- live view --------------------------------------------------------------------------------
def live_view(alerts: DataFrame) -> DataFrame:
    """Streaming tallies per type and severity, for complete mode."""
    return alerts.groupBy("fraud_type", "severity").agg(
        F.count("*").alias("alerts"), F.max("detected_at").alias("latest")
    )
