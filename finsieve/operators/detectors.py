"""Detectors: ring, impossible travel, blacklist, model score, and declared patterns.

Each detector takes received transactions (``timestamp`` already a timestamp) and
returns detections: the transaction's columns plus ``fraud_type, severity,
confidence, description, details`` (JSON), ``detector_type, detector_version,
contribution`` and related ids. :func:`to_alerts` turns detections into alerts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsieve import vocab
from finsieve.functions import scalars as S
from finsieve.operators import graph as G
from finsieve.operators import rings as R
from finsieve.operators.ordering import (
    HOT_ROWS,
    NOT_CHUNKED,
    has_hot_key,
    hot_keys,
    running_before,
)
from finsieve.options import DetectionOptions

PARTY_COLUMNS = (
    "transaction_id", "timestamp", "sender_iban", "sender_name", "sender_city",
    "receiver_iban", "receiver_name", "receiver_city", "amount", "currency",
)


def _party(rows: DataFrame) -> list[Column]:
    present = set(rows.columns)
    return [
        F.col(c) if c in present else F.lit(None).cast("string").alias(c) for c in PARTY_COLUMNS
    ]


def _detection(
    rows: DataFrame, fraud_type: str, severity: Column, confidence: Column, description: Column,
    details: Column, detector: str, version: Column | None = None, accounts: Column | None = None,
    transactions: Column | None = None, contribution: float = 0.0,
) -> DataFrame:
    no_ids = F.lit(None).cast("array<string>")
    return rows.select(
        *_party(rows),
        F.lit(fraud_type).alias("fraud_type"),
        severity.alias("severity"),
        confidence.alias("confidence"),
        description.alias("description"),
        F.to_json(details).alias("details"),
        F.lit(detector).alias("detector_type"),
        (F.lit("1.0.0") if version is None else version).alias("detector_version"),
        F.lit(contribution).alias("contribution"),
        (no_ids if accounts is None else accounts).alias("related_accounts"),
        (no_ids if transactions is None else transactions).alias("related_transactions"),
    )


# --- impossible travel ----------------------------------------------------------------------------
def with_last_location(
    rows: DataFrame, hot_rows: int = HOT_ROWS, chunk_us: int = S.DAY_US
) -> DataFrame:
    """Rows with a known city plus ``here`` and ``last``: the sender's previous location.

    Rows from unknown cities neither are checked nor move the sender.
    """
    t = F.unix_micros("timestamp")
    rows = rows.withColumn("_point", S.city_point(F.col("sender_city")))
    known = rows.where(F.col("_point").isNotNull()).withColumn(
        "here",
        F.struct(
            t.alias("t"), F.col("transaction_id").alias("id"),
            F.col("sender_city").alias("city"), F.col("_point.lat").alias("lat"),
            F.col("_point.lon").alias("lon"),
        ),
    ).drop("_point")
    chunk = None
    if has_hot_key(known, ("sender_iban",), hot_rows):
        # The list holds at most rows / hot_rows senders.
        hot = hot_keys(known, "sender_iban", hot_rows).withColumn("_hot", F.lit(True))
        slot = F.when(F.col("_hot"), F.floor(t / chunk_us)).otherwise(F.lit(NOT_CHUNKED))
        known = known.join(F.broadcast(hot), "sender_iban", "left")
        known, chunk = known.withColumn("_chunk", slot.cast("long")).drop("_hot"), "_chunk"
    # The latest of all earlier rows is the previous one.
    seen = running_before(
        known, ["sender_iban"], chunk, [F.col("here")], {"last": ("max", F.col("here"))}
    )
    return seen.drop("_chunk")


def travel_details(here: Column, last: Column) -> dict[str, Column]:
    """Distance, elapsed time and needed speed between two locations."""
    km = S.haversine_km(last["lat"], last["lon"], here["lat"], here["lon"])
    elapsed = (here["t"] - last["t"]) / float(S.HOUR_US)
    hours = F.when(elapsed <= 0, F.lit(vocab.MIN_ELAPSED_HOURS)).otherwise(elapsed)
    return {"km": km, "hours": hours, "speed": km / hours}


def impossible_travel(
    rows: DataFrame, options: DetectionOptions = DetectionOptions(), **scale
) -> DataFrame:
    """Transactions whose sender cannot have come from the last location in time."""
    moved = with_last_location(rows, **scale)
    ttl = options.location_ttl_hours * S.HOUR_US
    here, last = F.col("here"), F.col("last")
    moved = moved.where(last.isNotNull() & (here["t"] - last["t"] <= ttl))
    return travel_detections(moved, options)


def travel_detections(moved: DataFrame, options: DetectionOptions) -> DataFrame:
    """Detections from rows that carry ``here`` and ``last``."""
    here, last = F.col("here"), F.col("last")
    moved = moved.withColumns(
        {f"_{name}": col for name, col in travel_details(here, last).items()}
    ).where(F.col("_speed") > options.max_travel_speed_kmh)
    km, speed = F.round("_km", 2), F.round("_speed", 2)
    minutes = F.round(F.col("_hours") * 60, 2)
    details = F.struct(
        last["city"].alias("from_city"), here["city"].alias("to_city"),
        F.array(last["lat"], last["lon"]).alias("from_coords"),
        F.array(here["lat"], here["lon"]).alias("to_coords"),
        km.alias("distance_km"), F.round("_hours", 4).alias("time_elapsed_hours"),
        minutes.alias("time_elapsed_minutes"), speed.alias("required_speed_kmh"),
        F.lit(options.max_travel_speed_kmh).alias("max_allowed_speed_kmh"),
        last["id"].alias("last_transaction_id"),
    )
    text = F.format_string(
        "Impossible travel detected: %s → %s (%s km in %s min = %s km/h)",
        last["city"], here["city"], km.cast("string"), minutes.cast("string"),
        speed.cast("string"),
    )
    return _detection(
        moved, "impossible_travel", F.lit("high"), F.lit(0.90), text, details, "geo_analysis"
    )


# --- blacklist --------------------------------------------------------------------------------
def blacklisted(rows: DataFrame, options: DetectionOptions = DetectionOptions()) -> DataFrame:
    """Transactions whose description contains a listed word."""
    words = S.found_keywords(F.col("description"), options.blacklist)
    hits = rows.withColumn("_words", words).where(F.size("_words") > 0)
    critical = F.array(*[F.lit(w) for w in options.critical_words])
    severity = F.when(F.arrays_overlap("_words", critical), "critical").otherwise("medium")
    text = F.concat(
        F.lit("Suspicious keywords detected in description: "), F.concat_ws(", ", "_words")
    )
    details = F.struct(
        F.col("_words").alias("keywords_found"),
        F.col("description").alias("original_description"),
    )
    return _detection(
        hits, "blacklist_keyword", severity, F.lit(0.85), text, details, "nlp_analysis"
    )


# --- rings --------------------------------------------------------------------------------
def ring_alerts(rows: DataFrame, options: DetectionOptions = DetectionOptions()) -> DataFrame:
    """Transactions whose sender lies on a ring at that moment, with the largest ring."""
    window_us = options.ring_window_hours * S.HOUR_US
    graph = R.Numbered(R.cycle_core(G._core(G.graph_edges(rows))), None)
    rings = R.closed_walks(
        graph, options.ring_min_hops, options.ring_max_hops, window_us, False, None
    )
    asked = rows.withColumn("_t", F.unix_micros("timestamp"))
    moments = asked.select(
        F.col("sender_iban").alias("account"), "transaction_id", F.col("_t").alias("t")
    ).distinct()
    best = R.largest_at(graph, rings, moments, window_us).select(
        F.col("account").alias("sender_iban"), "transaction_id", F.col("t").alias("_t"),
        F.struct("total", "ids", "path").alias("ring"),
    )
    hits = asked.join(best, ["sender_iban", "transaction_id", "_t"])
    path = F.concat(F.col("ring.path"), F.slice(F.col("ring.path"), 1, 1))
    details = F.struct(
        S.stable_id("RING", F.concat_ws(">", path)).alias("ring_id"),
        path.alias("ring_path"),
        F.col("ring.total").cast("double").alias("total_amount"),
        F.size("ring.ids").alias("transaction_count"),
    )
    text = F.concat(
        F.lit("Circular transaction ring detected: "),
        F.concat_ws(" → ", F.slice(path, 1, 4)), F.lit("..."),
    )
    return _detection(
        hits, "circular_ring", F.lit("critical"), F.lit(0.95), text, details, "graph_analysis",
        accounts=F.col("ring.path"), transactions=F.col("ring.ids"),
    )


# --- model --------------------------------------------------------------------------------
def model_severity(score: Column, critical: float = vocab.CRITICAL_SCORE) -> Column:
    return F.when(score >= critical, F.lit("critical")).otherwise(F.lit("high"))


def model_alerts(
    rows: DataFrame, scored: DataFrame | None, threshold: float, model_version: str,
    options: DetectionOptions = DetectionOptions(),
) -> DataFrame | None:
    """Scored transactions at or above the threshold; repeated ids raise nothing.

    ``scored`` has ``seq, transaction_id, score, is_first`` and optionally
    ``base_value, top_features, cold_start``. Without a model there are no alerts.
    """
    if scored is None:
        return None
    extra = [c for c in ("base_value", "top_features", "cold_start") if c in scored.columns]
    hits = rows.join(
        scored.where((F.col("score") >= threshold) & F.col("is_first")).select(
            "seq", "score", *extra
        ),
        "seq",
    )
    details = F.struct(
        F.lit(model_version).alias("model_version"),
        F.lit(vocab.FEATURE_SET_VERSION).alias("feature_set_version"),
        F.col("score"), F.lit(threshold).alias("threshold"),
        F.lit("log_odds").alias("contribution_unit"), *extra,
    )
    text = F.format_string("Fraud model flagged the transaction (score: %.2f)", F.col("score"))
    return _detection(
        hits, "ml_model", model_severity(F.col("score"), options.critical_score),
        F.col("score"), text, details, "ml_model", F.lit(model_version),
        transactions=F.array("transaction_id"), contribution=1.0,
    )


# --- declared patterns --------------------------------------------------------------------------------
def structuring(
    rows: DataFrame, options: DetectionOptions = DetectionOptions()
) -> DataFrame:
    """Sender and day with several amounts just under the limit and a sum above it."""
    limit = options.reporting_limit
    band = (F.col("amount") < limit) & (F.col("amount") >= limit * (1 - options.structuring_band))
    day = F.date_trunc("day", "timestamp").alias("day")
    return (
        rows.where(band)
        .groupBy("sender_iban", day)
        .agg(F.count("*").alias("transfers"), F.sum("amount").alias("total"))
        .where((F.col("transfers") >= options.structuring_min_count) & (F.col("total") > limit))
    )


def velocity_flags(
    features: DataFrame, options: DetectionOptions = DetectionOptions()
) -> DataFrame:
    """Velocity anomaly and mule-account marks on a feature matrix."""
    busy = F.col("sender_tx_count_24h") >= options.velocity_count_24h
    many = F.col("receiver_unique_senders_7d") >= options.mule_unique_senders_7d
    return features.withColumns({"velocity_anomaly": busy, "mule_account": many})


def high_value(rows: DataFrame, options: DetectionOptions = DetectionOptions()) -> DataFrame:
    return rows.where(F.col("amount") >= options.high_value_amount)


# --- alerts and counters --------------------------------------------------------------------------------
def to_alerts(detections: DataFrame) -> DataFrame:
    """Detections to alert records. The id follows from transaction and type."""
    none = F.lit(None)
    evidence = F.struct(
        "detector_type", "detector_version", "confidence", "contribution",
        F.col("description").alias("summary"), "details",
    )

    def text(name: str, default: str = "") -> Column:
        return F.coalesce(F.col(name), F.lit(default)).alias(name)

    return detections.select(
        S.stable_id("ALERT", F.col("transaction_id"), F.col("fraud_type")).alias("alert_id"),
        "fraud_type", "severity", "confidence", text("transaction_id"),
        text("sender_iban"), text("sender_name"), text("sender_city"),
        text("receiver_iban"), text("receiver_name"), text("receiver_city"),
        F.coalesce("amount", F.lit(0.0)).alias("amount"),
        text("currency", vocab.DEFAULT_CURRENCY),
        S.alert_title(F.col("fraud_type")).alias("title"), "description",
        F.array(evidence).alias("evidence"),
        F.coalesce("related_transactions", F.array().cast("array<string>"))
        .alias("related_transactions"),
        F.coalesce("related_accounts", F.array().cast("array<string>"))
        .alias("related_accounts"),
        none.cast("string").alias("case_id"),
        F.col("timestamp").alias("detected_at"),
        F.lit(False).alias("is_dismissed"),
    )


def run_detectors(
    rows: DataFrame, options: DetectionOptions = DetectionOptions(), *,
    rings: bool = True, travel: bool = True, words: bool = True,
    scored: DataFrame | None = None, threshold: float = 0.5, model_version: str = "none",
) -> DataFrame:
    """All detections in fixed engine order; a detector that is off adds nothing."""
    parts = [
        ring_alerts(rows, options) if rings else None,
        impossible_travel(rows, options) if travel else None,
        blacklisted(rows, options) if words else None,
        model_alerts(rows, scored, threshold, model_version, options),
    ]
    parts = [p for p in parts if p is not None]
    if not parts:
        return blacklisted(rows.limit(0), options)
    return reduce(DataFrame.unionByName, parts)


def detection_counters(rows: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: transactions, alerts per engine, and alerts per transaction."""
    kinds = {
        "circular_rings": "circular_ring", "impossible_travel": "impossible_travel",
        "blacklist_hits": "blacklist_keyword", "ml_model_hits": "ml_model",
    }
    counted = alerts.agg(
        F.count("*").alias("fraud_detected"),
        *[F.count_if(F.col("fraud_type") == kind).alias(name) for name, kind in kinds.items()],
    )
    # Two one-row results side by side.
    both = rows.agg(F.count("*").alias("transactions_processed")).crossJoin(counted)
    rate = F.when(
        F.col("transactions_processed") > 0,
        F.col("fraud_detected") / F.col("transactions_processed"),
    ).otherwise(0.0)
    return both.withColumn("fraud_rate", rate)
