"""Alert lists, statistics, dismissal, flows and live counters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsieve.functions import scalars as S
from finsieve.operators.ordering import newest_page

ALERT_KEYS = ("transaction_id", "fraud_type")


# --- filters --------------------------------------------------------------------------------
def filtered(
    df: DataFrame,
    equals: Mapping[str, object] | None = None,
    member: Mapping[str, Sequence[object]] | None = None,
    time_col: str | None = None,
    start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    """Optional filters joined by AND; a None value means no filter. Dates are inclusive."""
    for name, value in (equals or {}).items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    for name, values in (member or {}).items():
        if values is not None:
            df = df.where(F.col(name).isin(*values))
    if start is not None:
        df = df.where(F.col(time_col) >= start)
    if end is not None:
        df = df.where(F.col(time_col) <= end)
    return df


def list_alerts(
    alerts: DataFrame, page: int = 1, size: int = 20, start: Column | None = None,
    end: Column | None = None, **equals: object,
) -> tuple[DataFrame, DataFrame]:
    """One page, newest first, and the total of all matching alerts."""
    chosen = filtered(alerts, equals, None, "detected_at", start, end)
    return newest_page(chosen, "detected_at", "alert_id", page, size)


def alert_by_id(alerts: DataFrame, alert_id: str) -> DataFrame:
    return alerts.where(F.col("alert_id") == alert_id)


def alert_stats(
    alerts: DataFrame, start: Column | None = None, end: Column | None = None
) -> DataFrame:
    """Total, by type and by severity in one pass: (breakdown, value, alerts)."""
    rows = filtered(alerts, None, None, "detected_at", start, end)
    return _breakdown(rows, ("fraud_type", "severity"), "alerts")


def _breakdown(rows: DataFrame, by: Sequence[str], count: str) -> DataFrame:
    """Grouping sets: the total and one group per column, as (breakdown, value, count)."""
    sets = [[], *[[F.col(c)] for c in by]]
    grouped = rows.groupingSets(sets, *[F.col(c) for c in by]).agg(
        F.count("*").alias(count), F.grouping_id(*by).alias("_g")
    )
    full = (1 << len(by)) - 1
    kind, value = F.lit("total"), F.lit("all")
    for i, c in enumerate(by):
        mask = full - (1 << (len(by) - 1 - i))
        kind = F.when(F.col("_g") == mask, F.lit(c)).otherwise(kind)
        value = F.when(F.col("_g") == mask, F.col(c)).otherwise(value)
    return grouped.select(kind.alias("breakdown"), value.alias("value"), count)


def first_per_key(alerts: DataFrame, keys: Sequence[str] = ALERT_KEYS) -> DataFrame:
    """One alert per (transaction, type): the earliest, ties by id, parties and amount.

    Only these few columns are aggregated; the full rows follow by them.
    """
    order = ("detected_at", "alert_id", "sender_iban", "receiver_iban", "amount")
    order = [c for c in order if c in alerts.columns]
    kept = alerts.groupBy(*keys).agg(F.min(F.struct(*order)).alias("k")).select(*keys, "k.*")
    same = [*keys, *order]
    return alerts.join(kept, same, "left_semi").dropDuplicates(same)


def dismiss(alerts: DataFrame, log: DataFrame) -> DataFrame:
    """Apply a dismissal log ``alert_id, dismissed_by, dismissed_at, reason``; latest wins."""
    latest = (
        log.groupBy("alert_id")
        .agg(F.max(F.struct("dismissed_at", "dismissed_by", "reason")).alias("d"))
    )
    return alerts.drop("is_dismissed").join(latest, "alert_id", "left").select(
        *[c for c in alerts.columns if c != "is_dismissed"],
        F.col("d").isNotNull().alias("is_dismissed"),
        F.col("d.dismissed_by").alias("dismissed_by"),
        F.col("d.dismissed_at").alias("dismissed_at"),
        F.col("d.reason").alias("dismissed_reason"),
    )


# --- summaries --------------------------------------------------------------------------------
def transaction_summary(rows: DataFrame, alerts: DataFrame) -> DataFrame:
    """Processing result per transaction. A transaction has at most one alert per type."""
    found = first_per_key(alerts).groupBy("transaction_id").agg(
        F.sort_array(F.collect_list("alert_id")).alias("alert_ids"),
        F.max("confidence").alias("fraud_score"),
    )
    none = F.array().cast("array<string>")
    return rows.join(found, "transaction_id", "left").select(
        *rows.columns,
        F.col("fraud_score").isNotNull().alias("is_fraud"),
        F.coalesce("fraud_score", F.lit(0.0)).alias("fraud_score"),
        F.coalesce("alert_ids", none).alias("alert_ids"),
    )


def city_flows(alerts: DataFrame) -> DataFrame:
    """Alerts between known cities; a missing city gets the default of its side."""
    def side(name: str, default: str) -> Column:
        given = F.when(F.length(F.col(name)) > 0, F.col(name))
        return F.coalesce(given, F.lit(default))

    flows = alerts.select(
        side("sender_city", "Istanbul").alias("from_city"),
        side("receiver_city", "Ankara").alias("to_city"),
    )
    known = S.city_point(F.col("from_city")).isNotNull() & S.city_point(
        F.col("to_city")
    ).isNotNull()
    return flows.where(known).groupBy("from_city", "to_city").agg(F.count("*").alias("alerts"))


def system_stats(rows: DataFrame, alerts: DataFrame, cases: DataFrame) -> DataFrame:
    """One row of system-wide counts; the fraud rate is a percentage."""
    from finsieve import vocab

    is_open = F.col("status").isin(*vocab.OPEN_STATUSES)
    one_row = (
        rows.agg(F.count("*").alias("transactions_processed"))
        .crossJoin(
            alerts.agg(
                F.count_distinct("transaction_id").alias("fraud_detected"),
                F.count("*").alias("alerts_created"),
            )
        )
        .crossJoin(
            cases.agg(
                F.count_if(is_open).alias("cases_open"),
                F.count_if(~is_open).alias("cases_resolved"),
            )
        )
    )
    rate = F.when(
        F.col("transactions_processed") > 0,
        F.col("fraud_detected") / F.col("transactions_processed") * 100,
    ).otherwise(0.0)
    return one_row.withColumn("fraud_rate", F.round(rate, 2))


def live_counters(alerts: DataFrame) -> DataFrame:
    """Alerts per type and severity."""
    return alerts.groupBy("fraud_type", "severity").agg(F.count("*").alias("alerts"))


def newest_alerts(alerts: DataFrame, n: int = 10) -> DataFrame:
    return alerts.orderBy(F.desc("detected_at"), F.desc("alert_id")).limit(n)


def latest_ring(alerts: DataFrame) -> DataFrame:
    """The newest ring alert with its path and total, from the evidence."""
    details = F.col("evidence")[0]["details"]
    return newest_alerts(alerts.where(F.col("fraud_type") == "circular_ring"), 1).select(
        "alert_id",
        F.from_json(F.get_json_object(details, "$.ring_path"), "array<string>").alias("path"),
        F.get_json_object(details, "$.total_amount").cast("double").alias("total_amount"),
    )


def alert_messages(alerts: DataFrame) -> DataFrame:
    """Alerts as keyed JSON messages."""
    return alerts.select(
        F.col("alert_id").alias("key"), F.to_json(F.struct(*alerts.columns)).alias("value")
    )
