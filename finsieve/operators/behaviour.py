"""Per-account behaviour: hours, weekends, channels, devices, addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsieve.functions import scalars as S
from finsieve.operators.ordering import (
    HOT_ROWS,
    NOT_CHUNKED,
    has_hot_key,
    hot_keys,
    running_before,
)


def behaviour_features(
    rows: DataFrame, user: str, time: str, channel: str, device: str, address: str,
    hot_rows: int = HOT_ROWS, chunk_us: int = S.DAY_US,
) -> DataFrame:
    """One row per account.

    ``typical_tx_hour`` (earliest of the most common hours), ``login_hour_consistency``
    (its share), ``weekend_tx_ratio``, ``channel_distribution`` (shares by channel),
    ``device_change_frequency`` (changes per started week), ``ip_entropy`` (bits).

    Values are counted before anything is grouped by account, so an account arrives
    as one row per distinct value.
    """
    t = F.col(time)

    def fact(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))

    facts = F.array(
        fact("hour", S.utc_hour(t)), fact("channel", F.col(channel)),
        fact("address", F.col(address)), fact("weekend", S.weekday(t) >= 5),
    )
    counts = (
        rows.select(F.col(user).alias("account"), F.inline(facts))
        .where(F.col("value").isNotNull())
        .groupBy("account", "kind", "value").agg(F.count("*").alias("n"))
    )
    is_hour, is_channel = F.col("kind") == "hour", F.col("kind") == "channel"
    is_address = F.col("kind") == "address"
    n = F.col("n").cast("double")

    def total(which: Column) -> Column:
        return F.sum(F.when(which, n))

    best = F.max(F.when(is_hour, F.struct(n.alias("n"), (-F.col("value").cast("int")).alias("h"))))
    # Entropy from sums: log2(N) - sum(n * log2(n)) / N.
    bits = F.sum(F.when(is_address, n * F.log2(n)))
    shape = counts.groupBy("account").agg(
        (-best["h"]).alias("typical_tx_hour"),
        (best["n"] / total(is_hour)).alias("login_hour_consistency"),
        (
            F.coalesce(total((F.col("kind") == "weekend") & (F.col("value") == "true")), F.lit(0.0))
            / total(is_hour)
        ).alias("weekend_tx_ratio"),
        # One entry per channel of the bank.
        F.sort_array(F.collect_list(F.when(is_channel, F.struct("value", n.alias("n")))))
        .alias("_channels"),
        total(is_channel).alias("_channel_rows"),
        (F.log2(total(is_address)) - bits / total(is_address)).alias("ip_entropy"),
    )
    shares = F.map_from_entries(
        F.transform(
            "_channels", lambda c: F.struct(c["value"], c["n"] / F.col("_channel_rows"))
        )
    )
    changes = device_changes(rows, user, time, device, hot_rows, chunk_us)
    return shape.join(changes, "account", "left").select(
        F.col("account").alias(user), "typical_tx_hour", "login_hour_consistency",
        "weekend_tx_ratio", shares.alias("channel_distribution"), "device_change_frequency",
        F.greatest("ip_entropy", F.lit(0.0)).alias("ip_entropy"),
    )


def device_changes(
    rows: DataFrame, user: str, time: str, device: str, hot_rows: int, chunk_us: int
) -> DataFrame:
    """Changes of device between neighbouring events, per started week of activity."""
    seq = F.col("seq") if "seq" in rows.columns else F.lit(0)
    here = F.struct(
        F.unix_micros(time).alias("t"), seq.alias("s"), F.col(device).alias("device")
    )
    known = rows.where(F.col(device).isNotNull()).select(
        F.col(user).alias("account"), here.alias("here")
    )
    chunk = None
    if has_hot_key(known, ("account",), hot_rows):
        # The list holds at most rows / hot_rows accounts.
        hot = hot_keys(known, "account", hot_rows).withColumn("_hot", F.lit(True))
        slot = F.when(F.col("_hot"), F.floor(F.col("here.t") / chunk_us)).otherwise(NOT_CHUNKED)
        known = known.join(F.broadcast(hot), "account", "left")
        known, chunk = known.withColumn("_chunk", slot.cast("long")), "_chunk"
    seen = running_before(
        known, ["account"], chunk, [F.col("here")], {"last": ("max", F.col("here"))}
    )
    changed = F.count_if(F.col("last.device") != F.col("here.device"))
    span = F.max("here.t") - F.min("here.t")
    weeks = F.greatest(F.ceil(span / (7 * S.DAY_US)), F.lit(1))
    return seen.groupBy("account").agg((changed / weeks).alias("device_change_frequency"))
