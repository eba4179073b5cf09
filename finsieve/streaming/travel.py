"""Impossible travel on a stream: the last location of each sender is kept as state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from finsieve.functions import scalars as S
from finsieve.operators import detectors as D
from finsieve.options import DetectionOptions

#: Senders share state by bucket: a call of the state function costs milliseconds whatever its rows.
BUCKETS = 1024
#: JSON list of [sender, processing time at which it was last heard, at_us, id, city, lat, lon].
_STATE = "places STRING"
_COLUMNS = [
    "transaction_id", "timestamp", "sender_iban", "sender_name", "sender_city",
    "receiver_iban", "receiver_name", "receiver_city", "amount", "currency",
]
_ROW = """transaction_id STRING, timestamp TIMESTAMP, sender_iban STRING, sender_name STRING,
    sender_city STRING, receiver_iban STRING, receiver_name STRING, receiver_city STRING,
    amount DOUBLE, currency STRING, at_us LONG, lat DOUBLE, lon DOUBLE"""
_LAST = "last_us LONG, last_id STRING, last_city STRING, last_lat DOUBLE, last_lon DOUBLE"


def _follow(ttl_ms: int):
    """State function: pair every location with the sender's newest one known before it."""

    def handle(
        key: tuple[int], batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        known = {}
        if state.exists:
            known = {sender: (heard, tuple(p)) for sender, heard, *p in json.loads(state.get[0])}
        parts = [] if state.hasTimedOut else list(batches)
        if parts:
            rows = pd.concat(parts, ignore_index=True)
            rows = rows.sort_values(["at_us", "transaction_id", "sender_city"], kind="stable")
            before = []
            columns = ("sender_iban", "at_us", "transaction_id", "sender_city", "lat", "lon")
            for sender, *place in zip(*[rows[c].tolist() for c in columns]):
                _, last = known.get(sender, (now, None))
                here = tuple(place)
                before.append(last or (None,) * 5)
                # A late row is compared but never replaces a newer location.
                known[sender] = (now, here if last is None or here[:3] >= last[:3] else last)
            found = pd.DataFrame(
                before, columns=["last_us", "last_id", "last_city", "last_lat", "last_lon"],
                index=rows.index,
            )
            found["last_us"] = found["last_us"].astype("Int64")
            yield pd.concat([rows.drop(columns="_bucket"), found], axis=1)
        # Who was heard in this batch stays; the others only for their time to live.
        left = [[s, heard, *p] for s, (heard, p) in known.items() if heard + ttl_ms > now]
        if left:
            state.update((json.dumps(left),))
            state.setTimeoutDuration(min(heard for _, heard, *_ in left) + ttl_ms - now)
        elif state.exists:
            state.remove()

    return handle


def with_last_location(rows: DataFrame, ttl_hours: int = 24) -> DataFrame:
    """Stream twin of the batch operator: rows of known cities with ``here`` and ``last``.

    A sender's location is forgotten when nothing was heard for the time to live. Rows
    without a time have no place in the order.
    """
    point = S.city_point(F.col("sender_city"))
    known = rows.select(
        *_COLUMNS, F.unix_micros("timestamp").alias("at_us"), point["lat"].alias("lat"),
        point["lon"].alias("lon"),
    ).where(F.col("lat").isNotNull() & F.col("at_us").isNotNull())
    bucket = F.pmod(F.xxhash64("sender_iban"), F.lit(BUCKETS)).alias("_bucket")
    seen = known.select("*", bucket).groupBy("_bucket").applyInPandasWithState(
        _follow(ttl_hours * 3_600_000), f"{_ROW}, {_LAST}", _STATE, "append",
        GroupStateTimeout.ProcessingTimeTimeout,
    )

    def place(t: str, tid: str, city: str, lat: str, lon: str) -> F.Column:
        names = ("t", "id", "city", "lat", "lon")
        return F.struct(*[F.col(c).alias(n) for c, n in zip((t, tid, city, lat, lon), names)])

    here = place("at_us", "transaction_id", "sender_city", "lat", "lon")
    last = place("last_us", "last_id", "last_city", "last_lat", "last_lon")
    return seen.select(
        *_COLUMNS, here.alias("here"), F.when(F.col("last_us").isNotNull(), last).alias("last")
    )


def travel_stream(
    rows: DataFrame, options: DetectionOptions = DetectionOptions()
) -> DataFrame:
    """Impossible-travel detections of a stream of received transactions."""
    moved = with_last_location(rows, options.location_ttl_hours)
    here, last = F.col("here"), F.col("last")
    ttl = options.location_ttl_hours * S.HOUR_US
    fresh = last.isNotNull() & (here["t"] - last["t"] <= ttl)
    return D.travel_detections(moved.where(fresh), options)
