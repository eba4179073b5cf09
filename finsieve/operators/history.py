"""Account-history features with exact window edges.

A window of width W holds the recorded events that come strictly earlier in
(time, id) order and are not older than t - W. Both edges fall out of one ordered
sweep: an event adds itself at (t, phase 0) and is taken away at (t + W, phase 1),
and a row looks at the running totals of the rows before it. Three sweeps are
needed (pair, sender, receiver); the last two share one shuffle.

The distinct counterparties of an account are counted without keeping sets: a pair
adds one when its own running count leaves zero and takes one away when that count
returns to zero.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsieve import vocab
from finsieve.functions import scalars as S
from finsieve.operators.canonical import row_features
from finsieve.operators.ordering import (
    HOT_ROWS,
    NOT_CHUNKED,
    has_hot_key,
    hot_keys,
    mark_first,
    running_before,
)

DAY = S.DAY_US
WEEK = 7 * DAY
_SENDER, _RECEIVER = 0, 1


def _amount(scale: int) -> Column:
    return F.col("amount").cast(f"decimal(38,{scale})")


def _flag_hot(rows: DataFrame, hot_rows: int) -> DataFrame:
    """Add ``_s_hot`` / ``_r_hot`` when a hot account exists, else leave the rows alone.

    The broadcast lists hold at most rows / hot_rows keys.
    """
    if not has_hot_key(rows, ("sender_account", "receiver_account"), hot_rows):
        return rows
    for side, name in (("sender_account", "_s_hot"), ("receiver_account", "_r_hot")):
        hot = hot_keys(rows.select(side), side, hot_rows).withColumn(name, F.lit(True))
        rows = rows.join(F.broadcast(hot), side, "left").withColumn(
            name, F.coalesce(F.col(name), F.lit(False))
        )
    return rows


def _hot_columns(rows: DataFrame) -> list[str]:
    return [c for c in ("_s_hot", "_r_hot") if c in rows.columns]


def _chunked(
    rows: DataFrame, hot: Sequence[str], position: Column, size: int
) -> tuple[DataFrame, str | None]:
    """Add the chunk column for keys whose ``hot`` flags are all set."""
    if not set(hot) <= set(rows.columns):
        return rows, None
    flag = reduce(lambda a, b: a & b, [F.col(c) for c in hot])
    chunk = F.when(flag, F.floor(position / size)).otherwise(F.lit(NOT_CHUNKED))
    return rows.withColumn("_chunk", chunk.cast("long")), "_chunk"


def _sweep_order(name: str = "_t") -> list[Column]:
    """Time, phase, id, and copies of an id ahead of the recorded one."""
    return [F.col(name), F.col("_phase"), F.col("transaction_id"), F.col("_record")]


def _with_seq(df: DataFrame) -> DataFrame:
    return df if "seq" in df.columns else df.withColumn("seq", F.monotonically_increasing_id())


def history_rows(
    canonical: DataFrame, prior: DataFrame | None = None, record: bool = True,
    unique_ids: bool = False,
) -> DataFrame:
    """Rows of the sweep: ``_probe`` rows get features, ``_record`` rows enter the history.

    ``prior`` rows are history only. Without ``record`` the new rows are scored
    against the prior ones and leave no trace. A repeated id is scored every time
    but recorded once. ``unique_ids`` skips the duplicate search.
    """
    new = _with_seq(canonical).withColumns({"_new": F.lit(1), "_probe": F.lit(True)})
    rows = new if record else None
    if prior is not None:
        old = _with_seq(prior).withColumns({"_new": F.lit(0), "_probe": F.lit(False)})
        rows = old if rows is None else old.unionByName(rows)
    if rows is None:
        return new.withColumn("_record", F.lit(False))
    if unique_ids:
        rows = rows.withColumn("_record", F.lit(True))
    else:
        rows = mark_first(rows, "transaction_id", ("_new", "timestamp", "seq"), "_record")
    if not record:
        rows = rows.unionByName(new.withColumn("_record", F.lit(False)))
    return rows


def _pair_sweep(rows: DataFrame, width: int, chunk_us: int, payload: list[str]) -> DataFrame:
    """Event rows with the pair's running count, and rows where a pair's count ends."""
    t = F.unix_micros("timestamp")
    event = F.struct(t.alias("_t"), F.lit(0).alias("_phase"), F.lit(1).alias("_delta"))
    expiry = F.struct(
        (t + width).alias("_t"), F.lit(1).alias("_phase"), F.lit(-1).alias("_delta")
    )
    steps = rows.select(
        *payload,
        F.inline(F.array_compact(F.array(event, F.when(F.col("_record"), expiry)))),
    )
    steps, chunk = _chunked(steps, ("_s_hot", "_r_hot"), F.col("_t"), chunk_us)
    counted = F.when(F.col("_record"), F.col("_delta"))
    # The flags follow from the accounts; as keys they let a filter pass the window.
    keys = ["sender_account", "receiver_account", *_hot_columns(rows)]
    seen = running_before(
        steps, keys, chunk, _sweep_order(), {"_pair": ("sum", counted.cast("long"))}
    )
    pair = F.coalesce("_pair", F.lit(0))
    change = (
        F.when(~F.col("_record"), 0)
        .when((F.col("_phase") == 0) & (pair == 0), 1)
        .when((F.col("_phase") == 1) & (pair == 1), -1)
        .otherwise(0)
    )
    return (
        seen.withColumn("_pair", pair)
        .withColumn("_distinct", change)
        .where((F.col("_phase") == 0) | (F.col("_distinct") != 0))
        .drop("_chunk", "_delta")
    )


def _side_sweep(
    pairs: DataFrame, day: int, chunk_us: int, scale: int, payload: list[Column]
) -> DataFrame:
    """Sender and receiver running totals in one shuffle; probe rows only."""
    amount = F.when(F.col("_record"), _amount(scale))
    one = F.when(F.col("_record"), F.lit(1))
    is_event = F.col("_phase") == 0
    zero_amount = F.lit(0).cast(f"decimal(38,{scale})")
    has_hot = bool(_hot_columns(pairs))

    def step(side: int, account: str, hot: str, gone: bool) -> Column:
        probe = F.lit(False) if gone else F.col("_probe") & is_event
        counted = F.lit(-1) if gone else F.when(is_event, one).otherwise(0)
        money = -amount if gone else F.when(is_event, amount).otherwise(zero_amount)
        return F.struct(
            F.lit(side).alias("_side"),
            F.col(account).alias("_account"),
            *([F.col(hot).alias("_hot")] if has_hot else []),
            (F.col("_t") + day if gone else F.col("_t")).alias("_at"),
            (F.lit(1) if gone else F.col("_phase")).alias("_phase"),
            counted.cast("long").alias("_d_count"),
            (money if side == _SENDER else zero_amount).alias("_d_amount"),
            (F.lit(0) if gone else F.col("_distinct")).cast("long").alias("_d_distinct"),
            F.when(is_event & F.col("_record") & F.lit(not gone), F.col("_t")).alias("_start"),
            probe.alias("_probe"),
            # Only the sender's own row carries the payload to the end.
            F.when(probe & F.lit(side == _SENDER), F.struct(*payload)).alias("_payload"),
        )

    leaves = is_event & F.col("_record")
    steps = pairs.select(
        "seq", "transaction_id", "_record", "_pair",
        F.inline(
            F.array_compact(
                F.array(
                    step(_SENDER, "sender_account", "_s_hot", False),
                    step(_RECEIVER, "receiver_account", "_r_hot", False),
                    F.when(leaves, step(_SENDER, "sender_account", "_s_hot", True)),
                    F.when(leaves, step(_RECEIVER, "receiver_account", "_r_hot", True)),
                )
            )
        ),
    )
    steps, chunk = _chunked(steps, ("_hot",), F.col("_at"), chunk_us)
    seen = running_before(
        steps, ["_side", "_account"], chunk, _sweep_order("_at"),
        {
            "_count": ("sum", F.col("_d_count")),
            "_sum": ("sum", F.col("_d_amount")),
            "_uniq": ("sum", F.col("_d_distinct")),
            "_last": ("max", F.col("_start")),
        },
    )
    return seen.where("_probe")


def build_features(
    canonical: DataFrame,
    prior: DataFrame | None = None,
    record: bool = True,
    unique_ids: bool = False,
    keep: tuple[str, ...] = (),
    amount_scale: int = 4,
    hot_rows: int = HOT_ROWS,
    chunk_us: int = DAY,
) -> DataFrame:
    """fs-1 feature matrix: ``seq``, ``transaction_id``, ``keep`` and 15 typed columns.

    One row per input row. ``seq`` is the caller's row number (made up when absent).
    See :func:`history_rows` for ``prior`` and ``record``.
    """
    rows = _flag_hot(
        history_rows(canonical, prior, record, unique_ids), hot_rows
    ).withColumns({f"_f{i}": c for i, c in enumerate(row_features(canonical))})
    row_cols = [f"_f{i}" for i in range(8)]
    carried = [
        "seq", "transaction_id", "sender_account", "receiver_account", "amount", "_probe",
        "_record", *_hot_columns(rows), *row_cols, *keep,
    ]
    pairs = _pair_sweep(rows, WEEK, chunk_us, carried)
    payload = [F.col("_pair").alias("pair"), F.col("_t").alias("t")]
    payload += [F.col(c) for c in (*row_cols, *keep)]
    probes = _side_sweep(pairs, DAY, chunk_us, amount_scale, payload)
    mine, theirs = F.col("_side") == _SENDER, F.col("_side") == _RECEIVER
    zero = F.lit(0)
    merged = (
        probes.repartition("seq")
        .groupBy("seq", "transaction_id")
        .agg(
            F.first("_payload", ignorenulls=True).alias("p"),
            F.max(F.when(mine, F.coalesce("_count", zero))).alias("s_count"),
            F.max(F.when(mine, F.col("_sum"))).alias("s_sum"),
            F.max(F.when(mine, F.coalesce("_uniq", zero))).alias("s_uniq"),
            F.max(F.when(mine, F.col("_last"))).alias("s_last"),
            F.max(F.when(theirs, F.coalesce("_count", zero))).alias("r_count"),
            F.max(F.when(theirs, F.coalesce("_uniq", zero))).alias("r_uniq"),
        )
    )
    values = [F.col(f"p.{c}") for c in row_cols] + [
        F.col("s_count"),
        F.coalesce(F.col("s_sum").cast("double"), F.lit(0.0)),
        F.col("s_uniq"),
        F.col("r_count"),
        F.col("r_uniq"),
        F.col("p.pair"),
        F.coalesce((F.col("p.t") - F.col("s_last")) / 1_000_000.0, F.lit(-1.0)),
    ]
    return merged.select(
        "seq",
        "transaction_id",
        *[F.col(f"p.{c}").alias(c) for c in keep],
        *[v.cast(kind).alias(name) for v, (name, kind) in zip(values, vocab.FEATURES)],
    )


def what_if_features(candidates: DataFrame, history: DataFrame, **options) -> DataFrame:
    """Features of candidate rows against a history that they do not join."""
    return build_features(candidates, prior=history, record=False, **options)


def cold_start(
    canonical: DataFrame, prior: DataFrame | None = None, record: bool = True
) -> DataFrame:
    """``seq``, ``transaction_id``, ``cold_start``: neither account was seen before."""
    rows = history_rows(canonical, prior, record)
    key = F.struct(F.unix_micros("timestamp").alias("t"), F.col("transaction_id").alias("id"))
    seen = rows.where("_record").select(
        key.alias("k"), F.explode(F.array("sender_account", "receiver_account")).alias("account")
    )
    first = seen.groupBy("account").agg(F.min("k").alias("first"))
    out = rows.where("_probe").select(
        "seq", "transaction_id", "sender_account", "receiver_account", key.alias("k")
    )
    for side in ("sender", "receiver"):
        names = first.select(
            F.col("account").alias(f"{side}_account"), F.col("first").alias(f"{side}_first")
        )
        out = out.join(names, f"{side}_account", "left")
    known = [
        F.coalesce(F.col(f"{side}_first") < F.col("k"), F.lit(False))
        for side in ("sender", "receiver")
    ]
    return out.select("seq", "transaction_id", (~(known[0] | known[1])).alias("cold_start"))


def arrival_counters(
    canonical: DataFrame, hot_rows: int = HOT_ROWS, chunk_rows: int = 1_000_000
) -> DataFrame:
    """One row: recorded, duplicates, out_of_order for rows arriving in ``seq`` order."""
    rows = mark_first(canonical, "transaction_id", ("seq",), "_record")
    counts = rows.agg(
        F.count_if("_record").alias("recorded"), F.count_if(~F.col("_record")).alias("duplicates")
    )
    key = F.struct(F.unix_micros("timestamp").alias("t"), F.col("transaction_id").alias("id"))
    flagged = _flag_hot(rows.where("_record"), hot_rows)

    def end(side: int, account: str, hot: str) -> Column:
        flag = [F.col(hot).alias("_hot")] if _hot_columns(flagged) else []
        return F.struct(F.lit(side).alias("_side"), F.col(account).alias("_account"), *flag)

    sides = flagged.select(
        "seq",
        key.alias("_key"),
        F.inline(
            F.array(
                end(_SENDER, "sender_account", "_s_hot"),
                end(_RECEIVER, "receiver_account", "_r_hot"),
            )
        ),
    )
    sides, chunk = _chunked(sides, ("_hot",), F.col("seq"), chunk_rows)
    seen = running_before(
        sides, ["_side", "_account"], chunk, [F.col("seq")],
        {"_latest": ("max", F.col("_key"))},
    )
    late = seen.where(F.col("_key") < F.col("_latest")).agg(
        F.count_distinct("seq").alias("out_of_order")
    )
    # Two one-row results side by side.
    return counts.crossJoin(late)


def transaction_features(
    canonical: DataFrame, hot_rows: int = HOT_ROWS, chunk_us: int = DAY
) -> DataFrame:
    """Per-transaction group: z-score, velocities, receivers of the day, gaps, ratio.

    Averages and deviations (population) are over all earlier events of the sender;
    null when there are none, and no z-score when the deviation is zero.
    """
    hour = S.HOUR_US
    rows = _flag_hot(history_rows(canonical), hot_rows)
    carried = [
        "seq", "transaction_id", "sender_account", "receiver_account", "amount", "_probe",
        "_record", *_hot_columns(rows),
    ]
    pairs = _pair_sweep(rows, DAY, chunk_us, carried)
    pairs, chunk = _chunked(pairs, ("_s_hot", "_r_hot"), F.col("_t"), chunk_us)
    ever = running_before(
        pairs, ["sender_account", "receiver_account", *_hot_columns(rows)], chunk, _sweep_order(),
        {"_ever": ("max", F.when((F.col("_phase") == 0) & F.col("_record"), 1))},
    ).drop("_chunk")
    is_event = F.col("_phase") == 0
    counted = is_event & F.col("_record")
    amount = _amount(4)

    def step(delay: int, d_hour: int, d_day: int, first: bool) -> Column:
        return F.struct(
            (F.col("_t") + delay).alias("_at"),
            (F.lit(1) if delay else F.col("_phase")).alias("_phase"),
            F.when(F.col("_record"), d_hour).cast("long").alias("_h"),
            F.when(F.col("_record"), d_day).cast("long").alias("_d"),
            (F.col("_distinct") if first else F.lit(0)).cast("long").alias("_u"),
            F.when(counted & F.lit(first), F.lit(1)).alias("_n"),
            F.when(counted & F.lit(first), amount).alias("_a"),
            F.when(counted & F.lit(first), F.col("amount") * F.col("amount")).alias("_q"),
            F.when(counted & F.lit(first), F.col("_t")).alias("_start"),
            (F.col("_probe") & is_event & F.lit(first)).alias("_probe"),
        )

    now = F.when(is_event, step(0, 1, 1, True)).otherwise(step(0, 0, 0, True))
    steps = ever.select(
        "seq", "transaction_id", "sender_account", "amount", "_record", "_ever",
        *_hot_columns(ever)[:1],
        F.inline(
            F.array_compact(
                F.array(
                    now,
                    F.when(counted, step(hour, -1, 0, False)),
                    F.when(counted, step(DAY, 0, -1, False)),
                )
            )
        ),
    )
    steps, chunk = _chunked(steps, ("_s_hot",), F.col("_at"), chunk_us)
    seen = running_before(
        steps, ["sender_account"], chunk, _sweep_order("_at"),
        {
            "h": ("sum", F.col("_h")), "d": ("sum", F.col("_d")), "u": ("sum", F.col("_u")),
            "n": ("sum", F.col("_n").cast("long")), "a": ("sum", F.col("_a")),
            "q": ("sum", F.col("_q")), "last": ("max", F.col("_start")),
        },
    ).where("_probe")
    mean = F.col("a").cast("double") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    zero = F.lit(0).cast("long")
    return seen.select(
        "seq",
        "transaction_id",
        F.when(spread > 1e-9, (F.col("amount") - mean) / spread).alias("amount_zscore"),
        F.coalesce("h", zero).alias("tx_velocity_1h"),
        F.coalesce("d", zero).alias("tx_velocity_24h"),
        F.coalesce("u", zero).alias("unique_receivers_1d"),
        F.col("_ever").isNull().alias("is_new_receiver"),
        F.coalesce((F.col("_at") - F.col("last")) / 1_000_000.0, F.lit(-1.0))
        .alias("time_since_last_tx"),
        F.when(F.col("n") > 0, F.col("amount") / mean).alias("amount_to_avg_ratio"),
    )
