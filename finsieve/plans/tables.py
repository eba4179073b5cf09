"""The driver's tables seen as the model's tables, in Spark and in SQL.

Each SQL text is one or more CTEs; queries prepend the ones they need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finsieve.functions import scalars as S

CITIES = ("Istanbul", "Ankara", "Izmir", "Berlin", "London", "Tokyo", "Atlantis")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cycle(values: tuple[str | None, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _sql_cycle(values: tuple[str | None, ...], index: str) -> str:
    items = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"([{items}])[CAST({index} AS INTEGER) + 1]"


_TYPES = ("Credit card", "Cross-border", "Debit card", "ACH", None)
_CURRENCIES = ("try", "EUR ", "USD", "xxx")
_COUNTRIES = ("TR", " de", None, "ZZ", "US")


def received(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``events`` as a received transaction.

    Sender is the user, receiver the number in ``props``; both live in one key
    space, so money can travel in circles. Times are cut to the hour to give ties
    and every 50th row repeats the id of the row before it.
    """
    return received_rows(table(spark, sf_dir, "events"))


def received_rows(events: DataFrame) -> DataFrame:
    """The mapping of :func:`received` for a batch or streaming events table."""
    k = F.get_json_object("props", "$.k").cast("long")
    copied = F.when(F.col("event_id") % 50 == 49, 1).otherwise(0)
    return events.select(
        F.concat(F.lit("E"), F.lpad((F.col("event_id") - copied).cast("string"), 12, "0"))
        .alias("transaction_id"),
        F.col("event_id").alias("seq"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("timestamp"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("sender_iban"),
        F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("sender_name"),
        _cycle(CITIES, k % len(CITIES)).alias("sender_city"),
        F.concat(F.lit("U"), k.cast("string")).alias("receiver_iban"),
        F.concat(F.lit("User "), k.cast("string")).alias("receiver_name"),
        _cycle(CITIES, F.col("user_id") % len(CITIES)).alias("receiver_city"),
        F.col("value").alias("amount"),
        _cycle(_CURRENCIES, F.col("event_id") % 4).alias("currency"),
        F.when(F.col("event_id") % 3 == 0, F.lit("TRY")).alias("received_currency"),
        _cycle(_COUNTRIES, F.col("user_id") % 5).alias("sender_country"),
        _cycle(_COUNTRIES, k % 5).alias("receiver_country"),
        _cycle(_TYPES, F.length("event_type") % 5).alias("payment_type"),
        F.col("event_type").alias("description"),
        F.when(F.col("event_type") == "error", F.lit("ml_model")).otherwise(F.lit("none"))
        .alias("fraud_type"),
    )


RECEIVED = f"""
received AS (
  SELECT 'E' || lpad(CAST(event_id - CASE WHEN event_id % 50 = 49 THEN 1 ELSE 0 END AS VARCHAR),
                     12, '0') AS transaction_id,
         event_id AS seq, date_trunc('hour', ts) AS "timestamp",
         'U' || CAST(user_id AS VARCHAR) AS sender_iban,
         'User ' || CAST(user_id AS VARCHAR) AS sender_name,
         {_sql_cycle(CITIES, f"k % {len(CITIES)}")} AS sender_city,
         'U' || CAST(k AS VARCHAR) AS receiver_iban,
         'User ' || CAST(k AS VARCHAR) AS receiver_name,
         {_sql_cycle(CITIES, f"user_id % {len(CITIES)}")} AS receiver_city,
         value AS amount,
         {_sql_cycle(_CURRENCIES, "event_id % 4")} AS currency,
         CASE WHEN event_id % 3 = 0 THEN 'TRY' END AS received_currency,
         {_sql_cycle(_COUNTRIES, "user_id % 5")} AS sender_country,
         {_sql_cycle(_COUNTRIES, "k % 5")} AS receiver_country,
         {_sql_cycle(_TYPES, "length(event_type) % 5")} AS payment_type,
         event_type AS description,
         CASE WHEN event_type = 'error' THEN 'ml_model' ELSE 'none' END AS fraud_type
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events)
)"""

CANONICAL = (
    RECEIVED
    + """,
tx AS (
  SELECT transaction_id, seq, "timestamp" AS ts, sender_iban AS sender, receiver_iban AS receiver,
         amount, upper(trim(currency)) AS pay,
         upper(trim(coalesce(received_currency, currency))) AS rec,
         upper(trim(coalesce(sender_country, 'TR'))) AS s_country,
         upper(trim(coalesce(receiver_country, 'TR'))) AS r_country,
         coalesce(translate(lower(trim(payment_type)), '- ', '__'), 'unknown') AS payment_type
  FROM received WHERE amount > 0
),
rec AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY ts, seq) AS rn
                 FROM tx) WHERE rn = 1
)"""
)


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as accepted canonical transactions (with ``seq``)."""
    from finsieve.operators.canonical import accepted, canonicalize, from_received

    return accepted(canonicalize(from_received(received(spark, sf_dir)), keep=("seq",)))


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers over ``orders`` and ``lineitem``: customer to supplier or part number.

    The receiver lies in the customer key space, so closed walks exist.
    """
    orders = table(spark, sf_dir, "orders")
    items = table(spark, sf_dir, "lineitem")
    return items.join(orders, items.l_orderkey == orders.o_orderkey).select(
        F.concat_ws("-", F.lit("T"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        .alias("transaction_id"),
        F.col("o_custkey").cast("string").alias("src"),
        (F.col("l_partkey") % 1500).cast("string").alias("dst"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
    )


def money_edges(spark: SparkSession, sf_dir: str, at_least: float) -> DataFrame:
    """Large transfers of ``events`` as graph edges, one per transaction id."""
    from finsieve.operators.ordering import mark_first

    valid = received(spark, sf_dir).where("amount > 0")
    rows = mark_first(valid, "transaction_id", ("timestamp", "seq"))
    return rows.where(F.col("is_first") & (F.col("amount") > at_least)).select(
        F.col("sender_iban").alias("src"), F.col("receiver_iban").alias("dst"),
        "transaction_id", "timestamp", "amount", "fraud_type",
    )


MONEY_EDGES = (
    CANONICAL
    + """,
edges AS (
  SELECT r.sender AS src, r.receiver AS dst, r.transaction_id AS id, r.ts, r.amount
  FROM rec r WHERE r.amount > {at_least}
)"""
)


def with_ctes(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body.strip()}"


def short_time(col: Column) -> Column:
    """Seconds since the epoch, to compare times without time zones."""
    return (S.micros(col) / 1_000_000).cast("long")
