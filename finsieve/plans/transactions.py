"""Queries over transactions: cleaning, identity, duplicates, history features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsieve import vocab
from finsieve.functions import scalars as S
from finsieve.operators import canonical as C
from finsieve.operators import history as H
from finsieve.plans import tables as T
from finsieve.plans.registry import query
from finsieve.session import work_folder
from finsieve.sources.files import read_labelled_csv


def _sql_codes(column: str, values: tuple[str, ...]) -> str:
    items = ", ".join(f"'{v}'" for v in values[1:])
    return f"coalesce(list_position([{items}], {column}), 0)"


@query(
    "B1 B2 B3 B4 B5 B7 B8",
    T.with_ctes(
        T.CANONICAL,
        """
        SELECT seq, transaction_id, CAST(epoch(ts) AS BIGINT) AS unix_time, sender AS sender_account,
               receiver AS receiver_account, amount, pay AS payment_currency,
               rec AS received_currency, s_country AS sender_country,
               r_country AS receiver_country, payment_type
        FROM tx
        """,
    ),
)
def canonical_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Received rows to validated, defaulted, normalised canonical rows."""
    rows = T.canonical(spark, sf_dir)
    return rows.select(
        "seq", "transaction_id", T.short_time(F.col("timestamp")).alias("unix_time"),
        *[c for c in rows.columns if c not in ("seq", "transaction_id", "timestamp")],
    )


@query(
    "B3 B7 B8",
    """
    WITH raw AS (
      SELECT c_custkey AS seq, CASE WHEN c_custkey % 7 = 0 THEN '  ' ELSE c_name END AS tid,
             CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS sender,
             c_acctbal - 200 AS amount, c_custkey % 11 = 0 AS naive
      FROM customer
    )
    SELECT seq,
           (CASE WHEN trim(tid) = '' THEN 1 ELSE 0 END + CASE WHEN sender IS NULL THEN 1 ELSE 0 END
            + CASE WHEN amount <= 0 THEN 1 ELSE 0 END + CASE WHEN naive THEN 1 ELSE 0 END)
             AS error_count,
           CASE WHEN trim(tid) = '' THEN 'missing transaction_id'
                WHEN sender IS NULL THEN 'missing sender_account'
                WHEN amount <= 0 THEN 'amount must be finite and > 0'
                ELSE 'timestamp must carry an offset' END AS first_error
    FROM raw WHERE trim(tid) = '' OR sender IS NULL OR amount <= 0 OR naive
    """,
)
def rejected_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break the contract, with the reasons."""
    key = F.col("c_custkey")
    raw = T.table(spark, sf_dir, "customer").select(
        key.alias("seq"),
        F.when(key % 7 == 0, F.lit("  ")).otherwise(F.col("c_name")).alias("transaction_id"),
        F.when(key % 11 == 0, F.lit("2024-01-01T00:00:00"))
        .otherwise(F.lit("2024-01-01T00:00:00+03:00")).alias("timestamp"),
        F.when(key % 5 != 0, F.col("c_mktsegment")).alias("sender_account"),
        F.col("c_name").alias("receiver_account"),
        (F.col("c_acctbal") - 200).alias("amount"),
        F.lit("TRY").alias("payment_currency"),
    )
    bad = C.rejected(C.canonicalize(raw, keep=("seq",)))
    reasons = F.split("errors", "; ")
    return bad.select(
        "seq", F.size(reasons).cast("long").alias("error_count"),
        reasons[0].alias("first_error"),
    )


@query(
    "B6 B9",
    T.with_ctes(
        T.CANONICAL,
        f"""
        SELECT seq, round(CAST(CAST(ln(1 + amount) AS FLOAT) AS DOUBLE), 4)
                 AS log_amount,
               CAST(hour(ts) AS BIGINT) AS hour, CAST(isodow(ts) - 1 AS BIGINT) AS day_of_week,
               CAST({_sql_codes("payment_type", vocab.PAYMENT_TYPES)} AS BIGINT) AS payment_type_code,
               CAST(pay <> rec AS BIGINT) AS currency_mismatch,
               CAST(s_country <> r_country AS BIGINT) AS cross_border,
               CAST({_sql_codes("s_country", vocab.COUNTRIES)} AS BIGINT) AS sender_country_code,
               CAST({_sql_codes("r_country", vocab.COUNTRIES)} AS BIGINT) AS receiver_country_code
        FROM tx
        """,
    ),
)
def row_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of a transaction that need no history."""
    rows = T.canonical(spark, sf_dir)
    named = rows.select("seq", *C.row_features(rows))
    return named.select(
        "seq",
        F.round(F.col("log_amount").cast("double"), 4).alias("log_amount"),
        *[F.col(c).cast("long").alias(c) for c in named.columns[2:]],
    )


_HISTORY_SQL = """
        SELECT t.seq, t.transaction_id,
               count(h.seq) FILTER (h.sender = t.sender AND h.ts >= t.ts - INTERVAL 24 HOUR)
                 AS sender_tx_count_24h,
               round(CAST(coalesce(sum(CAST(h.amount AS DECIMAL(38,4)))
                 FILTER (h.sender = t.sender AND h.ts >= t.ts - INTERVAL 24 HOUR), 0) AS DOUBLE), 2)
                 AS sender_amount_sum_24h,
               count(DISTINCT h.receiver)
                 FILTER (h.sender = t.sender AND h.ts >= t.ts - INTERVAL 7 DAY)
                 AS sender_unique_receivers_7d,
               count(h.seq) FILTER (h.receiver = t.receiver AND h.ts >= t.ts - INTERVAL 24 HOUR)
                 AS receiver_tx_count_24h,
               count(DISTINCT h.sender)
                 FILTER (h.receiver = t.receiver AND h.ts >= t.ts - INTERVAL 7 DAY)
                 AS receiver_unique_senders_7d,
               count(h.seq) FILTER (h.sender = t.sender AND h.receiver = t.receiver
                                    AND h.ts >= t.ts - INTERVAL 7 DAY) AS pair_tx_count_7d,
               CAST(coalesce(epoch(t.ts) - epoch(max(h.ts) FILTER (h.sender = t.sender)), -1)
                 AS DOUBLE) AS sender_seconds_since_prev
        FROM {probes} t LEFT JOIN {history} h
          ON (h.sender = t.sender OR h.receiver = t.receiver)
         AND (h.ts < t.ts OR (h.ts = t.ts AND h.transaction_id < t.transaction_id))
        GROUP BY t.seq, t.transaction_id, t.ts
"""


def _history_columns(features: DataFrame) -> DataFrame:
    return features.select(
        "seq",
        "transaction_id",
        *[
            F.round(F.col(c).cast("double"), 2).alias(c)
            if kind == "float" else F.col(c).cast("long").alias(c)
            for c, kind in vocab.FEATURES[8:]
        ],
    )


@query(
    "C1 C2 D1 D2 D3 D4 D5 D6 D7 D9",
    T.with_ctes(T.CANONICAL, _HISTORY_SQL.format(probes="tx", history="rec")),
)
def history_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven account-history features of every transaction."""
    return _history_columns(H.build_features(T.canonical(spark, sf_dir)))


@query(
    "D10",
    T.with_ctes(
        T.CANONICAL
        + """,
        late AS (SELECT * FROM tx WHERE ts >= TIMESTAMP '2024-01-16'),
        known AS (SELECT * FROM tx WHERE ts < TIMESTAMP '2024-01-16'),
        every AS (
          SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id
                                                      ORDER BY fresh, ts, seq) AS rn
                         FROM (SELECT *, 0 AS fresh FROM known
                               UNION ALL SELECT *, 1 FROM late)) WHERE rn = 1)""",
        _HISTORY_SQL.format(probes="late", history="every"),
    ),
)
def features_continued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second half of the month scored with the first half as prior history."""
    rows = T.canonical(spark, sf_dir)
    cut = F.col("timestamp") >= F.lit("2024-01-16").cast("timestamp")
    return _history_columns(H.build_features(rows.where(cut), prior=rows.where(~cut)))


@query(
    "D11 I6",
    T.with_ctes(
        T.CANONICAL
        + """,
        asked AS (SELECT * FROM tx WHERE ts >= TIMESTAMP '2024-01-16'),
        known AS (SELECT * FROM rec WHERE ts < TIMESTAMP '2024-01-16')""",
        _HISTORY_SQL.format(probes="asked", history="known"),
    ),
)
def what_if_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates scored against a history they do not join."""
    rows = T.canonical(spark, sf_dir)
    cut = F.col("timestamp") >= F.lit("2024-01-16").cast("timestamp")
    return _history_columns(H.what_if_features(rows.where(cut), rows.where(~cut)))


@query(
    "D8",
    T.with_ctes(
        T.CANONICAL
        + """,
        ends AS (SELECT sender AS account, ts, transaction_id FROM rec
                 UNION ALL SELECT receiver, ts, transaction_id FROM rec)""",
        """
        SELECT t.seq, t.transaction_id, NOT EXISTS (
                 SELECT 1 FROM ends e WHERE e.account IN (t.sender, t.receiver)
                 AND (e.ts < t.ts OR (e.ts = t.ts AND e.transaction_id < t.transaction_id))
               ) AS cold_start
        FROM tx t
        """,
    ),
)
def cold_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether neither account of a transaction was seen before it."""
    return H.cold_start(T.canonical(spark, sf_dir))


@query(
    "C4 D13",
    T.with_ctes(
        T.CANONICAL
        + """,
        arrived AS (SELECT *, ts - INTERVAL 1 HOUR * (seq * 7 % 50) AS at_time FROM tx),
        first_in AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id
                                                                 ORDER BY seq) AS rn FROM arrived)
                     WHERE rn = 1),
        marked AS (
          SELECT seq, (at_time, transaction_id)
                   < max((at_time, transaction_id)) OVER (PARTITION BY sender ORDER BY seq
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late_out,
                 (at_time, transaction_id)
                   < max((at_time, transaction_id)) OVER (PARTITION BY receiver ORDER BY seq
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late_in
          FROM first_in)""",
        """
        SELECT (SELECT count(*) FROM first_in) AS recorded,
               (SELECT count(*) FROM tx) - (SELECT count(*) FROM first_in) AS duplicates,
               count(*) FILTER (coalesce(late_out, false) OR coalesce(late_in, false))
                 AS out_of_order
        FROM marked
        """,
    ),
)
def arrival_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded, repeated and late transactions in arrival order."""
    late = F.timestamp_micros(
        F.unix_micros("timestamp") - F.col("seq") * 7 % 50 * F.lit(S.HOUR_US)
    )
    return H.arrival_counters(T.canonical(spark, sf_dir).withColumn("timestamp", late))


@query(
    "D14",
    T.with_ctes(
        T.CANONICAL,
        """
        SELECT t.seq, t.transaction_id,
               CASE WHEN stddev_pop(h.amount) > 1e-9 THEN
                 round((t.amount - avg(h.amount)) / stddev_pop(h.amount), 3) + 0.0e0 END AS amount_zscore,
               count(h.seq) FILTER (h.ts >= t.ts - INTERVAL 1 HOUR) AS tx_velocity_1h,
               count(h.seq) FILTER (h.ts >= t.ts - INTERVAL 24 HOUR) AS tx_velocity_24h,
               count(DISTINCT h.receiver) FILTER (h.ts >= t.ts - INTERVAL 24 HOUR)
                 AS unique_receivers_1d,
               count(h.seq) FILTER (h.receiver = t.receiver) = 0 AS is_new_receiver,
               CAST(coalesce(epoch(t.ts) - epoch(max(h.ts)), -1) AS DOUBLE) AS time_since_last_tx,
               round(t.amount / (CAST(sum(CAST(h.amount AS DECIMAL(38,4))) AS DOUBLE) / count(h.seq)), 9)
                 AS amount_to_avg_ratio
        FROM tx t LEFT JOIN rec h ON h.sender = t.sender
         AND (h.ts < t.ts OR (h.ts = t.ts AND h.transaction_id < t.transaction_id))
        GROUP BY t.seq, t.transaction_id, t.ts, t.amount
        """,
    ),
)
def transaction_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Velocity, novelty and amount features against the sender's own past."""
    rows = H.transaction_features(T.canonical(spark, sf_dir))
    return rows.withColumns({
        "amount_zscore": F.round("amount_zscore", 3) + 0.0,
        "amount_to_avg_ratio": F.round("amount_to_avg_ratio", 9),
    })


@query(
    "D15",
    """
    WITH e AS (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k
               FROM events),
    hours AS (SELECT user_id, hour(ts) AS h, count(*) AS n FROM e GROUP BY 1, 2),
    best AS (SELECT user_id, arg_max(h, (n, -h)) AS h, max(n) / sum(n) AS share
             FROM hours GROUP BY 1),
    ips AS (SELECT user_id, k, count(*) AS n FROM e GROUP BY 1, 2),
    ent AS (SELECT user_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS bits
            FROM ips GROUP BY 1),
    dev AS (SELECT user_id, ts, event_type,
                   lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last
            FROM e),
    chg AS (SELECT user_id, count(*) FILTER (last <> event_type)
              / greatest(ceil((epoch_us(max(ts)) - epoch_us(min(ts))) / 604800000000.0), 1)
              AS per_week FROM dev GROUP BY 1),
    wk AS (SELECT user_id, avg((isodow(ts) >= 6)::INT) AS weekend,
                  avg((event_type = 'click')::INT) AS clicks FROM e GROUP BY 1)
    SELECT b.user_id, CAST(b.h AS BIGINT) AS typical_tx_hour,
           round(b.share, 6) AS login_hour_consistency, round(w.weekend, 6) AS weekend_tx_ratio,
           round(w.clicks, 6) AS click_share, round(c.per_week, 6) AS device_change_frequency,
           round(x.bits, 4) AS ip_entropy
    FROM best b JOIN ent x USING (user_id) JOIN chg c USING (user_id) JOIN wk w USING (user_id)
    """,
)
def behaviour_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Behaviour of every user; kind of event stands for channel and device."""
    from finsieve.operators.behaviour import behaviour_features as features

    rows = T.table(spark, sf_dir, "events").select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        F.col("event_type").alias("channel"), F.col("event_type").alias("device"),
        F.get_json_object("props", "$.k").alias("ip"),
    )
    found = features(rows, "user_id", "ts", "channel", "device", "ip")
    clicks = F.coalesce(F.try_element_at("channel_distribution", F.lit("click")), F.lit(0.0))
    return found.select(
        "user_id", F.col("typical_tx_hour").cast("long").alias("typical_tx_hour"),
        F.round("login_hour_consistency", 6).alias("login_hour_consistency"),
        F.round("weekend_tx_ratio", 6).alias("weekend_tx_ratio"),
        F.round(clicks, 6).alias("click_share"),
        F.round("device_change_frequency", 6).alias("device_change_frequency"),
        F.round("ip_entropy", 4).alias("ip_entropy"),
    )


_RAW = """
raw AS (
  SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS source_row, o_orderdate AS ts, o_custkey AS sender,
         o_orderkey % 97 AS receiver, o_totalprice AS amount,
         (['UK pounds', 'Euro', 'Yen', 'Peso'])[CAST(o_orderkey % 4 AS INTEGER) + 1] AS cur,
         (['UK', 'Turkey', 'Spain', 'Mars'])[CAST(o_custkey % 4 AS INTEGER) + 1] AS land,
         (['ACH', 'Cash Deposit', 'Wire'])[CAST(o_orderkey % 3 AS INTEGER) + 1] AS kind
  FROM orders)"""


@query(
    "A1 B10 B11 B12 B13 B14 B15 J4",
    T.with_ctes(
        _RAW,
        """
        SELECT 'SAMLD-' || lpad(CAST(source_row AS VARCHAR), 9, '0') AS transaction_id,
               CAST(epoch(ts) AS BIGINT) AS unix_time, CAST(sender AS VARCHAR) AS sender_account,
               round(amount * 50, 2) AS amount,
               CASE cur WHEN 'UK pounds' THEN 'TRY' WHEN 'Euro' THEN 'EUR' WHEN 'Yen' THEN 'JPY'
                        ELSE 'unknown' END AS payment_currency,
               CASE land WHEN 'UK' THEN 'TR' WHEN 'Turkey' THEN 'GB' WHEN 'Spain' THEN 'ES'
                         ELSE 'unknown' END AS sender_country,
               CASE kind WHEN 'ACH' THEN 'ach' WHEN 'Cash Deposit' THEN 'cash_deposit'
                         ELSE 'unknown' END AS payment_type,
               26 AS iban_length
        FROM raw
        """,
    ),
)
def labelled_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as a raw labelled CSV, read, numbered and turned into the canonical record."""
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    day = F.col("o_orderdate").cast("timestamp")
    raw = T.table(spark, sf_dir, "orders").select(
        n.alias("source_row"),
        F.date_format(day, "HH:mm:ss").alias("Time"),
        F.date_format(day, "yyyy-MM-dd").alias("Date"),
        c.cast("string").alias("Sender_account"), (n % 97).cast("string").alias("Receiver_account"),
        F.col("o_totalprice").alias("Amount"),
        T._cycle(("UK pounds", "Euro", "Yen", "Peso"), n % 4).alias("Payment_currency"),
        F.lit("Euro").alias("Received_currency"),
        T._cycle(("UK", "Turkey", "Spain", "Mars"), c % 4).alias("Sender_bank_location"),
        F.lit("UK").alias("Receiver_bank_location"),
        T._cycle(("ACH", "Cash Deposit", "Wire"), n % 3).alias("Payment_type"),
        F.lit(0).cast("tinyint").alias("Is_laundering"), F.lit("Normal").alias("Laundering_type"),
    )
    path = work_folder(spark, "raw-csv")
    raw.orderBy("source_row").drop("source_row").write.csv(path, header=True)
    rows = C.from_raw(C.with_source_row(read_labelled_csv(spark, path)))
    return rows.select(
        "transaction_id", T.short_time(F.col("timestamp")).alias("unix_time"), "sender_account",
        "amount", "payment_currency", "sender_country", "payment_type",
        F.length("sender_iban").alias("iban_length"),
    )


@query(
    "B14",
    """
    SELECT count(*) AS rows, 0 AS bad_accounts, count(*) FILTER (c_acctbal <= 0) AS bad_amounts,
           count(*) FILTER (c_nationkey > 1) AS bad_labels, 0 AS bad_times
    FROM customer
    """,
)
def dataset_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows break each rule of the labelled source."""
    key = F.col("c_custkey").cast("string")
    raw = T.table(spark, sf_dir, "customer").select(
        F.lit("00:00:00").alias("Time"), F.lit("2024-01-01").alias("Date"),
        key.alias("Sender_account"), key.alias("Receiver_account"),
        F.col("c_acctbal").alias("Amount"), F.col("c_nationkey").alias("Is_laundering"),
    )
    return C.raw_problems(raw)


@query(
    "B16 B17",
    """
    WITH r AS (
      SELECT c_custkey, upper(replace(trim(' tr' || substr(c_name, 1, CAST(c_custkey % 20 AS INT))
               || lpad(CAST(c_custkey AS VARCHAR), 9, '0')), ' ', '')) AS iban,
             c_acctbal AS amount, c_nationkey * 5 - 10 AS lat, substr(c_name, 1, 5) AS cur
      FROM customer)
    SELECT c_custkey, (length(iban) < 15 OR length(iban) > 34) AS bad_iban, amount <= 0 AS bad_amount,
           lat NOT BETWEEN -90 AND 90 AS bad_latitude, true AS bad_currency
    FROM r
    """,
)
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract rules that customer rows break when read as transactions."""
    n = F.col("c_custkey")
    iban = F.concat(
        F.lit(" tr"), F.substring("c_name", F.lit(1), (n % 20).cast("int")),
        F.lpad(n.cast("string"), 9, "0"),
    )
    rows = T.table(spark, sf_dir, "customer").select(
        "c_custkey", iban.alias("sender_iban"), F.col("c_name").alias("sender_name"),
        F.lit("").alias("sender_city"), F.lit("TR330006100519786457841326").alias("receiver_iban"),
        F.lit("R").alias("receiver_name"), F.lit("").alias("receiver_city"),
        F.col("c_acctbal").alias("amount"), F.substring("c_name", 1, 5).alias("currency"),
        (F.col("c_nationkey") * 5.0 - 10).alias("sender_latitude"),
        F.lit(0.0).alias("sender_longitude"),
    )
    found = rows.withColumn("v", C.received_violations(rows))

    def broken(rule: str, name: str) -> F.Column:
        return F.array_contains("v", rule).alias(name)

    return found.select(
        "c_custkey", broken("sender_iban length", "bad_iban"), broken("amount range", "bad_amount"),
        broken("sender_latitude range", "bad_latitude"),
        broken("currency length", "bad_currency"),
    )


@query(
    "A3 B8",
    T.with_ctes(
        T.CANONICAL,
        """
        SELECT transaction_id, CAST(epoch(ts) AS BIGINT) AS unix_time, sender AS sender_account,
               amount, rec AS received_currency FROM tx
        """,
    ),
)
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All transactions written as JSON lines, read back and validated."""
    from finsieve import schemas
    from finsieve.session import work_folder
    from finsieve.sources.files import read_jsonl

    path = work_folder(spark, "jsonl")
    rows = C.from_received(T.received(spark, sf_dir))
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    rows.withColumn("timestamp", stamp).select(*schemas.CANONICAL_COLUMNS).write.json(path)
    back = C.accepted(C.canonicalize(read_jsonl(spark, path)))
    return back.select(
        "transaction_id", T.short_time(F.col("timestamp")).alias("unix_time"),
        "sender_account", "amount", "received_currency",
    )


@query(
    "B27",
    """
    SELECT c_custkey, round(1 / (1 + exp(-c_acctbal / 1000)), 9) AS probability FROM customer
    """,
)
def sigmoid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances squeezed into probabilities."""
    rows = T.table(spark, sf_dir, "customer")
    p = S.sigmoid(F.col("c_acctbal") / 1000)
    return rows.select("c_custkey", F.round(p, 9).alias("probability"))
