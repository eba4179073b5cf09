"""Queries over detectors, alerts and cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finsieve import vocab
from finsieve.functions import scalars as S
from finsieve.operators import alerts as A
from finsieve.operators import cases as K
from finsieve.operators import detectors as D
from finsieve.operators.ordering import mark_first
from finsieve.options import DetectionOptions
from finsieve.plans import tables as T
from finsieve.plans.registry import query
from finsieve.plans.transactions import _HISTORY_SQL

_KINDS = {
    "click": "circular_ring", "view": "impossible_travel", "purchase": "blacklist_keyword",
    "signup": "structuring", "error": "ml_model",
}
_WORDS = ("heron", "ement", "lytion", "eaux", "casino")
_CRITICAL = ("heron", "casino")
_STATUSES = K.STATUSES
_AS_OF = "2024-01-16 00:00:00"


def _sql_map(column: str, table: dict[str, object]) -> str:
    whens = " ".join(
        f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else str(v))
        for k, v in table.items()
    )
    return f"CASE {column} {whens} END"


# --- alerts and cases made of the events table ----------------------------------------------------------
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an alert of a type given by its kind."""
    rows = T.received(spark, sf_dir)
    severity = (
        F.when(F.col("amount") > 150, "critical").when(F.col("amount") > 100, "high")
        .when(F.col("amount") > 60, "medium").otherwise("low")
    )
    found = rows.withColumns(
        {
            "fraud_type": F.element_at(S.lookup(_KINDS), F.col("description")),
            "severity": severity,
            "confidence": (F.col("seq") % 100) / 100,
            "details": F.lit("{}"),
            "detector_type": F.lit("rule_engine"),
            "detector_version": F.lit("1.0.0"),
            "contribution": F.lit(0.0),
            "related_accounts": F.lit(None).cast("array<string>"),
            "related_transactions": F.array("transaction_id"),
        }
    )
    return D.to_alerts(found).withColumn(
        "case_id",
        F.when(
            F.col("severity") != "low",
            F.concat(F.lit("CASE-"), F.substring("sender_iban", 2, 10)),
        ),
    )


_ALERTS = (
    T.RECEIVED
    + f""",
alerts AS (
  SELECT 'ALERT-' || upper(substr(sha256(transaction_id || chr(31) || kind), 1, 12)) AS alert_id,
         kind AS fraud_type, severity, CAST((seq % 100) / 100.0 AS DOUBLE) AS confidence,
         transaction_id, sender_iban, sender_name, sender_city, receiver_iban, receiver_name,
         receiver_city, amount, currency, "timestamp" AS detected_at, description,
         CASE WHEN severity <> 'low' THEN 'CASE-' || substr(sender_iban, 2) END AS case_id
  FROM (SELECT *, {_sql_map("description", _KINDS)} AS kind,
               CASE WHEN amount > 150 THEN 'critical' WHEN amount > 100 THEN 'high'
                    WHEN amount > 60 THEN 'medium' ELSE 'low' END AS severity
        FROM received)
)"""
)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case per user with a state and priority that follow from the number."""
    rows = T.table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.min(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("created_at")
    )
    n = F.col("user_id")
    return rows.select(
        F.concat(F.lit("CASE-"), n.cast("string")).alias("case_id"),
        T._cycle(_STATUSES, n % len(_STATUSES)).alias("status"),
        F.concat(F.lit("P"), (n % 4 + 1).cast("string")).alias("priority"),
        F.when(n % 3 == 0, F.concat(F.lit("analyst"), (n % 5).cast("string")))
        .alias("assigned_to"),
        F.lit(None).cast("string").alias("assigned_team"),
        F.when(n % 8 == 5, F.lit("confirmed")).alias("resolution"),
        "created_at",
        (n % 2 == 0).alias("str_required"),
        (n % 4 == 0).alias("str_filed"),
    )


_CASES = f"""
cases AS (
  SELECT 'CASE-' || CAST(user_id AS VARCHAR) AS case_id,
         {T._sql_cycle(_STATUSES, f"user_id % {len(_STATUSES)}")} AS status,
         'P' || CAST(user_id % 4 + 1 AS VARCHAR) AS priority,
         CASE WHEN user_id % 3 = 0 THEN 'analyst' || CAST(user_id % 5 AS VARCHAR) END
           AS assigned_to,
         min(date_trunc('hour', ts)) AS created_at, user_id % 2 = 0 AS str_required,
         user_id % 4 = 0 AS str_filed
  FROM events GROUP BY user_id
)"""
_OPEN = "status IN ('" + "', '".join(vocab.OPEN_STATUSES) + "')"


def _at(text: str = _AS_OF) -> Column:
    return F.lit(text).cast("timestamp")


# --- detectors --------------------------------------------------------------------------------
_POINTS = "(VALUES " + ", ".join(
    f"('{name}', {lat}, {lon})" for name, (lat, lon) in vocab.CITY_COORDINATES.items()
) + ") AS p(city, lat, lon)"

_TRAVEL = (
    T.RECEIVED
    + f""",
points AS (SELECT city, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM {_POINTS}),
placed AS (
  SELECT r.*, p.lat, p.lon,
         lag(struct_pack(ts := "timestamp", id := transaction_id, city := sender_city, lat := lat,
                         lon := lon))
           OVER (PARTITION BY sender_iban
                 ORDER BY "timestamp", transaction_id, sender_city) AS last
  FROM received r JOIN points p ON p.city = r.sender_city
),
moves AS (
  SELECT *, 2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a)) AS km,
         CASE WHEN gap <= 0 THEN 0.001 ELSE gap END AS hours
  FROM (SELECT *, pow(sin(radians(lat - last.lat) / 2), 2)
                  + cos(radians(last.lat)) * cos(radians(lat))
                  * pow(sin(radians(lon - last.lon) / 2), 2) AS a,
               (epoch("timestamp") - epoch(last.ts)) / 3600.0 AS gap
        FROM placed WHERE last IS NOT NULL)
  WHERE gap <= 24
)"""
)


@query(
    "B18 B19 F2 F7 F10",
    T.with_ctes(
        _TRAVEL,
        """
        SELECT 'ALERT-' || upper(substr(sha256(transaction_id || chr(31) || 'impossible_travel'),
                                        1, 12)) AS alert_id,
               transaction_id, sender_iban, 'high' AS severity, CAST(0.9 AS DOUBLE) AS confidence,
               'Impossible Travel Detected' AS title, last.city AS from_city,
               sender_city AS to_city, round(km, 2) AS distance_km,
               round(km / hours, 2) AS required_speed_kmh, last.id AS last_transaction_id
        FROM moves WHERE km / hours > 900
        """,
    ),
)
def travel_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Senders that would have had to travel faster than a jet."""
    found = D.to_alerts(D.impossible_travel(T.received(spark, sf_dir)))
    details = F.from_json(
        F.col("evidence")[0]["details"],
        "from_city string, to_city string, distance_km double, required_speed_kmh double, "
        "last_transaction_id string",
    )
    return found.withColumn("d", details).select(
        "alert_id", "transaction_id", "sender_iban", "severity", "confidence", "title",
        "d.*",
    )


def _sql_words(text: str, words: tuple[str, ...]) -> str:
    items = ", ".join(f"'{w}'" for w in words)
    return f"list_filter([{items}], lambda w: contains(lower({text}), w))"


@query(
    "B22 F4 F10",
    f"""
    WITH texts AS (
      SELECT 'D' || CAST(doc_id AS VARCHAR) AS transaction_id, text FROM documents
      UNION ALL
      SELECT 'C' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), text
      FROM conversations
    ), hits AS (SELECT *, {_sql_words("text", _WORDS)} AS words FROM texts)
    SELECT transaction_id, array_to_string(words, ',') AS keywords,
           CASE WHEN list_contains(words, 'heron') OR list_contains(words, 'casino')
                THEN 'critical' ELSE 'medium' END AS severity
    FROM hits WHERE len(words) > 0
    """,
)
def keyword_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed words in whole document and conversation texts."""
    docs = T.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("transaction_id"),
        F.col("text").alias("description"),
    )
    talks = T.table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.concat(F.lit("C"), F.col("conv_id").cast("string")), "turn")
        .alias("transaction_id"),
        F.col("text").alias("description"),
    )
    options = DetectionOptions(blacklist=_WORDS, critical_words=_CRITICAL)
    found = D.blacklisted(docs.unionByName(talks), options)
    words = F.from_json(F.get_json_object("details", "$.keywords_found"), "array<string>")
    return found.select(
        "transaction_id", F.concat_ws(",", words).alias("keywords"), "severity"
    )


_HALF_WALKS = """
e AS (SELECT id, src, dst, CAST(amount AS DECIMAL(38,4)) AS total, ts FROM edges
      WHERE src IN (SELECT dst FROM edges) AND dst IN (SELECT src FROM edges)),
w2 AS (
  SELECT a.src AS root, b.dst AS last, a.id AS i1, b.id AS i2, a.total + b.total AS total,
         least(a.ts, b.ts) AS t_min, greatest(a.ts, b.ts) AS t_max,
         greatest((a.ts, a.id), (b.ts, b.id)) AS k_max
  FROM e a JOIN e b ON b.src = a.dst AND b.id <> a.id
   AND greatest(a.ts, b.ts) - least(a.ts, b.ts) < INTERVAL 168 HOUR),
w3 AS (
  SELECT a.root, b.dst AS last, a.i1, a.i2, b.id AS i3, a.total + b.total AS total,
         least(a.t_min, b.ts) AS t_min, greatest(a.t_max, b.ts) AS t_max,
         greatest(a.k_max, (b.ts, b.id)) AS k_max
  FROM w2 a JOIN e b ON b.src = a.last AND b.id <> a.i1 AND b.id <> a.i2
   AND greatest(a.t_max, b.ts) - least(a.t_min, b.ts) < INTERVAL 168 HOUR),
rings AS (
  SELECT root, total, t_min, k_max FROM w3 WHERE last = root
  UNION ALL
  SELECT a.root, a.total + b.total, least(a.t_min, b.t_min), greatest(a.k_max, b.k_max)
  FROM w2 a JOIN w2 b ON b.root = a.last AND b.last = a.root
   AND a.i1 <> b.i1 AND a.i1 <> b.i2 AND a.i2 <> b.i1 AND a.i2 <> b.i2
   AND greatest(a.t_max, b.t_max) - least(a.t_min, b.t_min) < INTERVAL 168 HOUR
  UNION ALL
  SELECT a.root, a.total + b.total, least(a.t_min, b.t_min), greatest(a.k_max, b.k_max)
  FROM w3 a JOIN w2 b ON b.root = a.last AND b.last = a.root
   AND a.i1 <> b.i1 AND a.i1 <> b.i2 AND a.i2 <> b.i1 AND a.i2 <> b.i2 AND a.i3 <> b.i1 AND a.i3 <> b.i2
   AND greatest(a.t_max, b.t_max) - least(a.t_min, b.t_min) < INTERVAL 168 HOUR),
spans AS (SELECT root, t_min, k_max, max(total) AS total FROM rings GROUP BY ALL)"""


@query(
    "F1",
    T.with_ctes(
        T.MONEY_EDGES.format(at_least=0) + "," + _HALF_WALKS,
        """
        SELECT t.id AS transaction_id, t.src AS sender_iban,
               round(CAST(max(r.total) AS DOUBLE), 2) AS total_amount
        FROM edges t JOIN spans r ON r.root = t.src AND (t.ts, t.id) >= r.k_max
         AND t.ts < r.t_min + INTERVAL 168 HOUR
        GROUP BY t.id, t.src
        """,
    ),
)
def ring_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers whose sender is on a ring of the last day, with the largest ring."""
    valid = T.received(spark, sf_dir).where("amount > 0")
    rows = mark_first(valid, "transaction_id", ("timestamp", "seq"))
    rows = rows.where("is_first")
    found = D.ring_alerts(rows)
    total = F.get_json_object("details", "$.total_amount").cast("double")
    return found.select(
        "transaction_id", "sender_iban", F.round(total, 2).alias("total_amount")
    )


@query(
    "F6 F9",
    T.with_ctes(
        _TRAVEL,
        f"""
        SELECT count(*) AS transactions_processed,
               count(*) FILTER (contains(description, 'error')) AS blacklist_hits,
               (SELECT count(*) FROM moves WHERE km / hours > 900) AS impossible_travel
        FROM received
        """,
    ),
)
def detector_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a run of two detectors over all transactions."""
    rows = T.received(spark, sf_dir)
    options = DetectionOptions(blacklist=("error",))
    found = D.run_detectors(rows, options, rings=False)
    return D.detection_counters(rows, found).select(
        "transactions_processed", "blacklist_hits", "impossible_travel"
    )


@query(
    "F11",
    T.with_ctes(
        T.RECEIVED,
        """
        SELECT sender_iban, CAST(epoch(date_trunc('day', "timestamp")) AS BIGINT) AS day,
               count(*) AS transfers, round(sum(amount), 2) AS total
        FROM received WHERE amount < 60 AND amount >= 60 * 0.5
        GROUP BY 1, 2 HAVING count(*) >= 2 AND sum(amount) > 60
        """,
    ),
)
def structuring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several amounts just under a limit within one day."""
    options = DetectionOptions(
        reporting_limit=60, structuring_band=0.5, structuring_min_count=2
    )
    found = D.structuring(T.received(spark, sf_dir), options)
    return found.select(
        "sender_iban", F.unix_seconds("day").alias("day"), "transfers",
        F.round("total", 2).alias("total"),
    )


@query(
    "F13",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS amount
    FROM lineitem WHERE l_extendedprice >= 90000
    """,
)
def high_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers at or above the high-value limit."""
    rows = T.table(spark, sf_dir, "lineitem").withColumn("amount", F.col("l_extendedprice"))
    return D.high_value(rows, DetectionOptions(high_value_amount=90_000)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "amount"
    )


@query(
    "F12",
    T.with_ctes(
        T.CANONICAL + ", features AS (" + _HISTORY_SQL.format(probes="tx", history="rec") + ")",
        """
        SELECT seq, transaction_id, sender_tx_count_24h >= 4 AS velocity_anomaly,
               receiver_unique_senders_7d >= 20 AS mule_account
        FROM features WHERE sender_tx_count_24h >= 4 OR receiver_unique_senders_7d >= 20
        """,
    ),
)
def velocity_and_mules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Busy senders and accounts that collect from many senders."""
    from finsieve.operators.history import build_features

    options = DetectionOptions(velocity_count_24h=4, mule_unique_senders_7d=20)
    flags = D.velocity_flags(build_features(T.canonical(spark, sf_dir)), options)
    return flags.where("velocity_anomaly or mule_account").select(
        "seq", "transaction_id", "velocity_anomaly", "mule_account"
    )


# --- alert lists and statistics ----------------------------------------------------------------------------
@query(
    "H1 B28 C7",
    T.with_ctes(
        _ALERTS,
        """
        SELECT alert_id, transaction_id, amount FROM alerts
        WHERE severity = 'high' AND fraud_type = 'structuring'
          AND detected_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'
        ORDER BY detected_at DESC, alert_id DESC LIMIT 20 OFFSET 20
        """,
    ),
)
def alert_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second page of filtered alerts, newest first."""
    rows, _ = A.list_alerts(
        alerts(spark, sf_dir), page=2, size=20, start=_at("2024-01-05"), end=_at("2024-01-25"),
        severity="high", fraud_type="structuring",
    )
    return rows.select("alert_id", "transaction_id", "amount")


@query(
    "H2 B24 B26",
    T.with_ctes(
        _ALERTS,
        """
        SELECT alert_id, fraud_type, 'Ml Model Detected' AS title, severity, amount FROM alerts
        WHERE alert_id = (SELECT min(alert_id) FROM alerts WHERE fraud_type = 'ml_model')
        """,
    ),
)
def alert_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert by its id (here the smallest id of a type)."""
    rows = alerts(spark, sf_dir)
    wanted = rows.where("fraud_type = 'ml_model'").agg(F.min("alert_id")).first()[0]
    return A.alert_by_id(rows, wanted).select(
        "alert_id", "fraud_type", "title", "severity", "amount"
    )


@query(
    "H3",
    T.with_ctes(
        _ALERTS,
        """
        SELECT CASE WHEN GROUPING(fraud_type) = 0 THEN 'fraud_type'
                    WHEN GROUPING(severity) = 0 THEN 'severity' ELSE 'total' END AS breakdown,
               coalesce(fraud_type, severity, 'all') AS value, count(*) AS alerts
        FROM alerts WHERE detected_at >= TIMESTAMP '2024-01-05'
        GROUP BY GROUPING SETS ((), (fraud_type), (severity))
        """,
    ),
)
def alert_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts in total, by type and by severity."""
    return A.alert_stats(alerts(spark, sf_dir), start=_at("2024-01-05"))


@query(
    "H4",
    T.with_ctes(
        _ALERTS
        + """,
        log AS (SELECT alert_id, 'analyst' || CAST(n AS VARCHAR) AS who,
                       detected_at + INTERVAL 1 HOUR * n AS done_at
                FROM alerts, (VALUES (1), (2)) AS v(n)
                WHERE fraud_type = 'structuring' AND (n = 1 OR severity = 'high'))""",
        """
        SELECT a.alert_id, l.who IS NOT NULL AS is_dismissed, l.who AS dismissed_by
        FROM alerts a LEFT JOIN (SELECT alert_id, arg_max(who, (done_at, who)) AS who FROM log
                                 GROUP BY alert_id) l ON l.alert_id = a.alert_id
        """,
    ),
)
def dismissed_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts with their newest dismissal."""
    rows = alerts(spark, sf_dir)
    n = F.explode(F.array(F.lit(1), F.lit(2))).alias("n")
    log = rows.where("fraud_type = 'structuring'").select("*", n).where(
        "n = 1 or severity = 'high'"
    ).select(
        "alert_id", F.concat(F.lit("analyst"), F.col("n").cast("string")).alias("dismissed_by"),
        F.timestamp_micros(F.unix_micros("detected_at") + F.col("n") * S.HOUR_US)
        .alias("dismissed_at"),
        F.lit("known").alias("reason"),
    )
    return A.dismiss(rows, log).select("alert_id", "is_dismissed", "dismissed_by")


@query(
    "A7 A8 C5",
    T.with_ctes(
        _ALERTS,
        """
        SELECT transaction_id, fraud_type, alert_id,
               CAST(epoch(min(detected_at)) AS BIGINT) AS first_seen
        FROM alerts GROUP BY 1, 2, 3
        """,
    ),
)
def unique_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert per transaction and type."""
    kept = A.first_per_key(alerts(spark, sf_dir))
    return kept.select(
        "transaction_id", "fraud_type", "alert_id",
        F.unix_seconds("detected_at").alias("first_seen"),
    )


@query(
    "A13",
    T.with_ctes(
        _ALERTS
        + """,
        kept AS (SELECT transaction_id, alert_id, arg_min(confidence, (detected_at)) AS c
                 FROM alerts GROUP BY 1, 2)""",
        """
        SELECT r.seq, r.transaction_id, k.ids IS NOT NULL AS is_fraud,
               coalesce(k.ids, '') AS alert_ids
        FROM received r LEFT JOIN (
          SELECT transaction_id, string_agg(alert_id, ',' ORDER BY alert_id) AS ids
          FROM kept GROUP BY 1) k ON k.transaction_id = r.transaction_id
        """,
    ),
)
def transaction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processing result of every transaction."""
    rows = A.transaction_summary(
        T.received(spark, sf_dir).select("seq", "transaction_id"), alerts(spark, sf_dir)
    )
    return rows.select(
        "seq", "transaction_id", "is_fraud", F.concat_ws(",", "alert_ids").alias("alert_ids")
    )


@query(
    "H16",
    T.with_ctes(
        _ALERTS,
        f"""
        SELECT sender_city AS from_city, receiver_city AS to_city, count(*) AS alerts
        FROM alerts
        WHERE sender_city IN (SELECT city FROM {_POINTS})
          AND receiver_city IN (SELECT city FROM {_POINTS})
        GROUP BY 1, 2
        """,
    ),
)
def city_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts between pairs of known cities."""
    return A.city_flows(alerts(spark, sf_dir))


@query(
    "H14",
    T.with_ctes(
        _ALERTS + "," + _CASES,
        f"""
        SELECT (SELECT count(*) FROM received) AS transactions_processed,
               (SELECT count(DISTINCT transaction_id) FROM alerts) AS fraud_detected,
               (SELECT count(*) FROM alerts) AS alerts_created,
               (SELECT count(*) FROM cases WHERE {_OPEN}) AS cases_open,
               (SELECT count(*) FROM cases WHERE NOT {_OPEN}) AS cases_resolved,
               (SELECT round(100.0 * count(DISTINCT a.transaction_id)
                             / (SELECT count(*) FROM received), 2) FROM alerts a) AS fraud_rate
        """,
    ),
)
def system_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System-wide counts."""
    return A.system_stats(
        T.received(spark, sf_dir), alerts(spark, sf_dir), cases(spark, sf_dir)
    )


@query(
    "H15",
    T.with_ctes(
        _ALERTS, "SELECT fraud_type, severity, count(*) AS alerts FROM alerts GROUP BY 1, 2"
    ),
)
def live_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts per type and severity."""
    return A.live_counters(alerts(spark, sf_dir))


@query(
    "B25",
    """
    WITH raw AS (
      SELECT doc_id, quality, toxic, doc_id % 5 AS shape FROM labels
    )
    SELECT doc_id, CASE WHEN shape IN (0, 1) THEN CAST(quality + 1 AS BIGINT) ELSE 0 END AS items,
           CASE WHEN shape IN (0, 1) THEN 'rule' END AS first_detector
    FROM raw
    """,
)
def repaired_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence stored in old shapes read as a list."""
    from finsieve import schemas

    one = F.lit('{"detector_type":"rule","confidence":0.5}')
    inner = F.array_join(F.array_repeat(one, F.col("quality") + 1), ",")
    shape = F.col("doc_id") % 5
    stored = (
        F.when(shape == 0, F.concat(F.lit("["), inner, F.lit("]")))
        .when(shape == 1, F.concat(F.lit('{"items":['), inner, F.lit("]}")))
        .when(shape == 2, F.lit('{"other":1}'))
        .when(shape == 3, F.lit("text"))
    )
    items = S.repaired_evidence(stored, schemas.EVIDENCE_ITEM.strip())
    rows = T.table(spark, sf_dir, "labels").withColumn("items", items)
    return rows.select(
        "doc_id", F.size("items").cast("long").alias("items"),
        F.when(F.size("items") > 0, F.col("items")[0]["detector_type"]).alias("first_detector"),
    )


# --- cases --------------------------------------------------------------------------------
@query(
    "H5 B28",
    T.with_ctes(
        _CASES,
        f"""
        SELECT case_id, status, priority FROM cases WHERE {_OPEN} AND priority = 'P2'
        ORDER BY created_at DESC, case_id DESC LIMIT 10
        """,
    ),
)
def case_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest open cases of one priority."""
    rows, _ = K.list_cases(cases(spark, sf_dir), size=10, open_only=True, priority="P2")
    return rows.select("case_id", "status", "priority")


@query(
    "H6",
    T.with_ctes(
        _CASES
        + f""",
        s AS (SELECT *, CASE WHEN {_OPEN} THEN 'open' ELSE 'closed' END AS state FROM cases)""",
        """
        SELECT CASE WHEN GROUPING(state) = 0 THEN 'state' WHEN GROUPING(status) = 0 THEN 'status'
                    WHEN GROUPING(priority) = 0 THEN 'priority' ELSE 'total' END AS breakdown,
               coalesce(state, status, priority, 'all') AS value, count(*) AS cases
        FROM s GROUP BY GROUPING SETS ((), (state), (status), (priority))
        """,
    ),
)
def case_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases in total, open and closed, by status and priority."""
    return K.case_stats(cases(spark, sf_dir))


_RANK = _sql_map("severity", vocab.SEVERITY_RANK)


@query(
    "H7",
    T.with_ctes(
        _ALERTS
        + ","
        + _CASES
        + """,
        members AS (
          SELECT case_id, 'a' AS kind, sender_iban AS m FROM alerts
          UNION SELECT case_id, 'a', receiver_iban FROM alerts
          UNION SELECT case_id, 't', transaction_id FROM alerts)""",
        f"""
        SELECT c.case_id, coalesce(g.n, 0) AS alert_count,
               round(coalesce(g.total, 0), 2) AS total_amount, g.severity AS max_severity,
               round(coalesce(g.conf, 0), 6) AS avg_confidence,
               coalesce(g.types, '') AS fraud_types, g.main AS primary_fraud_type,
               coalesce(m.accounts, 0) AS involved_accounts,
               coalesce(m.transactions, 0) AS involved_transactions,
               CAST(epoch(g.first_at) AS BIGINT) AS first_alert_at
        FROM cases c LEFT JOIN (
          SELECT case_id, count(*) AS n, sum(amount) AS total, avg(confidence) AS conf,
                 arg_max(severity, {_RANK}) AS severity,
                 string_agg(DISTINCT fraud_type, ',' ORDER BY fraud_type) AS types,
                 arg_min(fraud_type, (-{_RANK}, fraud_type)) AS main, min(detected_at) AS first_at
          FROM alerts GROUP BY case_id) g ON g.case_id = c.case_id
        LEFT JOIN (
          SELECT case_id, count(*) FILTER (kind = 'a') AS accounts,
                 count(*) FILTER (kind = 't') AS transactions
          FROM members GROUP BY case_id) m ON m.case_id = c.case_id
        """,
    ),
)
def case_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert figures of every case."""
    rows = K.case_aggregates(cases(spark, sf_dir), alerts(spark, sf_dir))
    return rows.select(
        "case_id", "alert_count", F.round("total_amount", 2).alias("total_amount"),
        "max_severity", F.round("avg_confidence", 6).alias("avg_confidence"),
        F.concat_ws(",", "fraud_types").alias("fraud_types"), "primary_fraud_type",
        "involved_accounts", "involved_transactions",
        F.unix_seconds("first_alert_at").alias("first_alert_at"),
    )


@query(
    "H8",
    T.with_ctes(
        _CASES,
        f"""
        SELECT case_id, CAST(epoch(due) AS BIGINT) AS sla_due_at,
               ({_OPEN} AND due < TIMESTAMP '{_AS_OF}') AS sla_breached
        FROM (SELECT *, created_at + INTERVAL 1 HOUR * {_sql_map("priority", vocab.SLA_HOURS)}
                        AS due FROM cases)
        """,
    ),
)
def case_sla(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due time of every case and whether it is late."""
    rows = K.with_sla(cases(spark, sf_dir), _at())
    return rows.select("case_id", F.unix_seconds("sla_due_at").alias("sla_due_at"),
                       "sla_breached")


@query(
    "H9",
    T.with_ctes(
        _CASES
        + f""",
        asked AS (SELECT case_id, status,
                         {T._sql_cycle(_STATUSES, "CAST(substr(case_id, 6) AS BIGINT) * 5 % 8")}
                           AS wanted FROM cases)""",
        f"""
        SELECT case_id, status, wanted,
               (status <> wanted AND (({_OPEN}) OR (status LIKE 'resolved%'
                 AND wanted IN ('closed', 'investigating')))) AS allowed
        FROM asked
        """,
    ),
)
def status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which status change of each case is allowed."""
    number = F.substring("case_id", 6, 20).cast("long")
    rows = cases(spark, sf_dir).withColumn(
        "wanted", T._cycle(_STATUSES, number * 5 % len(_STATUSES))
    )
    return rows.select(
        "case_id", "status", "wanted",
        K.is_valid_transition(F.col("status"), F.col("wanted")).alias("allowed"),
    )


def update_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an update request for the case of its user."""
    rows = T.table(spark, sf_dir, "events")
    n = F.col("event_id")
    return rows.select(
        F.concat(F.lit("CASE-"), F.col("user_id").cast("string")).alias("case_id"),
        n.alias("update_seq"), F.col("ts").cast("timestamp").alias("at"),
        F.when(n % 3 == 0, T._cycle(_STATUSES[:7], n % 7)).alias("status"),
        F.when(n % 4 == 0, F.concat(F.lit("P"), (n % 16 / 4 + 1).cast("int").cast("string")))
        .alias("priority"),
        F.when(n % 6 == 0, F.concat(F.lit("analyst"), (n % 5).cast("string")))
        .alias("assigned_to"),
        F.lit(None).cast("string").alias("assigned_team"),
        F.when(n % 5 == 0, F.concat(F.lit("reason "), (n % 10).cast("string")))
        .alias("resolution"),
        F.when(n % 7 == 0, F.concat(F.lit(" note "), n.cast("string"))).alias("note"),
        F.lit("analyst").alias("actor"),
    )


_IS_OPEN = "IN ('" + "', '".join(vocab.OPEN_STATUSES) + "')"
_IS_DONE = "IN ('" + "', '".join(vocab.RESOLVED_STATUSES) + "')"

_JUDGED = (
    _CASES.replace("user_id % 2 = 0 AS str", "user_id AS number, user_id % 2 = 0 AS str")
    + f""",
log AS (
  SELECT 'CASE-' || CAST(user_id AS VARCHAR) AS case_id, event_id AS n, ts,
         CASE WHEN event_id % 3 = 0 THEN {T._sql_cycle(_STATUSES[:7], "event_id % 7")} END AS wanted,
         CASE WHEN event_id % 4 = 0 THEN 'P' || CAST(event_id % 16 // 4 + 1 AS VARCHAR) END
           AS priority,
         CASE WHEN event_id % 6 = 0 THEN 'analyst' || CAST(event_id % 5 AS VARCHAR) END AS assigned,
         CASE WHEN event_id % 5 = 0 THEN 'reason ' || CAST(event_id % 10 AS VARCHAR) END AS reason,
         CASE WHEN event_id % 7 = 0 THEN 'note ' || CAST(event_id AS VARCHAR) END AS note,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i
  FROM events),
walk AS (
  SELECT case_id, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS n, status AS before,
         status AS after, CAST(NULL AS VARCHAR) AS code
  FROM cases
  UNION ALL
  SELECT case_id, i, n, before,
         CASE WHEN code IS NULL AND wanted IS NOT NULL THEN wanted ELSE before END, code
  FROM (
    SELECT l.case_id, l.i, l.n, w.after AS before, l.wanted,
           CASE WHEN l.wanted <> w.after THEN
             CASE WHEN w.after = 'closed' OR (w.after {_IS_DONE}
                       AND l.wanted NOT IN ('closed', 'investigating'))
                    THEN 'invalid_status_transition'
                  WHEN l.wanted {_IS_DONE} AND l.reason IS NULL THEN 'resolution_required' END
             WHEN l.reason IS NOT NULL AND NOT w.after {_IS_DONE} THEN 'resolution_not_allowed'
           END AS code
    FROM walk w JOIN log l ON l.case_id = w.case_id AND l.i = w.i + 1)
),
good AS (SELECT l.*, w.before, w.after FROM walk w JOIN log l ON l.n = w.n WHERE w.code IS NULL)"""
)


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "H10",
    _recursive(
        T.with_ctes(
            _JUDGED,
            """
            SELECT case_id, n AS update_seq, before AS status_before, after AS status_after, code
            FROM walk WHERE i > 0
            """,
        )
    ),
)
def judged_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status before and after every update request, and why it was refused."""
    rows = K.judge_updates(cases(spark, sf_dir), update_log(spark, sf_dir))
    return rows.select("case_id", "update_seq", "status_before", "status_after", "code")


@query(
    "H10",
    _recursive(
        T.with_ctes(
            _JUDGED,
            """
            SELECT c.case_id, coalesce(g.after, c.status) AS status,
                   coalesce(g.priority, c.priority) AS priority,
                   coalesce(g.assigned, c.assigned_to) AS assigned_to,
                   coalesce(g.reason, CASE WHEN c.number % 8 = 5 THEN 'confirmed' END)
                     AS resolution,
                   coalesce(g.notes, 0) AS notes_count, g.note AS last_note
            FROM cases c LEFT JOIN (
              SELECT case_id, arg_max(after, i) AS after, arg_max(priority, i) AS priority,
                     arg_max(assigned, i) AS assigned, arg_max(reason, i) AS reason,
                     count(note) AS notes, arg_max(note, i) AS note
              FROM good GROUP BY case_id) g ON g.case_id = c.case_id
            """,
        )
    ),
)
def cases_after_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases after all accepted updates."""
    base = cases(spark, sf_dir)
    rows = K.updated_cases(base, K.judge_updates(base, update_log(spark, sf_dir)))
    return rows.select("case_id", "status", "priority", "assigned_to", "resolution",
                       "notes_count", "last_note")


@query(
    "H10 H12",
    _recursive(
        T.with_ctes(
            _JUDGED
            + """,
            past AS (
              SELECT g.*,
                coalesce(last_value(g.priority IGNORE NULLS) OVER w, c.priority) AS old_p,
                coalesce(last_value(g.assigned IGNORE NULLS) OVER w, c.assigned_to) AS old_a,
                coalesce(last_value(g.reason IGNORE NULLS) OVER w,
                         CASE WHEN c.number % 8 = 5 THEN 'confirmed' END) AS old_r
              FROM good g JOIN cases c ON c.case_id = g.case_id
              WINDOW w AS (PARTITION BY g.case_id ORDER BY g.i
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
            made AS (
              SELECT case_id, n, 'case_status_changed' AS event_type, before AS previous_value,
                     after AS new_value FROM past WHERE before <> after
              UNION ALL SELECT case_id, n, 'case_resolution_updated', old_r, reason FROM past
              WHERE before = after AND reason IS NOT NULL AND reason IS DISTINCT FROM old_r
              UNION ALL SELECT case_id, n, 'case_priority_changed', old_p, priority FROM past
              WHERE priority IS NOT NULL AND priority IS DISTINCT FROM old_p
              UNION ALL SELECT case_id, n, 'case_assigned', old_a, assigned FROM past
              WHERE assigned IS NOT NULL AND assigned IS DISTINCT FROM old_a
              UNION ALL SELECT case_id, n, 'note_added', NULL, note FROM past
              WHERE note IS NOT NULL)""",
            "SELECT case_id, n AS update_seq, event_type, previous_value, new_value FROM made",
        )
    ),
)
def case_audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit events of all accepted updates."""
    base = cases(spark, sf_dir)
    events = K.case_events(base, K.judge_updates(base, update_log(spark, sf_dir)))
    return events.select(
        "case_id", F.split("event_id", "-")[3].cast("long").alias("update_seq"), "event_type",
        "previous_value", "new_value",
    )


@query(
    "H12 C7",
    _recursive(
        T.with_ctes(
            _JUDGED,
            """
            SELECT n AS update_seq, before AS previous_value, after AS new_value FROM good
            WHERE case_id = 'CASE-8' AND before <> after ORDER BY ts DESC, n DESC LIMIT 50
            """,
        )
    ),
)
def case_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest status changes of one case."""
    base = cases(spark, sf_dir)
    events = K.case_events(base, K.judge_updates(base, update_log(spark, sf_dir)))
    rows, _ = K.timeline(events, "CASE-8", "case_status_changed")
    return rows.select(
        F.split("event_id", "-")[3].cast("long").alias("update_seq"), "previous_value",
        "new_value",
    )


def link_requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(requests, alerts): every alert asks twice to join some case."""
    rows = A.first_per_key(alerts(spark, sf_dir))
    number = F.substring("sender_iban", 2, 10).cast("long")
    asked = rows.select(
        "alert_id", number.alias("n"), F.explode(F.array(F.lit(1), F.lit(2))).alias("turn")
    ).select(
        F.concat_ws("-", "alert_id", "turn").alias("request_seq"),
        F.concat(F.lit("CASE-"), ((F.col("n") + F.col("turn")) % 160).cast("string"))
        .alias("case_id"),
        "alert_id",
    )
    dismissed = F.substring("alert_id", 7, 1).isin("0", "1")
    return asked, rows.withColumn("is_dismissed", dismissed)


@query(
    "H11 C6",
    T.with_ctes(
        _ALERTS
        + ","
        + _CASES
        + f""",
        kept AS (SELECT alert_id, f.case_id AS now_case,
                        CAST(substr(f.sender_iban, 2) AS BIGINT) AS n,
                        substr(alert_id, 7, 1) IN ('0', '1') AS dismissed
                 FROM (SELECT alert_id, arg_min(struct_pack(case_id, sender_iban),
                                (detected_at, sender_iban, receiver_iban, amount)) AS f
                       FROM alerts GROUP BY alert_id)),
        states AS (SELECT case_id, {_OPEN} AS open FROM cases),
        asked AS (
          SELECT k.*, t.turn, k.alert_id || '-' || CAST(t.turn AS VARCHAR) AS request_seq,
                 'CASE-' || CAST((k.n + t.turn) % 160 AS VARCHAR) AS case_id
          FROM kept k, (VALUES (1), (2)) AS t(turn)),
        facts AS (
          SELECT a.*, s.open AS target_open, coalesce(c.open, false) AS now_open,
                 coalesce(s.open AND NOT a.dismissed AND NOT coalesce(c.open, false)
                  AND a.case_id IS DISTINCT FROM a.now_case, false) AS fits
          FROM asked a LEFT JOIN states s ON s.case_id = a.case_id
          LEFT JOIN states c ON c.case_id = a.now_case),
        won AS (SELECT alert_id, min(turn) AS turn FROM facts WHERE fits GROUP BY alert_id)""",
        """
        SELECT f.request_seq, f.case_id, f.alert_id,
               CASE WHEN f.target_open IS NULL THEN 'case_not_found'
                    WHEN f.case_id = CASE WHEN w.turn < f.turn
                      THEN 'CASE-' || CAST((f.n + w.turn) % 160 AS VARCHAR)
                      ELSE f.now_case END THEN 'unchanged'
                    WHEN NOT f.target_open THEN 'case_not_open'
                    WHEN f.dismissed THEN 'alert_dismissed'
                    WHEN w.turn = f.turn AND f.now_case IS NOT NULL THEN 'moved'
                    WHEN w.turn = f.turn THEN 'linked'
                    ELSE 'alert_already_linked' END AS verdict
        FROM facts f LEFT JOIN won w ON w.alert_id = f.alert_id
        """,
    ),
)
def link_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to link alerts to cases and what becomes of them."""
    asked, rows = link_requests(spark, sf_dir)
    judged = K.judge_links(asked, rows, cases(spark, sf_dir))
    return judged.select("request_seq", "case_id", "alert_id", "verdict")


@query(
    "H13",
    T.with_ctes(
        _ALERTS + "," + _CASES,
        """
        SELECT c.case_id, a.alert_id FROM cases c LEFT JOIN alerts a ON a.case_id = c.case_id
        """,
    ),
)
def case_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with the ids of their alerts."""
    return K.case_alerts(cases(spark, sf_dir), alerts(spark, sf_dir)).select(
        "case_id", "alert_id"
    )


@query(
    "H17",
    T.with_ctes(
        _CASES,
        """
        SELECT count(*) FILTER (str_required) AS reports,
               count(*) FILTER (str_required AND NOT str_filed) AS pending,
               count(*) FILTER (str_filed) AS submitted FROM cases
        """,
    ),
)
def compliance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports required, pending and filed."""
    return K.compliance_counts(cases(spark, sf_dir))
