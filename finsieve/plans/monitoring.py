"""Queries over datasets, model quality, drift, feature store and experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsieve.functions import scalars as S
from finsieve.operators import dataset as B
from finsieve.operators import drift as D
from finsieve.operators import evaluation as E
from finsieve.operators import experiments as X
from finsieve.operators import feature_store as V
from finsieve.plans import tables as T
from finsieve.plans.registry import query


# --- dataset --------------------------------------------------------------------------------
def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical transactions with a label: large amounts, typed by payment type."""
    rows = T.canonical(spark, sf_dir)
    return rows.withColumns(
        {
            "is_laundering": (F.col("amount") > 150).cast("int"),
            "laundering_type": F.concat(F.lit("via_"), "payment_type"),
        }
    )


_SPLIT = (
    T.CANONICAL
    + """,
counts AS (SELECT ts, count(*) AS n FROM tx GROUP BY ts),
ranked AS (SELECT ts, n, sum(n) OVER (ORDER BY ts) - n AS before, sum(n) OVER () AS total
           FROM counts),
bounds AS (
  SELECT min(ts) AS train_start,
         min(ts) FILTER (before >= least(floor(total * 0.7::DOUBLE), total - 1)) AS val_start,
         min(ts) FILTER (before >= least(floor(total * 0.85::DOUBLE), total - 1)) AS test_start
  FROM ranked),
split AS (
  SELECT t.*, CASE WHEN ts >= test_start THEN 'test' WHEN ts >= val_start THEN 'val'
                   ELSE 'train' END AS split, (amount > 150) AS positive
  FROM tx t, bounds)"""
)


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    return B.assign_split(rows, B.split_boundaries(rows))


@query(
    "J1 J2 J3",
    T.with_ctes(
        _SPLIT,
        """
        SELECT split, count(*) AS rows, CAST(epoch(min(ts)) AS BIGINT) AS first,
               CAST(epoch(max(ts)) AS BIGINT) AS last
        FROM split GROUP BY split
        """,
    ),
)
def chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and time ranges of the three splits."""
    ranges = B.split_ranges(_split(spark, sf_dir))
    return ranges.select(
        "split", "rows", F.unix_seconds("first").alias("first"),
        F.unix_seconds("last").alias("last"),
    )


@query(
    "J5",
    T.with_ctes(
        _SPLIT,
        """
        SELECT split, 'via_' || payment_type AS laundering_type, count(*) AS rows
        FROM split WHERE positive GROUP BY 1, 2
        """,
    ),
)
def manifest_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives by split and type."""
    return B.manifest_types(_split(spark, sf_dir))


@query(
    "J5",
    T.with_ctes(
        _SPLIT,
        """
        SELECT count(*) AS rows, count(*) FILTER (positive) AS positives,
               round(avg(positive::INT), 9) AS positive_rate,
               count(*) FILTER (payment_type = 'unknown') AS unknown_payment_type,
               (SELECT count(*) FROM (SELECT sender FROM tx UNION SELECT receiver FROM tx))
                 AS unique_accounts
        FROM split
        """,
    ),
)
def manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the labelled dataset."""
    row = B.manifest_totals(labelled(spark, sf_dir))
    return row.select("rows", "positives", F.round("positive_rate", 9).alias("positive_rate"),
                      "unknown_payment_type", "unique_accounts")


@query("J6", None)
def dataset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-free hash of all order lines."""
    row = B.fingerprint(T.table(spark, sf_dir, "lineitem"))
    return row.select("rows", F.col("hash_sum").cast("string").alias("hash_sum"), "hash_xor")


@query("J7", None)
def sampled_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All positives and a tenth of the negatives."""
    kept = B.sample_negatives(labelled(spark, sf_dir), 0.1, seed=7)
    return kept.groupBy("is_laundering").agg(F.count("*").alias("rows"))


# --- evaluation --------------------------------------------------------------------------------
def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score from their length (many ties)."""
    docs = T.table(spark, sf_dir, "documents")
    score = (F.floor(F.least("n_chars", F.lit(9999)) / 50) * 50 + 1) / 10_001
    return T.table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        "doc_id", F.col("quality").alias("label"), score.alias("score"),
        F.col("lang").alias("typology"),
    )


_SCORED = """
scored AS (
  SELECT l.doc_id, l.quality AS label, d.lang AS typology,
         (floor(least(d.n_chars, 9999) / 50) * 50 + 1) / 10001 AS score
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
steps AS (
  SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY score),
ranked AS (
  SELECT *, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg, sum(pos) OVER () AS all_pos,
         sum(neg) OVER () AS all_neg
  FROM steps WINDOW w AS (ORDER BY score DESC))"""


@query(
    "J15 J16",
    T.with_ctes(
        _SCORED,
        """
        SELECT round(sum(CAST(pos AS DOUBLE) / all_pos * cum_pos / (cum_pos + cum_neg)), 9)
                 AS pr_auc,
               round(sum(neg * (cum_pos - pos / 2.0)) / max(CAST(all_pos AS DOUBLE) * all_neg), 9)
                 AS roc_auc,
               CAST(max(all_pos) AS BIGINT) AS support_positive,
               CAST(max(all_pos + all_neg) AS BIGINT) AS support_total
        FROM ranked
        """,
    ),
)
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision and ROC area of the scored documents."""
    row = E.ranking_metrics(E.score_table(scored(spark, sf_dir)))
    return row.withColumns({c: F.round(c, 9) for c in ("pr_auc", "roc_auc")})


@query(
    "J17",
    T.with_ctes(
        _SCORED,
        """
        SELECT round(score, 9) AS threshold,
               round(CAST(cum_pos AS DOUBLE) / (cum_pos + cum_neg), 9) AS precision,
               round(CAST(cum_pos AS DOUBLE) / all_pos, 9) AS recall
        FROM ranked WHERE CAST(cum_pos AS DOUBLE) / (cum_pos + cum_neg) >= 0.6
        ORDER BY 3 DESC, 2 DESC, 1 DESC LIMIT 1
        """,
    ),
)
def chosen_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest-recall threshold with a precision of at least 0.6."""
    row = E.choose_threshold(E.score_table(scored(spark, sf_dir)), 0.6)
    return row.select(*[F.round(c, 9).alias(c) for c in row.columns])


@query(
    "J12 J18",
    T.with_ctes(
        _SCORED
        + """,
        c AS (SELECT count(*) FILTER (score >= 0.2 AND label = 1) AS tp,
                     count(*) FILTER (score >= 0.2 AND label = 0) AS fp,
                     count(*) FILTER (score < 0.2 AND label = 1) AS fn,
                     count(*) FILTER (score < 0.2 AND label = 0) AS tn FROM scored)""",
        """
        SELECT tp, fp, fn, tn, tp + fp AS alerts, round(tp / (tp + fp), 9) AS precision,
               round(tp / (tp + fn), 9) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 9) AS f1
        FROM c
        """,
    ),
)
def threshold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts and ratios at a threshold."""
    row = E.at_threshold(scored(spark, sf_dir), F.lit(0.2))
    return row.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(
    "J19",
    T.with_ctes(
        _SCORED,
        """
        SELECT typology, count(*) AS support, count(*) FILTER (score >= 0.2) AS detected,
               round(count(*) FILTER (score >= 0.2) / count(*), 9) AS recall
        FROM scored WHERE label = 1 GROUP BY typology
        """,
    ),
)
def typology_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall by language of the positives."""
    rows = E.typology_recall(scored(spark, sf_dir), F.lit(0.2))
    return rows.withColumn("recall", F.round("recall", 9))


@query(
    "J20",
    """
    WITH ms AS (SELECT l_extendedprice / 1e6 AS v FROM lineitem)
    SELECT count(*) AS n, round(quantile_cont(v, 0.5), 9) AS p50_ms,
           round(quantile_cont(v, 0.95), 9) AS p95_ms, round(quantile_cont(v, 0.99), 9) AS p99_ms,
           round(max(v), 9) AS max_ms
    FROM ms
    """,
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of all order-line prices read as nanoseconds."""
    row = E.latency_summary(T.table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return row.select("n", *[F.round(c, 9).alias(c) for c in row.columns if c != "n"])


@query(
    "J21 J22",
    T.with_ctes(
        _SCORED
        + """,
        c AS (SELECT count(*) FILTER (score >= 0.2 AND label = 1) AS tp,
                     count(*) FILTER (score >= 0.2) AS alerts,
                     count(*) FILTER (label = 1) AS real FROM scored),
        m AS (
          SELECT 'pr_auc' AS metric,
                 sum(CAST(pos AS DOUBLE) / all_pos * cum_pos / (cum_pos + cum_neg)) AS value
          FROM ranked
          UNION ALL SELECT 'precision', tp / alerts FROM c
          UNION ALL SELECT 'recall', tp / real FROM c
          UNION ALL SELECT 'min_typology_recall', min(r) FROM (
            SELECT count(*) FILTER (score >= 0.2) / count(*) AS r FROM scored WHERE label = 1
            GROUP BY typology HAVING count(*) >= 30)),
        goals AS (SELECT * FROM (VALUES ('pr_auc', '>=', 0.4), ('pr_auc_gain', '>=', 0.25),
          ('precision', '>=', 0.15), ('recall', '>=', 0.5), ('min_typology_recall', '>=', 0.2),
          ('artifact_bytes', '<=', 5242880), ('predict_p95_ms', '<=', 5), ('num_trees', '<=', 200),
          ('max_depth', '<=', 6)) AS g(metric, way, goal))""",
        """
        SELECT g.metric, round(m.value, 9) AS value,
               (coalesce(CASE way WHEN '>=' THEN m.value >= goal ELSE m.value <= goal END, false)
                OR (g.metric = 'min_typology_recall' AND m.value IS NULL)) AS passed
        FROM goals g LEFT JOIN m ON m.metric = g.metric
        """,
    ),
)
def target_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation figures against the targets; what was not measured fails."""
    figures = E.evaluate(scored(spark, sf_dir), 0.2, typology="typology")
    rows = E.check_targets(figures)
    return rows.select("metric", F.round("value", 9).alias("value"), "passed")


# --- drift --------------------------------------------------------------------------------
_CUT = "1998-01-01"
_NUMBERS = ("l_discount", "l_extendedprice", "l_quantity")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Order lines shipped before a day, and the later ones with a shifted quantity."""
    rows = T.table(spark, sf_dir, "lineitem")
    cut = F.lit(_CUT).cast("timestamp")
    shifted = rows.where(F.col("l_shipdate") >= cut).withColumn(
        "l_quantity", F.col("l_quantity") + 5
    )
    names = [*_NUMBERS, "l_linestatus", "l_returnflag"]
    return rows.where(F.col("l_shipdate") < cut).select(*names), shifted.select(*names)


_SIDES = f"""
halves AS (
  SELECT l_shipdate < TIMESTAMP '{_CUT}' AS is_ref, l_discount, l_extendedprice,
         l_quantity + CASE WHEN l_shipdate < TIMESTAMP '{_CUT}' THEN 0 ELSE 5 END AS l_quantity,
         l_linestatus, l_returnflag
  FROM lineitem),
vals AS (
  SELECT is_ref, 'l_discount' AS feature, l_discount AS value FROM halves
  UNION ALL SELECT is_ref, 'l_extendedprice', l_extendedprice FROM halves
  UNION ALL SELECT is_ref, 'l_quantity', l_quantity FROM halves)"""

_PSI = """
lows AS (SELECT feature, min(value) AS low, max(value) AS high,
                count(*) FILTER (is_ref) AS n_ref, count(*) FILTER (NOT is_ref) AS n_cur
         FROM vals GROUP BY feature),
binned AS (
  SELECT v.feature, v.is_ref,
         (SELECT count(*) FROM range(1, 10) AS r(i)
          WHERE v.value >= l.low + (l.high - l.low) / 10 * r.i) AS bin
  FROM vals v JOIN lows l ON l.feature = v.feature),
bins AS (SELECT l.feature, r.i AS bin, l.n_ref, l.n_cur,
                count(b.bin) FILTER (b.is_ref) AS ref, count(b.bin) FILTER (NOT b.is_ref) AS cur
         FROM lows l CROSS JOIN range(0, 10) AS r(i)
         LEFT JOIN binned b ON b.feature = l.feature AND b.bin = r.i
         GROUP BY ALL),
psi AS (
  SELECT feature, sum(((cur + 1) / (n_cur + 10) - (ref + 1) / (n_ref + 10))
                      * ln(((cur + 1) / (n_cur + 10)) / ((ref + 1) / (n_ref + 10)))) AS psi
  FROM bins GROUP BY feature)"""


@query(
    "K1",
    T.with_ctes(_SIDES + "," + _PSI, "SELECT feature, round(psi, 6) AS psi FROM psi"),
)
def population_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PSI of three numeric columns before and after a day."""
    found = D.psi(D.value_counts(*_halves(spark, sf_dir), _NUMBERS))
    return found.select("feature", F.round("psi", 6).alias("psi"))


_KS = """
points AS (
  SELECT feature, value, count(*) FILTER (is_ref) AS ref, count(*) FILTER (NOT is_ref) AS cur
  FROM vals GROUP BY feature, value),
gaps AS (
  SELECT feature, abs(CAST(sum(ref) OVER w AS DOUBLE) / sum(ref) OVER a
                      - CAST(sum(cur) OVER w AS DOUBLE) / sum(cur) OVER a) AS gap
  FROM points WINDOW w AS (PARTITION BY feature ORDER BY value),
                     a AS (PARTITION BY feature)),
ks AS (SELECT feature, max(gap) AS statistic FROM gaps GROUP BY feature)"""


@query(
    "K2",
    T.with_ctes(
        _SIDES + "," + _KS, "SELECT feature, round(statistic, 9) AS statistic FROM ks"
    ),
)
def ks_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kolmogorov-Smirnov statistic of three numeric columns."""
    found = D.ks_test(D.value_counts(*_halves(spark, sf_dir), _NUMBERS))
    return found.select("feature", F.round("statistic", 9).alias("statistic"))


@query(
    "K3",
    T.with_ctes(
        _SIDES
        + """,
        labels2 AS (SELECT is_ref, 'l_linestatus' AS feature, l_linestatus AS value FROM halves
                    UNION ALL SELECT is_ref, 'l_returnflag', l_returnflag FROM halves),
        c AS (SELECT feature, value, count(*) FILTER (is_ref) + 1 AS r,
                     count(*) FILTER (NOT is_ref) + 1 AS c FROM labels2 GROUP BY 1, 2),
        e AS (SELECT *, CAST(r AS DOUBLE) * sum(c) OVER (PARTITION BY feature)
                        / sum(r) OVER (PARTITION BY feature) AS expected FROM c)""",
        """
        SELECT feature, round(sum((c - expected) ^ 2 / expected), 6) AS statistic
        FROM e GROUP BY feature
        """,
    ),
)
def category_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chi-square statistic of two category columns."""
    values = D.value_counts(
        *_halves(spark, sf_dir), ("l_linestatus", "l_returnflag"), "string"
    )
    found = D.chi_square_test(values)
    return found.select("feature", F.round("statistic", 6).alias("statistic"))


@query(
    "K4 K5",
    T.with_ctes(
        _SIDES + "," + _PSI + "," + _KS,
        """
        SELECT v.feature, round(avg(value) FILTER (is_ref), 6) AS reference_mean,
               round(stddev_pop(value) FILTER (NOT is_ref), 6) AS current_std,
               round(max(k.statistic), 9) AS statistic, round(max(p.psi), 6) AS psi
        FROM vals v JOIN ks k ON k.feature = v.feature JOIN psi p ON p.feature = v.feature
        GROUP BY v.feature
        """,
    ),
)
def feature_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift figures of every numeric feature."""
    rows = D.feature_report(
        *_halves(spark, sf_dir), exclude=("l_linestatus", "l_returnflag")
    )
    return rows.select(
        "feature", F.round("reference_mean", 6).alias("reference_mean"),
        F.round("current_std", 6).alias("current_std"),
        F.round("statistic", 9).alias("statistic"), F.round("psi", 6).alias("psi"),
    )


@query(
    "K2 K4 K5 K6",
    T.with_ctes(
        _SIDES + "," + _PSI + "," + _KS
        + """,
        sizes AS (SELECT feature, sqrt(CAST(n_ref AS DOUBLE) * n_cur / (n_ref + n_cur)) AS root
                  FROM lows),
        tested AS (
          SELECT k.feature, CASE WHEN s.root * k.statistic < 0.2 THEN 1.0 ELSE least(1, greatest(0,
                   2 * (SELECT sum(CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END
                          * exp(-2.0 * i * i * (s.root * k.statistic) ^ 2))
                        FROM range(1, 101) AS r(i)))) END AS p
          FROM ks k JOIN sizes s ON s.feature = k.feature),
        total AS (SELECT count(*) AS n, count(*) FILTER (p < 0.05) AS drifted,
                         avg(1 - p) AS score FROM tested)""",
        """
        SELECT drifted > 0 AS has_drift, n AS total_features, drifted AS drifted_features,
               round(100.0 * drifted / n, 6) AS drift_percentage,
               round(score, 6) AS overall_drift_score,
               CASE WHEN drifted = 0 THEN 'none' WHEN 100.0 * drifted / n > 50 THEN 'critical'
                    WHEN 100.0 * drifted / n > 30 THEN 'high' WHEN 100.0 * drifted / n > 15
                    THEN 'medium' ELSE 'low' END AS severity
        FROM total
        """,
    ),
)
def data_drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row over all numeric features."""
    rows = D.feature_report(
        *_halves(spark, sf_dir), exclude=("l_linestatus", "l_returnflag")
    )
    row = D.data_report(rows)
    return row.select(
        "has_drift", F.col("total_features").cast("long").alias("total_features"),
        "drifted_features", F.round("drift_percentage", 6).alias("drift_percentage"),
        F.round("overall_drift_score", 6).alias("overall_drift_score"), "severity",
    )


@query("K3 K5 K6 K8", None)
def data_drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row over all features, with advice."""
    rows = D.feature_report(
        *_halves(spark, sf_dir), categorical=("l_linestatus", "l_returnflag")
    )
    return D.data_recommendations(D.data_report(rows)).drop("drifted")


_METRICS = f"""
per_flag AS (
  SELECT l_returnflag || l_linestatus AS metric,
         avg(l_discount) FILTER (l_shipdate < TIMESTAMP '{_CUT}') AS reference,
         avg(l_discount * 0.93) FILTER (l_shipdate >= TIMESTAMP '{_CUT}') AS current
  FROM lineitem GROUP BY 1),
changes AS (
  SELECT *, CASE WHEN reference <> 0 THEN (current - reference) / abs(reference) ELSE current END
            AS change
  FROM per_flag WHERE reference IS NOT NULL AND current IS NOT NULL)"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "lineitem").withColumn(
        "metric", F.concat("l_returnflag", "l_linestatus")
    )
    cut = F.lit(_CUT).cast("timestamp")
    old = rows.where(F.col("l_shipdate") < cut).groupBy("metric").agg(
        F.avg("l_discount").alias("value")
    )
    new = rows.where(F.col("l_shipdate") >= cut).groupBy("metric").agg(
        F.avg(F.col("l_discount") * 0.93).alias("value")
    )
    return D.model_drift(old, new)


@query(
    "K7",
    T.with_ctes(
        _METRICS,
        "SELECT metric, round(change, 6) AS change, change < -0.05 AS drifted FROM changes",
    ),
)
def model_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative change per metric."""
    return _changes(spark, sf_dir).select(
        "metric", F.round("change", 6).alias("change"), "drifted"
    )


@query(
    "K7 K8",
    T.with_ctes(
        _METRICS,
        """
        SELECT bool_or(change < -0.05) AS has_drift, round(min(change), 6) AS worst,
               CASE WHEN NOT bool_or(change < -0.05) THEN 'none' WHEN min(change) < -0.15
                 THEN 'critical' WHEN min(change) < -0.1 THEN 'high' WHEN min(change) < -0.05
                 THEN 'medium' ELSE 'low' END AS severity
        FROM changes
        """,
    ),
)
def model_drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of the worst change."""
    row = D.model_report(_changes(spark, sf_dir))
    return row.select("has_drift", F.round("worst", 6).alias("worst"), "severity")


# --- feature store --------------------------------------------------------------------------------
_GROUP = V.FeatureGroup("daily_activity", "user_id", "event_timestamp", ("n_events", "total"))


def daily_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and value per user and day, stamped at the end of the day."""
    events = T.table(spark, sf_dir, "events")
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    return events.groupBy("user_id", day.alias("day")).agg(
        F.count("*").alias("n_events"), F.sum("value").alias("total")
    ).select(
        "user_id", F.timestamp_micros(F.unix_micros("day") + S.DAY_US).alias("event_timestamp"),
        "n_events", F.round("total", 2).alias("total"),
    )


_DAILY = """
daily AS (
  SELECT user_id, date_trunc('day', ts) + INTERVAL 1 DAY AS at_time, count(*) AS n_events,
         round(sum(value), 2) AS total
  FROM events GROUP BY 1, 2)"""


@query(
    "K9",
    """
    WITH v AS (SELECT 'c_acctbal' AS feature, c_acctbal AS x FROM customer
               UNION ALL SELECT 'c_nationkey', c_nationkey FROM customer
               UNION ALL SELECT 'c_custkey', CASE WHEN c_custkey % 9 > 0 THEN c_custkey END
               FROM customer)
    SELECT feature, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std,
           round(min(x), 6) AS min_value, round(max(x), 6) AS max_value,
           round(100.0 * count(*) FILTER (x IS NULL) / count(*), 6) AS null_percentage
    FROM v GROUP BY feature
    """,
)
def feature_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation, range and share of nulls per feature."""
    key = F.when(F.col("c_custkey") % 9 > 0, F.col("c_custkey")).alias("c_custkey")
    rows = T.table(spark, sf_dir, "customer").select("c_acctbal", "c_nationkey", key)
    stats = V.statistics(rows, rows.columns)
    return stats.select(
        "feature", *[F.round(c, 6).alias(c) for c in stats.columns if c != "feature"]
    )


@query(
    "K10 K11",
    T.with_ctes(
        _DAILY,
        """
        SELECT user_id, f.n_events AS n_events, f.total AS total
        FROM (SELECT user_id, max(at_time) AS at_time,
                     arg_max(struct_pack(n_events, total), at_time) AS f
              FROM daily GROUP BY user_id)
        ORDER BY at_time DESC, user_id LIMIT 100
        """,
    ),
)
def online_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest features of the most recently active users."""
    newest = V.latest(_GROUP, daily_features(spark, sf_dir))
    return V.newest_entities(newest, _GROUP, 100).select("user_id", "n_events", "total")


@query(
    "K12",
    T.with_ctes(
        _DAILY,
        """
        SELECT user_id, CAST(epoch(at_time) AS BIGINT) AS at_time, total FROM daily
        WHERE at_time BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'
          AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
        """,
    ),
)
def offline_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored features of a list of users in a time range."""
    wanted = T.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("user_id")
    )
    rows = V.range_read(
        _GROUP, daily_features(spark, sf_dir), wanted,
        F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"), ["total"],
    )
    return rows.select(
        "user_id", F.unix_seconds("event_timestamp").alias("at_time"), "total"
    )


@query(
    "K13",
    T.with_ctes(
        _DAILY,
        """
        SELECT e.event_id, CASE WHEN e.ts - d.at_time <= INTERVAL 1 DAY THEN d.n_events END
                 AS n_events,
               CASE WHEN e.ts - d.at_time <= INTERVAL 1 DAY THEN d.total END AS total
        FROM events e ASOF LEFT JOIN daily d ON d.user_id = e.user_id AND d.at_time <= e.ts
        """,
    ),
)
def point_in_time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the last daily features known at its time, at most a day old."""
    left = T.table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("event_timestamp")
    )
    rows = V.point_in_time(_GROUP, left, daily_features(spark, sf_dir), tolerance_us=S.DAY_US)
    return rows.select("event_id", "n_events", "total")


@query(
    "K14",
    """
    SELECT 'daily_activity' AS feature_group, 2 AS features,
           (SELECT count(DISTINCT user_id) FROM events) AS entities
    UNION ALL
    SELECT 'balances', 1, (SELECT count(DISTINCT c_custkey) FROM customer)
    """,
)
def store_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature groups with their sizes."""
    balances = V.FeatureGroup("balances", "c_custkey", "at", ("c_acctbal",))
    return V.store_summary(
        {
            "daily_activity": (_GROUP, daily_features(spark, sf_dir)),
            "balances": (balances, T.table(spark, sf_dir, "customer")),
        }
    )


# --- experiments --------------------------------------------------------------------------------
_VARIANTS = (
    ("T0", "running", 0, "control", 0.5, True), ("T0", "running", 1, "new", 0.5, False),
    ("T1", "running", 0, "control", 0.7, True), ("T1", "running", 1, "b", 0.2, False),
    ("T1", "running", 2, "c", 0.1, False),
    ("T2", "stopped", 0, "control", 0.5, True), ("T2", "stopped", 1, "new", 0.5, False),
)


def variants(spark: SparkSession) -> DataFrame:
    """The plan of three tests."""
    return spark.createDataFrame(
        _VARIANTS,
        "test_id string, status string, position int, variant string, traffic double, "
        "is_control boolean",
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event asks one of the tests for its user's variant."""
    return T.table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("T"), (F.col("event_id") % 3).cast("string")).alias("test_id"),
        F.col("user_id").cast("string").alias("user_id"), "value",
    )


_ASSIGNED = """
asked AS (
  SELECT event_id, 'T' || CAST(event_id % 3 AS VARCHAR) AS test_id,
         CAST(user_id AS VARCHAR) AS user_id, value FROM events),
hashed AS (
  SELECT *, (((('0x' || substr(h, 1, 16))::UBIGINT % 100) * 16
             + ('0x' || substr(h, 17, 16))::UBIGINT % 100) % 100) / 100.0::DOUBLE AS share
  FROM (SELECT *, md5(test_id || '_' || user_id) AS h FROM asked)),
assigned AS (
  SELECT *, CASE test_id WHEN 'T0' THEN CASE WHEN share < 0.5 THEN 'control' ELSE 'new' END
                 WHEN 'T1' THEN CASE WHEN share < 0.7 THEN 'control'
                                     WHEN share < 0.7::DOUBLE + 0.2::DOUBLE THEN 'b'
                                     ELSE 'c' END
                 ELSE 'control' END AS variant
  FROM hashed)"""


@query(
    "K15",
    T.with_ctes(_ASSIGNED, "SELECT event_id, test_id, user_id, variant FROM assigned"),
)
def hash_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant of every request by user hash."""
    rows = X.assign_by_hash(requests(spark, sf_dir), variants(spark))
    return rows.select("event_id", "test_id", "user_id", "variant")


@query("K16", None)
def random_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant of every request by traffic share."""
    rows = X.assign_at_random(requests(spark, sf_dir), variants(spark), 11, "event_id")
    return rows.groupBy("test_id", "variant").agg(F.count("*").alias("requests"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request with its variant; large values are successes."""
    rows = X.assign_by_hash(requests(spark, sf_dir), variants(spark))
    return rows.select("event_id", "test_id", "variant", (F.col("value") > 60).alias("success"))


@query("K17", None)
def bandit_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant of every request by Thompson sampling over all outcomes."""
    asked = requests(spark, sf_dir).select("event_id", "test_id")
    return X.assign_by_bandit(asked, variants(spark), outcomes(spark, sf_dir), 5)


@query(
    "K18",
    T.with_ctes(
        _ASSIGNED,
        """
        SELECT test_id, variant, count(*) AS samples, count(*) FILTER (value > 60) AS successes,
               round(avg((value > 60)::INT), 9) AS success_rate
        FROM assigned GROUP BY 1, 2
        """,
    ),
)
def outcome_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples and successes per variant."""
    rows = X.outcome_totals(outcomes(spark, sf_dir))
    return rows.withColumn("success_rate", F.round("success_rate", 9))


@query(
    "K19",
    T.with_ctes(
        _ASSIGNED
        + """,
        t AS (SELECT test_id, variant, count(*) AS n, count(*) FILTER (value > 60) AS s
              FROM assigned GROUP BY 1, 2),
        arms AS (SELECT * FROM (VALUES ('T0', 'new'), ('T1', 'b'), ('T1', 'c'), ('T2', 'new'))
                 AS a(test_id, variant)),
        j AS (SELECT a.test_id, a.variant, c.n AS n1, c.s AS s1, coalesce(x.n, 0) AS n2,
                     coalesce(x.s, 0) AS s2
              FROM arms a JOIN t c ON c.test_id = a.test_id AND c.variant = 'control'
              LEFT JOIN t x ON x.test_id = a.test_id AND x.variant = a.variant),
        z AS (SELECT *, CASE WHEN n1 > 0 THEN s1 / n1 ELSE 0 END AS p1,
                     CASE WHEN n2 > 0 THEN s2 / n2 ELSE 0 END AS p2,
                     (s1 + s2) / (n1 + n2) AS pool FROM j),
        v AS (SELECT *, CASE WHEN n1 >= 100 AND n2 >= 100
                THEN (p2 - p1) / sqrt(pool * (1 - pool) * (1 / n1 + 1 / n2)) END AS z FROM z)""",
        """
        SELECT test_id, variant, n1 AS control_samples, n2 AS treatment_samples,
               round(p2 - p1, 9) AS effect_size, round(z, 6) AS z,
               CASE WHEN z > 1.959963985 THEN 'treatment_wins' WHEN z < -1.959963985
                    THEN 'control_wins' WHEN z IS NOT NULL AND abs(p2 - p1) < 0.02
                    THEN 'no_difference' ELSE 'inconclusive' END AS result
        FROM v
        """,
    ),
)
def experiment_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every variant against its control."""
    totals = X.outcome_totals(outcomes(spark, sf_dir))
    rows = X.ab_results(totals, variants(spark), min_samples=100)
    return rows.select(
        "test_id", "variant", "control_samples", "treatment_samples",
        F.round("effect_size", 9).alias("effect_size"), F.round("z", 6).alias("z"), "result",
    )


@query(
    "K20",
    T.with_ctes(
        _ASSIGNED,
        """
        SELECT CASE WHEN test_id = 'T2' THEN 'stopped' ELSE 'running' END AS status,
               count(DISTINCT test_id) AS tests, count(*) AS samples
        FROM assigned GROUP BY 1
        """,
    ),
)
def experiment_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests by status with their samples."""
    return X.ab_overview(variants(spark), X.outcome_totals(outcomes(spark, sf_dir)))


# --- stored tables --------------------------------------------------------------------------------
@query(
    "A11",
    T.with_ctes(
        _DAILY, "SELECT user_id, n_events, total FROM daily WHERE at_time < TIMESTAMP '2024-01-12'"
    ),
)
def ingested_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily features appended to the store in two parts and read back by time."""
    from finsieve.session import work_folder
    from finsieve.sources import files

    path = work_folder(spark, "store")
    rows = daily_features(spark, sf_dir)
    cut = F.col("event_timestamp") < F.lit("2024-01-08").cast("timestamp")
    for part in (rows.where(cut), rows.where(~cut)):
        files.ingest(_GROUP, part, path)
    stored = files.read_group(spark, _GROUP, path)
    end = F.lit("2024-01-11 23:59:59").cast("timestamp")
    return V.range_read(_GROUP, stored, end=end).select("user_id", "n_events", "total")


@query(
    "A12",
    T.with_ctes(
        _METRICS,
        """
        SELECT 'R2' AS report_id, 'model' AS kind, bool_or(change < -0.05) AS has_drift
        FROM changes
        """,
    ),
)
def newest_drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reports written, the newest of its kind read back."""
    from finsieve.session import work_folder
    from finsieve.sources import files

    path = work_folder(spark, "reports")
    report = D.model_report(_changes(spark, sf_dir)).drop("drifted")
    files.append_report(report, path, "model", "R1", "2024-01-01")
    files.append_report(report, path, "model", "R2", "2024-01-02")
    found = files.list_reports(spark, path, "model", 1)
    flag = F.get_json_object("body", "$.has_drift").cast("boolean")
    return found.select("report_id", "kind", flag.alias("has_drift"))
