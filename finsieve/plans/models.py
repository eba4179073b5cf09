"""Queries that train on, score and explain the feature matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsieve import vocab
from finsieve.operators import dataset as B
from finsieve.operators import detectors as D
from finsieve.operators import training as M
from finsieve.operators.history import build_features, cold_start
from finsieve.operators.ordering import mark_first
from finsieve.plans import monitoring
from finsieve.plans import tables as T
from finsieve.plans.monitoring import _SPLIT
from finsieve.plans.registry import query
from finsieve.plans.transactions import _HISTORY_SQL, _sql_codes
from finsieve.session import cut_lineage, work_folder
from finsieve.sources.files import cache_features


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of all transactions; the label marks bursts of a sender."""
    rows = build_features(T.canonical(spark, sf_dir))
    burst = (F.col("sender_tx_count_24h") >= 3) & (F.col("log_amount") > 3)
    M.check_features(rows.columns[2:])
    return rows.withColumn("label", burst.cast("int"))


@query("J8 J9 J13 J14", None)
def baseline_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic scores with base value and strongest contributions."""
    rows = cut_lineage(matrix(spark, sf_dir))
    found = M.explain_linear(rows, M.train_baseline(rows, max_iter=50))
    top = F.col("top_features")[0]["feature"]
    return found.select(
        "seq", "label", F.round("score", 6).alias("score"),
        F.round("base_value", 6).alias("base_value"), top.alias("top_feature"),
    )


# Parameters of a stored model, as a training run would have written them.
_COEFFICIENTS = {
    "log_amount": 0.9, "hour": -0.02, "currency_mismatch": 0.7, "cross_border": 0.4,
    "sender_tx_count_24h": 1.1, "sender_unique_receivers_7d": 0.05,
    "receiver_tx_count_24h": -0.08, "pair_tx_count_7d": 0.6,
}
_KIND_COEFFICIENTS = [0.0, 0.3, -0.2, 0.1, 0.0, 0.25, -0.5, 0.15]


def stored_model() -> M.LinearModel:
    """A linear model read from parameters instead of trained."""
    zeros = {f: 0.0 for f in M.NUMERIC}
    ones = {f: 1.0 for f in M.NUMERIC}
    none = [0.0] * len(vocab.COUNTRIES)
    return M.LinearModel(
        -5.0, zeros, ones, {**zeros, **_COEFFICIENTS},
        {
            "payment_type_code": _KIND_COEFFICIENTS, "sender_country_code": none,
            "receiver_country_code": none,
        },
    )


_KIND = "[" + ", ".join(f"{c}e0" for c in _KIND_COEFFICIENTS) + "]"
_PARTS = {
    **{f: f"{f} * {c}e0" for f, c in _COEFFICIENTS.items()},
    "payment_type_code": f"{_KIND}[payment_type_code + 1]",
}
_SCORED = (
    T.CANONICAL
    + ", history AS (" + _HISTORY_SQL.format(probes="tx", history="rec") + "),"
    + f"""
rows AS (
  SELECT h.*, CAST(CAST(ln(1 + t.amount) AS FLOAT) AS DOUBLE) AS log_amount, hour(t.ts) AS hour,
         CAST(t.pay <> t.rec AS INTEGER) AS currency_mismatch,
         CAST(t.s_country <> t.r_country AS INTEGER) AS cross_border,
         {_sql_codes("t.payment_type", vocab.PAYMENT_TYPES)} AS payment_type_code,
         row_number() OVER (PARTITION BY t.transaction_id ORDER BY t.ts, t.seq) = 1 AS is_first
  FROM history h JOIN tx t ON t.seq = h.seq),
parts AS (
  SELECT seq, transaction_id, is_first, unnest([
    {", ".join(f"struct_pack(feature := '{f}', c := CAST({x} AS DOUBLE))" for f, x in _PARTS.items())}
  ]) AS p FROM rows),
ranked AS (
  SELECT seq, transaction_id, is_first, p.feature AS feature, p.c AS c,
         row_number() OVER (PARTITION BY seq ORDER BY round(abs(p.c), 9) DESC, p.feature) AS rn
  FROM parts),
scored AS (
  SELECT seq, transaction_id, bool_and(is_first) AS is_first,
         1 / (1 + exp(-(sum(c) - 5.0))) AS score,
         max(feature) FILTER (rn = 1) AS top_feature
  FROM ranked GROUP BY seq, transaction_id)"""
)


@query(
    "J9 J12 J14",
    T.with_ctes(
        _SCORED,
        """
        SELECT seq, transaction_id, round(score, 6) AS score, score >= 0.6 AS is_fraud,
               top_feature FROM scored
        """,
    ),
)
def stored_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and strongest contribution from stored parameters."""
    rows = build_features(T.canonical(spark, sf_dir))
    found = M.explain_linear(rows, stored_model())
    return found.select(
        "seq", "transaction_id", F.round("score", 6).alias("score"),
        (F.col("score") >= 0.6).alias("is_fraud"),
        F.col("top_features")[0]["feature"].alias("top_feature"),
    )


@query(
    "F5 F8 I6 I7",
    T.with_ctes(
        _SCORED,
        """
        SELECT 'ALERT-' || upper(substr(sha256(transaction_id || chr(31) || 'ml_model'), 1, 12))
                 AS alert_id, transaction_id,
               CASE WHEN score >= 0.85 THEN 'critical' ELSE 'high' END AS severity,
               round(score, 6) AS confidence
        FROM scored WHERE score >= 0.6 AND is_first
        """,
    ),
)
def model_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of transactions at or above the threshold; repeated ids raise none."""
    canonical = T.canonical(spark, sf_dir)
    features = cut_lineage(build_features(canonical))
    scored = M.explain_linear(features, stored_model())
    first = mark_first(canonical, "transaction_id", ("timestamp", "seq")).select(
        "seq", "is_first"
    )
    scored = scored.join(first, "seq").join(
        cold_start(canonical).select("seq", "cold_start"), "seq"
    )
    found = D.model_alerts(T.received(spark, sf_dir), scored, 0.6, "lr-1")
    return D.to_alerts(found).select(
        "alert_id", "transaction_id", "severity", F.round("confidence", 6).alias("confidence")
    )


@query(
    "A2 A10 D9",
    T.with_ctes(
        _SPLIT + ","
        + "history AS (" + _HISTORY_SQL.format(probes="tx", history="rec") + ")",
        """
        SELECT h.transaction_id, h.sender_tx_count_24h, h.pair_tx_count_7d,
               CAST(s.positive AS BIGINT) AS is_laundering
        FROM split s JOIN history h ON h.seq = s.seq
        JOIN rec r ON r.seq = s.seq WHERE s.split = 'test'
        """,
    ),
)
def cached_test_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of all splits cached once; only the test folder is read back."""
    from finsieve.sources.files import read_dataset

    out = work_folder(spark, "cache")
    rows = monitoring.labelled(spark, sf_dir)
    rows = B.assign_split(rows, B.split_boundaries(rows))
    rows = mark_first(rows, "transaction_id", ("timestamp", "seq")).where("is_first")
    for _ in range(2):
        cache_features(rows, out, "all")
    found = read_dataset(spark, f"{out}/dataset_id=all", ("test",))
    return found.select(
        "transaction_id",
        *[F.col(c).cast("long").alias(c)
          for c in ("sender_tx_count_24h", "pair_tx_count_7d", "is_laundering")],
    )


@query("J10 J11", None)
def tree_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best candidate of a small boosted-tree grid by validation PR-AUC."""
    rows = cut_lineage(matrix(spark, sf_dir).withColumn("_u", B.unit_hash(3, F.col("seq"))))
    grid = (M.GridPoint(3, 0.1, 1.0), M.GridPoint(3, 0.1, 4.0))
    results, _ = M.grid_results(
        rows.where("_u < 0.7"), rows.where("_u >= 0.7"), grid, max_trees=5, every=1
    )
    return M.best_candidate(results).withColumn("pr_auc", F.round("pr_auc", 6))


@query("J14", None)
def tree_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted-tree scores with the strongest contributions in log-odds."""
    rows = cut_lineage(matrix(spark, sf_dir))
    trees = M.extract_trees(M.fit_trees(rows, M.GridPoint(3, 0.1, 1.0), max_trees=5))
    found = M.explain_trees(rows, trees, "seq")
    return found.select(
        "seq", F.round("score", 6).alias("score"), F.size("top_features").alias("n"),
        F.col("top_features")[0]["feature"].alias("top_feature"),
    )


@query("A2 A10 J23", None)
def locked_test_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selection on train and val, then one pass over the locked test split."""
    out = work_folder(spark, "stages")
    rows = monitoring.labelled(spark, sf_dir)
    rows = B.assign_split(rows, B.split_boundaries(rows))
    rows = mark_first(rows, "transaction_id", ("timestamp", "seq")).where("is_first")
    features = cache_features(rows, f"{out}/features", "test")
    path = f"{out}/features/dataset_id=test"
    assert set(vocab.FEATURE_NAMES) <= set(features.columns)
    M.select_model(spark, path, f"{out}/model")
    return M.locked_test(spark, path, f"{out}/model")
