"""Ranking quality, threshold choice and target checks from scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsieve import vocab
from finsieve.operators.prefix import exact_percentiles, running_counts


def score_table(
    scored: DataFrame, label: str = "label", score: str = "score", keys: Sequence[str] = ()
) -> DataFrame:
    """One row per key and distinct score, best first, with running counts.

    ``pos, neg`` at the score, ``cum_pos, cum_neg`` at or above it, and the totals.
    Equal scores collapse in a partial aggregate; the distinct ones are cut into even
    runs, wherever scores crowd, and summed in two levels.
    """
    keys = list(keys)
    counts = scored.groupBy(*keys, F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    falling = counts.withColumn("_falling", -F.col("score"))
    ranked = running_counts(falling, keys, "_falling", ["pos", "neg"]).drop("_falling")
    totals = counts.groupBy(*keys).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    # One row per key, a single row without keys.
    joined = ranked.join(totals, keys) if keys else ranked.crossJoin(F.broadcast(totals))
    return joined


def ranking_metrics(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Average precision and area under the ROC curve (ties count half), per key."""
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    above = F.col("cum_pos") - F.col("pos") + F.col("pos") / 2.0
    return table.groupBy(*keys).agg(
        F.sum(F.col("pos") / F.col("all_pos") * precision).alias("pr_auc"),
        (
            F.sum(F.col("neg") * above) / F.max(F.col("all_pos").cast("double") * F.col("all_neg"))
        ).alias("roc_auc"),
        F.max("all_pos").alias("support_positive"),
        F.max(F.col("all_pos") + F.col("all_neg")).alias("support_total"),
    )


def choose_threshold(table: DataFrame, floor: float = vocab.MIN_PRECISION) -> DataFrame:
    """One row: the threshold with the highest recall whose precision reaches the floor.

    Ties go to the higher precision, then the higher threshold; all null when none fits.
    """
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    recall = F.col("cum_pos") / F.col("all_pos")
    inside = (F.col("score") > 0) & (F.col("score") < 1)
    ok = table.withColumns({"precision": precision, "recall": recall}).where(
        inside & (F.col("precision") >= floor)
    )
    best = F.max(F.struct("recall", "precision", F.col("score").alias("threshold"))).alias("b")
    return ok.agg(best).select("b.threshold", "b.precision", "b.recall")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def at_threshold(
    scored: DataFrame, threshold: Column, label: str = "label", score: str = "score"
) -> DataFrame:
    """One row: confusion counts, precision, recall, F1 and number of alerts."""
    hit, real = F.col(score) >= threshold, F.col(label) == 1
    row = scored.agg(
        F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"),
        F.count_if(~hit & real).alias("fn"), F.count_if(~hit & ~real).alias("tn"),
    )
    tp = F.col("tp")
    row = row.withColumns(
        {
            "precision": _ratio(tp, tp + F.col("fp")), "recall": _ratio(tp, tp + F.col("fn")),
            "alerts": tp + F.col("fp"),
        }
    )
    both = F.col("precision") + F.col("recall")
    return row.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), both))


def typology_recall(
    scored: DataFrame, threshold: Column, typology: str = "typology", label: str = "label",
    score: str = "score",
) -> DataFrame:
    """Recall and support of the positives by type."""
    return (
        scored.where(F.col(label) == 1)
        .groupBy(F.col(typology).alias("typology"))
        .agg(
            F.count("*").alias("support"),
            F.count_if(F.col(score) >= threshold).alias("detected"),
        )
        .withColumn("recall", F.col("detected") / F.col("support"))
    )


def latency_summary(samples: DataFrame, ns_col: str) -> DataFrame:
    """One row of exact latency percentiles in milliseconds."""
    ms = samples.select((F.col(ns_col) / 1e6).alias("ms"))
    return exact_percentiles(
        ms, "ms", (0.5, 0.95, 0.99), ("p50_ms", "p95_ms", "p99_ms")
    ).withColumnRenamed("max", "max_ms")


def evaluate(
    scored: DataFrame, threshold: float, label: str = "label", score: str = "score",
    typology: str | None = None,
) -> DataFrame:
    """All figures of a scored split as (metric, value) rows."""
    at = F.lit(threshold)
    ranks = ranking_metrics(score_table(scored, label, score))
    point = at_threshold(scored, at, label, score)
    wide = ranks.crossJoin(point)  # one row each
    values = wide.select(*[F.col(c).cast("double").alias(c) for c in wide.columns])
    rows = values.unpivot([], values.columns, "metric", "value")
    if typology is not None:
        types = typology_recall(scored, at, typology, label, score)
        enough = types.where(F.col("support") >= vocab.TYPOLOGY_MIN_SUPPORT)
        rows = rows.unionByName(
            types.select(
                F.concat(F.lit("recall:"), "typology").alias("metric"),
                F.col("recall").alias("value"),
            )
        ).unionByName(
            enough.agg(F.min("recall").alias("value")).select(
                F.lit("min_typology_recall").alias("metric"), "value"
            )
        )
    return rows


def check_targets(metrics: DataFrame) -> DataFrame:
    """(metric, value, goal, passed) for every target; a missing value fails."""
    spark = metrics.sparkSession
    targets = spark.createDataFrame(
        [(name, way, float(goal)) for name, way, goal in vocab.MODEL_TARGETS],
        "metric string, way string, goal double",
    )
    ok = F.when(F.col("way") == ">=", F.col("value") >= F.col("goal")).otherwise(
        F.col("value") <= F.col("goal")
    )
    # No typology with enough support means none can fail.
    vacuous = (F.col("metric") == "min_typology_recall") & F.col("value").isNull()
    return targets.join(metrics.select("metric", "value"), "metric", "left").select(
        "metric", "value", F.concat_ws(" ", "way", "goal").alias("goal"),
        (F.coalesce(ok, F.lit(False)) | vacuous).alias("passed"),
    )


def relative_gain(value: float, base: float) -> float:
    return (value - base) / base if base > 0 else float("inf")


def best_candidate(results: DataFrame) -> DataFrame:
    """The candidate with the best validation PR-AUC; the first one on ties."""
    return results.orderBy(F.desc("pr_auc"), "candidate").limit(1)
