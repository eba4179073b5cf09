"""Data drift and model drift: PSI, KS, chi-square, reports, recommendations.

All features run in one job: tables are turned into (feature, value) rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsieve.operators.prefix import running_counts
from finsieve.session import cut_lineage

_BINS = 10


def common_columns(a: DataFrame, b: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return sorted((set(a.columns) & set(b.columns)) - set(exclude))


def value_counts(
    reference: DataFrame, current: DataFrame, features: Sequence[str], kind: str = "double"
) -> DataFrame:
    """(feature, value, ref, cur): how often each value occurs in both tables.

    Missing values are dropped. All drift figures follow from these counts, so the
    tables are read once; the counts are kept for the several passes over them.
    """

    def side(df: DataFrame, is_ref: bool) -> DataFrame:
        typed = df.select(*[F.col(f).cast(kind).alias(f) for f in features])
        rows = typed.unpivot([], list(features), "feature", "value")
        keep = F.col("value").isNotNull()
        if kind == "double":
            keep &= ~F.isnan("value")
        return rows.where(keep).withColumn("is_ref", F.lit(is_ref))

    rows = side(reference, True).unionByName(side(current, False))
    counts = rows.groupBy("feature", "value").agg(
        F.count_if("is_ref").alias("ref"), F.count_if(~F.col("is_ref")).alias("cur")
    )
    return cut_lineage(counts)


def psi(counts: DataFrame) -> DataFrame:
    """(feature, psi): ten even bins over the joint range, counts smoothed by one."""
    lows = counts.groupBy("feature").agg(
        F.min("value").alias("low"), F.max("value").alias("high"),
        F.sum("ref").alias("n_ref"), F.sum("cur").alias("n_cur"),
    )
    step = (F.col("high") - F.col("low")) / _BINS
    reached = F.lit(0)
    for i in range(1, _BINS):
        reached += (F.col("value") >= F.col("low") + step * i).cast("int")
    # One row per feature.
    binned = counts.join(F.broadcast(lows), "feature").groupBy(
        "feature", reached.alias("bin")
    ).agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))
    every = lows.select(
        "feature", "n_ref", "n_cur", F.explode(F.sequence(F.lit(0), F.lit(_BINS - 1))).alias("bin")
    )
    full = every.join(binned, ["feature", "bin"], "left")
    r = (F.coalesce("ref", F.lit(0)) + 1) / (F.col("n_ref") + _BINS)
    c = (F.coalesce("cur", F.lit(0)) + 1) / (F.col("n_cur") + _BINS)
    return full.groupBy("feature").agg(F.sum((c - r) * F.log(c / r)).alias("psi"))


def ks_test(counts: DataFrame) -> DataFrame:
    """(feature, statistic, p_value): largest gap of the two distributions.

    Running shares come from the two-level prefix sums; the p-value is the asymptotic
    series.
    """
    ranked = running_counts(counts, ["feature"], "value", ["ref", "cur"])
    totals = counts.groupBy("feature").agg(
        F.sum("ref").alias("n_ref"), F.sum("cur").alias("n_cur")
    )
    # One row per feature.
    gap = F.abs(F.col("cum_ref") / F.col("n_ref") - F.col("cum_cur") / F.col("n_cur"))
    found = ranked.join(F.broadcast(totals), "feature").groupBy("feature").agg(
        F.max(gap).alias("statistic"), F.max("n_ref").alias("n"), F.max("n_cur").alias("m")
    )
    x = F.sqrt(F.col("n") * F.col("m") / (F.col("n") + F.col("m"))) * F.col("statistic")
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
        lambda a, k: a + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x),
    )
    p = F.when(x < 0.2, 1.0).otherwise(F.least(F.greatest(2 * series, F.lit(0.0)), F.lit(1.0)))
    return found.select("feature", "statistic", p.alias("p_value"))


def moments(counts: DataFrame) -> DataFrame:
    """Mean and population deviation of both sides, around the joint mean for accuracy."""
    n = F.col("ref") + F.col("cur")
    centre = counts.groupBy("feature").agg((F.sum(F.col("value") * n) / F.sum(n)).alias("m"))
    # One row per feature.
    rows = counts.join(F.broadcast(centre), "feature")
    d = F.col("value") - F.col("m")

    def side(name: str) -> list[Column]:
        n = F.col(name)
        return [F.sum(n).alias(f"n_{name}"), F.sum(d * n).alias(f"s_{name}"),
                F.sum(d * d * n).alias(f"q_{name}")]

    sums = rows.groupBy("feature").agg(F.max("m").alias("m"), *side("ref"), *side("cur"))
    sums = sums.where("n_ref > 0 and n_cur > 0")

    def mean(name: str) -> Column:
        return F.col(f"s_{name}") / F.col(f"n_{name}")

    def deviation(name: str) -> Column:
        spread = F.col(f"q_{name}") / F.col(f"n_{name}") - mean(name) * mean(name)
        return F.sqrt(F.greatest(spread, F.lit(0.0)))

    return sums.select(
        "feature", (F.col("m") + mean("ref")).alias("reference_mean"),
        deviation("ref").alias("reference_std"), (F.col("m") + mean("cur")).alias("current_mean"),
        deviation("cur").alias("current_std"),
    )


def _chi_square_tail(x: float, df: float) -> float:
    """Upper tail of the chi-square distribution (series below, fraction above)."""
    if x <= 0 or df <= 0:
        return 1.0
    a, z = df / 2.0, x / 2.0
    scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1.0 - total * scale)
    b = z + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, scale * h)


def chi_square_test(counts: DataFrame) -> DataFrame:
    """(feature, statistic, p_value) for categories, counts smoothed by one.

    Expected counts are scaled to the current total.
    """
    counts = counts.select(
        "feature", (F.col("ref") + 1).alias("r"), (F.col("cur") + 1).alias("c")
    )
    totals = counts.groupBy("feature").agg(F.sum("r").alias("n_r"), F.sum("c").alias("n_c"))
    expected = F.col("r") * F.col("n_c") / F.col("n_r")
    # One row per feature.
    found = counts.join(F.broadcast(totals), "feature").groupBy("feature").agg(
        F.sum(F.pow(F.col("c") - expected, F.lit(2.0)) / expected).alias("statistic"),
        (F.count("*") - 1).alias("df"),
    )

    @F.pandas_udf("double")
    def tail(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([_chi_square_tail(a, b) for a, b in zip(x, df)])

    return found.select("feature", "statistic", tail("statistic", "df").alias("p_value"))


def severity(p_value: Column, psi_value: Column, threshold: float = 0.05) -> Column:
    return (
        F.when((p_value > threshold) & (psi_value < 0.1), "none").when(psi_value < 0.1, "low")
        .when(psi_value < 0.2, "medium").when(psi_value < 0.3, "high").otherwise("critical")
    )


def feature_report(
    reference: DataFrame, current: DataFrame, categorical: Sequence[str] = (),
    exclude: Sequence[str] = (), threshold: float = 0.05,
) -> DataFrame:
    """One row per common feature that has values on both sides."""
    names = common_columns(reference, current, exclude)
    numeric = [n for n in names if n not in categorical]
    labels = [n for n in names if n in categorical]
    parts = []
    if numeric:
        counts = value_counts(reference, current, numeric)
        parts.append(
            moments(counts).join(ks_test(counts), "feature").join(psi(counts), "feature")
            .withColumn("test", F.lit("ks_test"))
        )
    if labels:
        counts = value_counts(reference, current, labels, "string")
        both = counts.groupBy("feature").agg(
            F.sum("ref").alias("ref"), F.sum("cur").alias("cur")
        ).where("ref > 0 and cur > 0")
        none = F.lit(None).cast("double")
        parts.append(
            chi_square_test(counts).join(both.select("feature"), "feature", "left_semi").select(
                "feature", none.alias("reference_mean"), none.alias("reference_std"),
                none.alias("current_mean"), none.alias("current_std"), "statistic", "p_value",
                F.lit(0.0).alias("psi"), F.lit("chi_square").alias("test"),
            )
        )
    report = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return report.withColumns(
        {
            "drift_detected": F.col("p_value") < threshold,
            "drift_score": 1 - F.col("p_value"),
            "severity": severity(F.col("p_value"), F.col("psi"), threshold),
            "total_features": F.lit(len(names)),
        }
    )


def data_report(features: DataFrame) -> DataFrame:
    """One row over all features; empty features count in the percentage's base."""
    row = features.agg(
        F.count_if("drift_detected").alias("drifted_features"),
        F.max("total_features").alias("total_features"),
        F.avg("drift_score").alias("mean_score"),
        # At most one entry per feature column.
        F.sort_array(
            F.collect_list(
                F.when(F.col("drift_detected"), F.struct("feature", "psi"))
            )
        ).alias("drifted"),
    )
    share = F.col("drifted_features") / F.col("total_features") * 100
    drift = F.col("drifted_features") > 0
    level = (
        F.when(~drift, "none").when(share > 50, "critical").when(share > 30, "high")
        .when(share > 15, "medium").otherwise("low")
    )
    return row.select(
        drift.alias("has_drift"), "total_features", "drifted_features",
        F.when(drift, share).otherwise(0.0).alias("drift_percentage"),
        F.when(drift, F.col("mean_score")).otherwise(0.0).alias("overall_drift_score"),
        level.alias("severity"), "drifted",
    )


def data_recommendations(report: DataFrame) -> DataFrame:
    """The report with advice texts."""
    level, share = F.col("severity"), F.col("drift_percentage")
    strong = F.filter(F.slice("drifted", 1, 5), lambda f: f["psi"] > 0.25)
    per_feature = F.transform(
        strong,
        lambda f: F.format_string(
            "Feature '%s' has high PSI (%.3f). Review data source.", f["feature"], f["psi"]
        ),
    )
    fixed = F.array_compact(
        F.array(
            F.when(level == "critical", "🚨 CRITICAL: Immediate model retraining recommended"),
            F.when(level == "critical", "Investigate data pipeline for potential issues"),
            F.when(share > 30, "Consider retraining model with recent data"),
            F.when(share > 30, "Review feature engineering pipeline"),
        )
    )
    texts = F.concat(fixed, per_feature)
    none = F.array(F.lit("No immediate action required"))
    advice = (
        F.when(~F.col("has_drift"), F.array().cast("array<string>"))
        .when(F.size(texts) == 0, none).otherwise(texts)
    )
    return report.withColumn("recommendations", advice)


def model_drift(
    reference: DataFrame, current: DataFrame, thresholds: DataFrame | None = None,
    default: float = 0.05,
) -> DataFrame:
    """Relative change of each (metric, value) present on both sides."""
    rows = reference.select("metric", F.col("value").alias("reference")).join(
        current.select("metric", F.col("value").alias("current")), "metric"
    )
    limit = F.lit(default)
    if thresholds is not None:
        rows = rows.join(thresholds.select("metric", "threshold"), "metric", "left")
        limit = F.coalesce("threshold", F.lit(default))
    old, new = F.col("reference"), F.col("current")
    change = F.when(old != 0, (new - old) / F.abs(old)).otherwise(new)
    return rows.withColumn("change", change).select(
        "metric", "reference", "current", "change", (F.col("change") < -limit).alias("drifted")
    )


def model_report(changes: DataFrame) -> DataFrame:
    """One row: severity by the worst change, with advice."""
    row = changes.agg(
        F.max("drifted").alias("has_drift"), F.min("change").alias("worst"),
        # At most one entry per metric.
        F.sort_array(
            F.collect_list(F.when(F.col("drifted"), F.struct("metric", "change")))
        ).alias("drifted"),
    )
    worst, drift = F.col("worst"), F.coalesce("has_drift", F.lit(False))
    level = (
        F.when(~drift, "none").when(worst < -0.15, "critical").when(worst < -0.10, "high")
        .when(worst < -0.05, "medium").otherwise("low")
    )
    severe, high = F.col("severity") == "critical", F.col("severity") == "high"
    texts = F.concat(
        F.array_compact(
            F.array(
                F.when(severe, "🚨 CRITICAL: Model performance severely degraded"),
                F.when(severe, "Consider immediate rollback to previous model version"),
                F.when(severe, "Investigate root cause before redeployment"),
                F.when(high, "⚠️ Model performance significantly degraded"),
                F.when(high, "Schedule model retraining"),
                F.when(high, "Review recent data changes"),
            )
        ),
        F.transform(
            "drifted",
            lambda d: F.format_string(
                "Metric '%s' decreased by %.1f%%. Review model predictions.",
                d["metric"], F.abs(d["change"]) * 100,
            ),
        ),
    )
    advice = F.when(F.col("has_drift"), texts).otherwise(F.array().cast("array<string>"))
    return (
        row.withColumn("has_drift", drift)
        .withColumn("severity", level)
        .withColumn("recommendations", advice)
    )


def should_alert(report: DataFrame) -> DataFrame:
    return report.where(F.col("severity").isin("high", "critical"))
