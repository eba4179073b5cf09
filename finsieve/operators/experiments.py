"""A/B tests: assignment, outcomes, significance.

``variants`` rows are ``test_id, status, position, variant, traffic, is_control`` and a
handful per test; ``requests`` rows are ``test_id, user_id``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsieve.operators.dataset import unit_hash


def hash_bucket(test_id: Column, user_id: Column) -> Column:
    """md5 of ``test_user`` modulo 100, as a share.

    The digest has 128 bits; both halves are reduced first (2^64 mod 100 is 16).
    """
    digest = F.md5(F.concat_ws("_", test_id, user_id))

    def half(start: int) -> Column:
        return F.conv(F.substring(digest, start, 16), 16, 10).cast("decimal(20,0)") % 100

    return ((half(1) * 16 + half(17)) % 100).cast("int") / 100.0


def _plans(variants: DataFrame) -> DataFrame:
    """One row per test with its variants in order (a handful) and the control."""
    return variants.groupBy("test_id").agg(
        F.sort_array(F.collect_list(F.struct("position", "variant", "traffic"))).alias("plan"),
        F.max("status").alias("status"),
        F.max(F.when(F.col("is_control"), F.col("variant"))).alias("control"),
    )


def _pick(share: Column) -> Column:
    """The first variant whose cumulative traffic is above the share, else the last."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("string").alias("hit"))

    def step(acc: Column, v: Column) -> Column:
        total = acc["sum"] + v["traffic"]
        hit = F.when(acc["hit"].isNotNull(), acc["hit"]).when(share < total, v["variant"])
        return F.struct(total.alias("sum"), hit.alias("hit"))

    found = F.aggregate("plan", start, step)["hit"]
    return F.coalesce(found, F.element_at("plan", -1)["variant"])


def _assign(requests: DataFrame, variants: DataFrame, share: Column) -> DataFrame:
    # Hashing and picking cost far more than the reading: a few large files are dealt out first.
    rows = requests.repartition(*requests.columns).join(_plans(variants), "test_id")
    chosen = F.when(F.col("status") == "running", _pick(share)).otherwise(F.col("control"))
    return rows.select(*requests.columns, chosen.alias("variant"))


def assign_by_hash(requests: DataFrame, variants: DataFrame) -> DataFrame:
    """The same user always gets the same variant; control while a test is not running."""
    return _assign(requests, variants, hash_bucket(F.col("test_id"), F.col("user_id")))


def assign_at_random(
    requests: DataFrame, variants: DataFrame, seed: int, request_col: str
) -> DataFrame:
    """By traffic share; the draw depends on the request id, so a retried task repeats it."""
    share = unit_hash(seed, F.col("test_id"), F.col(request_col))
    return _assign(requests, variants, share)


def assign_by_bandit(
    requests: DataFrame, variants: DataFrame, outcomes: DataFrame, seed: int
) -> DataFrame:
    """Thompson sampling: one Beta draw per variant from all outcomes, largest wins."""
    tally = outcomes.groupBy("test_id", "variant").agg(
        F.count_if("success").alias("wins"), F.count_if(~F.col("success")).alias("losses")
    )
    zero = F.lit(0).cast("long")
    arms = variants.join(tally, ["test_id", "variant"], "left").groupBy("test_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "position", "variant", (F.coalesce("wins", zero) + 1).alias("a"),
                    (F.coalesce("losses", zero) + 1).alias("b"),
                )
            )
        ).alias("arms")
    )
    columns = requests.columns
    ready = requests.join(arms, "test_id").select(
        *columns, F.transform("arms", lambda v: v["variant"]).alias("_names"),
        F.transform("arms", lambda v: v["a"]).alias("_a"),
        F.transform("arms", lambda v: v["b"]).alias("_b"),
        F.xxhash64(F.lit(seed), *columns).alias("_seed"),
    )

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            best = []
            for names, a, b, own in zip(pdf["_names"], pdf["_a"], pdf["_b"], pdf["_seed"]):
                rng = np.random.default_rng(own & 0xFFFFFFFFFFFFFFFF)
                best.append(names[int(np.argmax(rng.beta(a, b)))])
            yield pdf[columns].assign(variant=best)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.schema.fields)
    # The draws cost far more than the reading: a few large files must not mean a few tasks.
    return ready.repartition("_seed").mapInPandas(draw, schema + ", variant string")


def outcome_totals(outcomes: DataFrame) -> DataFrame:
    """(test_id, variant, samples, successes, success_rate)."""
    return outcomes.groupBy("test_id", "variant").agg(
        F.count("*").alias("samples"), F.count_if("success").alias("successes"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
    )


def metric_totals(metrics: DataFrame) -> DataFrame:
    """Figures per variant and metric of (test_id, variant, metric, value) rows."""
    return metrics.groupBy("test_id", "variant", "metric").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"),
        F.max("value").alias("high"),
    )


def ab_results(
    totals: DataFrame, variants: DataFrame, min_samples: int = 1000, min_effect: float = 0.02,
    confidence: float = 0.95,
) -> DataFrame:
    """Every other variant against the control: two-proportion z-test and verdict.

    The interval uses the pooled error. A variant without outcomes counts as zero.
    """
    zero = F.lit(0).cast("long")
    counted = variants.select("test_id", "variant", "is_control").join(
        totals.select("test_id", "variant", "samples", "successes"), ["test_id", "variant"], "left"
    ).withColumns(
        {"samples": F.coalesce("samples", zero), "successes": F.coalesce("successes", zero)}
    )
    control = counted.where("is_control").select(
        "test_id", F.col("samples").alias("n1"), F.col("successes").alias("s1")
    )
    rows = counted.where("not is_control").withColumnsRenamed(
        {"samples": "n2", "successes": "s2"}
    ).join(control, "test_id")

    def rate(s: str, n: str) -> Column:
        return F.when(F.col(n) > 0, F.col(s) / F.col(n)).otherwise(0.0)

    rows = rows.withColumns({"control_rate": rate("s1", "n1"), "treatment_rate": rate("s2", "n2")})
    effect = F.col("treatment_rate") - F.col("control_rate")
    pool = (F.col("s1") + F.col("s2")) / F.nullif(F.col("n1") + F.col("n2"), F.lit(0))
    error = F.sqrt(
        pool * (1 - pool)
        * (1 / F.nullif(F.col("n1"), F.lit(0)) + 1 / F.nullif(F.col("n2"), F.lit(0)))
    )
    enough = (F.col("n1") >= min_samples) & (F.col("n2") >= min_samples)
    rows = rows.withColumns(
        {
            "effect_size": effect,
            "relative_improvement": F.when(
                F.col("control_rate") > 0, effect / F.col("control_rate")
            ).otherwise(0.0),
            "_error": F.when(enough & (error > 0), error),
        }
    )

    @F.pandas_udf("double")
    def two_sided(z: pd.Series) -> pd.Series:
        return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)), na_action="ignore")

    alpha = 1 - confidence
    margin = F.col("_error") * NormalDist().inv_cdf(1 - alpha / 2)
    rows = rows.withColumn("z", F.col("effect_size") / F.col("_error"))
    rows = rows.withColumn("p_value", two_sided("z"))
    significant = F.coalesce(F.col("p_value") < alpha, F.lit(False))
    small = F.abs("effect_size") < min_effect
    tested = F.col("p_value").isNotNull()
    verdict = (
        F.when(significant & (F.col("effect_size") > 0), "treatment_wins")
        .when(significant, "control_wins").when(tested & small, "no_difference")
        .otherwise("inconclusive")
    )
    missing = F.greatest(F.lit(min_samples) - F.least("n1", "n2"), zero)
    return rows.select(
        "test_id", "variant", F.col("n1").alias("control_samples"),
        F.col("n2").alias("treatment_samples"), "control_rate", "treatment_rate",
        "effect_size", "relative_improvement", "z", "p_value",
        (F.col("effect_size") - margin).alias("ci_low"),
        (F.col("effect_size") + margin).alias("ci_high"), significant.alias("is_significant"),
        verdict.alias("result"), (verdict != "inconclusive").alias("can_conclude"),
        F.when(enough, zero).otherwise(missing).alias("samples_needed"),
    )


def ab_overview(variants: DataFrame, totals: DataFrame) -> DataFrame:
    """(status, tests, samples): tests by status and the samples they hold."""
    tests = variants.groupBy("test_id").agg(F.max("status").alias("status"))
    samples = totals.groupBy("test_id").agg(F.sum("samples").alias("samples"))
    return tests.join(samples, "test_id", "left").groupBy("status").agg(
        F.count("*").alias("tests"),
        F.coalesce(F.sum("samples"), F.lit(0).cast("long")).alias("samples"),
    )
