"""Exact running totals and percentiles over values of unknown distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsieve.operators.ordering import grouped_prefix
from finsieve.session import cut_lineage


def running_counts(
    counts: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str]
) -> DataFrame:
    """Inclusive ``cum_<name>`` in value order for one-row-per-value counts.

    Spark's range partitioning cuts the values into even runs whatever their
    distribution; the run a value fell into is written down once, since a second
    sampling could cut elsewhere.
    """
    keys = list(keys)
    runs = counts.repartitionByRange(*keys, value).withColumn("_run", F.spark_partition_id())
    runs = cut_lineage(runs)
    return grouped_prefix(runs, keys, "_run", F.col(value), F.col("_run"), sums).drop("_run")


def exact_percentiles(
    df: DataFrame, value: str, shares: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """One row with exact percentiles (linear between neighbours), n and max."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    counts = cut_lineage(counts)
    total = counts.agg(F.sum("n").alias("_total"), F.max(value).alias("_max"))
    ranked = running_counts(counts, [], value, ["n"]).crossJoin(total)

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("cum_n") > rank, F.col(value)))

    out = []
    for share, name in zip(shares, names):
        rank = (F.col("_total") - 1) * F.lit(float(share))
        out += [
            at(F.floor(rank)).alias(f"_lo_{name}"), at(F.ceil(rank)).alias(f"_hi_{name}"),
            F.max(rank - F.floor(rank)).alias(f"_part_{name}"),
        ]
    row = ranked.agg(F.max("_total").alias("n"), F.max("_max").alias("max"), *out)
    return row.select(
        "n",
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_part_{n}"))
            .alias(n)
            for n in names
        ],
        "max",
    )
