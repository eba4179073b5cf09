"""Event order, duplicates, and running aggregates that survive hot keys.

A window function keeps every row of its partition in one task. An account that
holds a third of all rows would therefore stall a job, so the running aggregates
here cut a hot key into time chunks: each chunk is its own window partition, and
what earlier chunks contribute arrives as one pre-aggregated row per chunk.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one key that one task may order. A key above it is cut into chunks, and
# the list of such keys can never be longer than (all rows / HOT_ROWS).
HOT_ROWS = 2_000_000
NOT_CHUNKED = -1


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows (partial counts are made before the shuffle)."""
    return df.groupBy(key).count().where(F.col("count") > hot_rows).select(key)


def has_hot_key(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> bool:
    """Whether any key of any of the columns is hot. One counting job, one row read."""
    named = F.explode(
        F.array(*[F.struct(F.lit(i).alias("i"), F.col(k).alias("k")) for i, k in enumerate(keys)])
    )
    counts = df.select(named.alias("key")).groupBy("key").count()
    return not counts.where(F.col("count") > hot_rows).limit(1).isEmpty()


def _merge(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.when(carried.isNull(), local).when(local.isNull(), carried).otherwise(
            carried + local
        )
    return F.greatest(carried, local) if kind == "max" else F.least(carried, local)


_AGGS = {"sum": F.sum, "max": F.max, "min": F.min}


def running_before(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str | None,
    order: Sequence[Column],
    aggs: Mapping[str, tuple[str, Column]],
) -> DataFrame:
    """For every row, aggregates over the rows of its key strictly before it in order.

    ``aggs`` maps a result name to (``sum`` | ``max`` | ``min``, column); null when
    there are no earlier rows. ``chunk`` names the chunk column of hot keys, or is
    None when :func:`has_hot_key` found none.
    """
    keys = list(keys)
    if chunk is None:
        plain = Window.partitionBy(*keys).orderBy(*order)
        plain = plain.rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({n: _AGGS[kind](col).over(plain) for n, (kind, col) in aggs.items()})
    before = Window.partitionBy(*keys, chunk).orderBy(*order)
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumns(
        {f"_l_{name}": _AGGS[kind](col).over(before) for name, (kind, col) in aggs.items()}
    )
    totals = (
        df.where(F.col(chunk) != NOT_CHUNKED)
        .groupBy(*keys, chunk)
        .agg(*[_AGGS[kind](col).alias(name) for name, (kind, col) in aggs.items()])
    )
    chunks = Window.partitionBy(*keys).orderBy(chunk)
    chunks = chunks.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        chunk,
        *[_AGGS[kind](name).over(chunks).alias(f"_c_{name}") for name, (kind, _) in aggs.items()],
    )
    joined = local.join(carried, [*keys, chunk], "left")
    merged = {
        name: _merge(kind, F.col(f"_c_{name}"), F.col(f"_l_{name}"))
        for name, (kind, _) in aggs.items()
    }
    return joined.withColumns(merged).drop(
        *[f"_{side}_{name}" for side in "lc" for name in aggs]
    )


# --- duplicates ------------------------------------------------------------------------------
def mark_first(df: DataFrame, id_col: str, order: Sequence[str], flag: str = "is_first"):
    """Flag the first row of every id in ``order``; later copies are false.

    Copies of one id are reduced by a partial ``min`` before any shuffle, and only
    ids with more than one row take part in the join, so a huge group of copies
    never meets in one task.
    """
    position = F.struct(*order)
    repeated = (
        df.groupBy(id_col)
        .agg(F.count("*").alias("_n"), F.min(position).alias("_first"))
        .where("_n > 1")
        .select(id_col, "_first")
    )
    return (
        df.join(repeated, id_col, "left")
        .withColumn(flag, F.col("_first").isNull() | (F.col("_first") == position))
        .drop("_first")
    )


def repeated_ids(df: DataFrame, id_col: str) -> DataFrame:
    return df.groupBy(id_col).agg(F.count("*").alias("copies")).where("copies > 1")


def ordered_unique(ids: Column) -> Column:
    return F.array_distinct(ids)


# --- paging and top-k ----------------------------------------------------------------------------
def newest_page(
    df: DataFrame, time_col: str, tie: str, page: int, size: int
) -> tuple[DataFrame, DataFrame]:
    """One page, newest first, and a one-row total."""
    rows = df.orderBy(F.desc(time_col), F.desc(tie)).offset((page - 1) * size).limit(size)
    return rows, df.agg(F.count("*").alias("total"))


def top_structs(items: Column, score: str, k: int) -> Column:
    """The k structs of an array with the largest score; earlier items win ties."""
    def order(a: Column, b: Column) -> Column:
        return F.when(a[score] > b[score], -1).when(a[score] < b[score], 1).otherwise(0)

    return F.slice(F.array_sort(items, order), 1, k)


# --- prefix sums over grouped values ----------------------------------------------------------------
def grouped_prefix(
    grouped: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Column,
    bucket_order: Column,
    sums: Sequence[str],
) -> DataFrame:
    """Inclusive running sums over one-row-per-value data in two levels.

    Rows are ordered inside a bucket; whole buckets contribute one row each. Adds
    ``cum_<name>`` (inclusive) for every name in ``sums``.
    """
    keys = list(keys)
    per_bucket = grouped.groupBy(*keys, bucket).agg(*[F.sum(c).alias(c) for c in sums])
    earlier = Window.partitionBy(*keys).orderBy(bucket_order)
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys, bucket,
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums],
    )
    inside = Window.partitionBy(*keys, bucket).orderBy(order)
    inside = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (
        grouped.withColumns({f"_i_{c}": F.sum(c).over(inside) for c in sums})
        .join(offsets, [*keys, bucket])
        .withColumns({f"cum_{c}": F.col(f"_i_{c}") + F.col(f"_o_{c}") for c in sums})
        .drop(*[f"_{p}_{c}" for p in "io" for c in sums])
    )
