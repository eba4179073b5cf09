"""Feature groups: statistics, latest values, range reads, point-in-time joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsieve.functions.scalars import DAY_US
from finsieve.operators.ordering import (
    HOT_ROWS,
    NOT_CHUNKED,
    has_hot_key,
    hot_keys,
    running_before,
)


@dataclass(frozen=True)
class FeatureGroup:
    """Entity column, time column and feature columns of a stored table."""

    name: str
    entity: str
    time: str
    features: tuple[str, ...]
    ttl_days: int | None = None

    def check(self, df: DataFrame) -> None:
        missing = {self.entity, self.time, *self.features} - set(df.columns)
        if missing:
            raise ValueError(f"missing columns: {sorted(missing)}")


def statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mean, std, min, max, null_percentage) with the sample deviation."""
    typed = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    rows = typed.unpivot([], list(columns), "feature", "value")
    value = F.when(~F.isnan("value"), F.col("value"))
    return rows.groupBy("feature").agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min_value"), F.max(value).alias("max_value"),
        (F.count_if(value.isNull()) / F.count("*") * 100).alias("null_percentage"),
    )


def latest(
    group: FeatureGroup, df: DataFrame, names: Sequence[str] | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    """Newest feature row of each entity; with ``as_of`` the group's TTL is applied."""
    chosen = [f for f in group.features if names is None or f in names]
    if as_of is not None and group.ttl_days is not None:
        age = F.unix_micros(as_of) - F.unix_micros(group.time)
        df = df.where(age <= group.ttl_days * DAY_US)
    newest = F.max(F.struct(group.time, *chosen)).alias("v")
    return df.groupBy(group.entity).agg(newest).select(group.entity, "v.*")


def lookup(latest_rows: DataFrame, entity: str, wanted: DataFrame) -> DataFrame:
    """Latest rows for a list of entities; unknown ones are simply absent."""
    return latest_rows.join(wanted.select(entity).distinct(), entity, "left_semi")


def newest_entities(latest_rows: DataFrame, group: FeatureGroup, keep: int) -> DataFrame:
    """The ``keep`` most recently updated entities."""
    return latest_rows.orderBy(F.desc(group.time), group.entity).limit(keep)


def range_read(
    group: FeatureGroup, df: DataFrame, entities: DataFrame | None = None,
    start: Column | None = None, end: Column | None = None,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Stored rows by entity list and inclusive time range, chosen columns only."""
    if start is not None:
        df = df.where(F.col(group.time) >= start)
    if end is not None:
        df = df.where(F.col(group.time) <= end)
    if entities is not None:
        df = df.join(entities.select(group.entity).distinct(), group.entity, "left_semi")
    chosen = [f for f in group.features if names is None or f in names]
    return df.select(group.entity, group.time, *chosen)


def point_in_time(
    group: FeatureGroup, left: DataFrame, features: DataFrame, tolerance_us: int | None = None,
    names: Sequence[str] | None = None, hot_rows: int = HOT_ROWS, chunk_us: int = DAY_US,
) -> DataFrame:
    """Every left row with the newest feature row at or before its time.

    Both tables become one ordered sweep per entity: a left row sees the largest
    (time, values) among the feature rows before it, and at equal times feature rows
    come first. Entities with very many rows are swept in time chunks.
    """
    chosen = [f for f in group.features if names is None or f in names]
    extra = [c for c in left.columns if c not in (group.entity, group.time)]
    value = F.struct(F.unix_micros(group.time).alias("_t"), *chosen)
    known = features.select(
        F.col(group.entity).alias("_e"), F.unix_micros(group.time).alias("_at"),
        F.lit(0).alias("_kind"), value.alias("_value"),
    )
    asked = left.select(
        F.col(group.entity).alias("_e"), F.unix_micros(group.time).alias("_at"),
        F.lit(1).alias("_kind"), F.struct(group.time, *extra).alias("_left"),
    )
    rows = known.unionByName(asked, allowMissingColumns=True)
    chunk = None
    if has_hot_key(rows, ("_e",), hot_rows):
        # The list holds at most rows / hot_rows entities.
        hot = hot_keys(rows, "_e", hot_rows).withColumn("_hot", F.lit(True))
        slot = F.when(F.col("_hot"), F.floor(F.col("_at") / chunk_us)).otherwise(NOT_CHUNKED)
        rows = rows.join(F.broadcast(hot), "_e", "left")
        rows, chunk = rows.withColumn("_chunk", slot.cast("long")), "_chunk"
    seen = running_before(
        rows, ["_e"], chunk, [F.col("_at"), F.col("_kind")], {"_v": ("max", F.col("_value"))}
    ).where("_kind = 1")
    fresh = F.col("_v._t").isNotNull()
    if tolerance_us is not None:
        fresh &= F.col("_at") - F.col("_v._t") <= tolerance_us
    return seen.select(
        F.col("_e").alias(group.entity), "_left.*",
        *[F.when(fresh, F.col(f"_v.{c}")).alias(c) for c in chosen],
    )


def store_summary(groups: Mapping[str, tuple[FeatureGroup, DataFrame]]) -> DataFrame:
    """(group, features, entities) of every feature group."""
    parts = [
        df.select(group.entity).distinct().agg(F.count("*").alias("entities")).select(
            F.lit(name).alias("feature_group"),
            F.lit(len(group.features)).alias("features"), "entities",
        )
        for name, (group, df) in groups.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
