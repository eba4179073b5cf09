"""Alert table: each (transaction, type) is stored once, however often it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsieve.operators.alerts import ALERT_KEYS, first_per_key
from finsieve.sources.files import path_exists


def stored_twins(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored alerts with the key of a batch alert.

    The batch is the small side, so its keys are sent to the stored table rather than
    the table being shuffled.
    """
    return stored.join(batch.select(*ALERT_KEYS).distinct(), list(ALERT_KEYS), "left_semi")


def write_alerts(batch: DataFrame, path: str) -> None:
    """Append the alerts whose key is not stored yet. Repeating a batch adds nothing."""
    spark = batch.sparkSession
    new = first_per_key(batch)
    if path_exists(spark, path):
        known = stored_twins(new, spark.read.parquet(path)).select(*ALERT_KEYS)
        new = new.join(known, list(ALERT_KEYS), "left_anti")
    day = F.to_date("detected_at").alias("day")
    new.select("*", day).write.mode("append").partitionBy("day").parquet(path)


def resolve_alerts(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """What a writer gets back: the stored alert where one exists, else its own."""
    new = first_per_key(batch)
    known = stored_twins(new, stored).select(*batch.columns)
    fresh = new.join(known.select(*ALERT_KEYS), list(ALERT_KEYS), "left_anti")
    return known.unionByName(fresh.select(*batch.columns))
