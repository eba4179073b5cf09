"""Message streams: transactions and alerts in, alerts out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsieve import schemas


def read_messages(
    spark: SparkSession, source: str, options: Mapping[str, str], path: str | None = None
) -> DataFrame:
    """Streaming rows with ``key`` and ``value`` text.

    ``source`` is ``kafka`` (options passed through, starting at the latest offset
    unless told otherwise) or ``text`` for folders of JSON lines.
    """
    reader = spark.readStream.format(source)
    if source == "kafka":
        reader = reader.option("startingOffsets", "latest")
    rows = reader.options(**options).load(path) if path else reader.options(**options).load()
    key = F.col("key").cast("string") if "key" in rows.columns else F.lit(None).cast("string")
    return rows.select(key.alias("key"), F.col("value").cast("string").alias("value"))


def parse_messages(messages: DataFrame, schema: str = schemas.TRANSACTION_MESSAGE) -> DataFrame:
    """Add ``parsed`` (null for bad JSON); key and text are kept for the reject side."""
    mark = schema.rstrip() + ", _corrupt STRING"
    parsed = F.from_json(
        "value", mark, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )
    bad = F.col("parsed._corrupt").isNotNull() | F.col("parsed").isNull()
    rows = messages.withColumn("parsed", parsed)
    return rows.withColumn("parsed", F.when(~bad, F.col("parsed")))


def good_messages(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("parsed").isNotNull()).select("parsed.*").drop("_corrupt")


def bad_messages(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("parsed").isNull()).select("key", "value")


def read_alert_messages(
    spark: SparkSession, source: str, options: Mapping[str, str], path: str | None = None
) -> DataFrame:
    """The alert stream as alert rows."""
    return good_messages(parse_messages(read_messages(spark, source, options, path), schemas.ALERT))
