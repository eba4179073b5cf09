"""File sources and sinks: raw labelled CSV, canonical tables, caches, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsieve import schemas, vocab
from finsieve.operators.canonical import InputError
from finsieve.operators.feature_store import FeatureGroup


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, on any file system Spark knows."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(target)


# --- raw labelled source ------------------------------------------------------------------------------
def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw labelled rows with ids as text; a broken row or missing column fails.

    Adds ``_block`` (file and offset) and ``_row``, from which
    :func:`finsieve.operators.canonical.with_source_row` numbers the rows.
    """
    head = spark.read.option("header", True).csv(path).columns
    missing = [c for c in vocab.RAW_COLUMNS if c not in head]
    if missing:
        raise InputError(f"missing columns: {missing}")
    types = {f.name: f for f in spark.createDataFrame([], schemas.RAW_LABELLED).schema.fields}
    declared = ", ".join(
        f"`{c}` {types[c].dataType.simpleString() if c in types else 'string'}" for c in head
    )
    rows = spark.read.schema(declared).csv(path, header=True, mode="FAILFAST")
    place = F.struct("_metadata.file_path", "_metadata.file_block_start")
    return rows.select(
        *vocab.RAW_COLUMNS, place.alias("_block"), F.monotonically_increasing_id().alias("_row")
    )


# --- canonical tables --------------------------------------------------------------------------------
def write_dataset(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Labelled dataset as Parquet, one folder per split, sorted by time inside files."""
    columns = [*schemas.DATASET_COLUMNS, "split"]
    rows = df.select(*columns).repartitionByRange("split", "timestamp")
    rows.sortWithinPartitions("split", "timestamp", "transaction_id").write.mode(
        mode
    ).partitionBy("split").parquet(path)


def read_dataset(
    spark: SparkSession, path: str, splits: Sequence[str] | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Only the folders of ``splits`` and only ``columns`` are read."""
    df = spark.read.parquet(path)
    if splits is not None:
        unknown = set(splits) - set(vocab.SPLITS)
        if unknown:
            raise InputError(f"unknown splits: {sorted(unknown)}")
        df = df.where(F.col("split").isin(*splits))
    return df if columns is None else df.select(*columns)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines with a declared schema (canonical transactions by default)."""
    return spark.read.schema(schema or schemas.CANONICAL_TRANSACTION).json(path)


# --- feature cache and feature store -------------------------------------------------------------------------
def cache_features(df: DataFrame, path: str, dataset_id: str) -> DataFrame:
    """Features of all splits with labels, written once per dataset id.

    History crosses split borders, so features are built over all rows together.
    """
    from finsieve.operators.history import build_features

    spark = df.sparkSession
    target = f"{path.rstrip('/')}/dataset_id={dataset_id}"
    if not path_exists(spark, f"{target}/_SUCCESS"):
        keep = ("is_laundering", "laundering_type", "split")
        features = build_features(df, unique_ids=True, keep=keep)
        features.write.mode("overwrite").partitionBy("split").parquet(target)
    return spark.read.parquet(target)


def ingest(group: FeatureGroup, df: DataFrame, path: str) -> None:
    """Append rows of a feature group after checking its columns."""
    group.check(df)
    rows = df.select(group.entity, group.time, *group.features)
    day = F.to_date(group.time).alias("day")
    rows.select("*", day).write.mode("append").partitionBy("day").parquet(
        f"{path.rstrip('/')}/{group.name}"
    )


def read_group(spark: SparkSession, group: FeatureGroup, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/{group.name}")


# --- reports --------------------------------------------------------------------------------
def append_report(report: DataFrame, path: str, kind: str, report_id: str, at: str) -> None:
    """Keep a one-row report as JSON text with its kind and time."""
    body = F.to_json(F.struct(*report.columns)).alias("body")
    report.select(
        F.lit(report_id).alias("report_id"), F.lit(at).cast("timestamp").alias("created_at"),
        body, F.lit(kind).alias("kind"),
    ).write.mode("append").partitionBy("kind").parquet(path)


def list_reports(
    spark: SparkSession, path: str, kind: str | None = None, limit: int = 20
) -> DataFrame:
    """Newest reports first, of one kind or all."""
    reports = spark.read.parquet(path)
    if kind is not None:
        reports = reports.where(F.col("kind") == kind)
    return reports.orderBy(F.desc("created_at"), F.desc("report_id")).limit(limit)
