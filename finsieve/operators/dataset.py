"""Chronological splits, dataset manifest, fingerprint and sampling."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsieve import vocab
from finsieve.operators.canonical import InputError
from finsieve.operators.prefix import running_counts

CATEGORY_COLUMNS = (
    "payment_currency", "received_currency", "sender_country", "receiver_country",
    "payment_type",
)


# --- splits --------------------------------------------------------------------------------
def split_boundaries(
    df: DataFrame, train: float = vocab.TRAIN_FRACTION, val: float = vocab.VAL_FRACTION,
    time_col: str = "timestamp",
) -> DataFrame:
    """One row: ``train_start, val_start, test_start`` and ``rows``.

    A cut that falls inside a group of equal times moves behind the group. Rows are
    counted per time, and the times summed in even runs and over runs.
    """
    if not (0 < train < 1 and 0 < val < 1 and train + val < 1):
        raise ValueError("fractions must be in (0, 1) and leave rows for the test split")
    counts = df.groupBy(F.col(time_col).alias("ts")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("rows"))
    ranked = running_counts(counts, [], "ts", ["n"]).crossJoin(total)
    before = F.col("cum_n") - F.col("n")

    def start(fraction: float) -> Column:
        cut = F.least(F.floor(F.col("rows") * F.lit(fraction)), F.col("rows") - 1)
        return F.min(F.when(before >= cut, F.col("ts")))

    return ranked.agg(
        F.min("ts").alias("train_start"), start(train).alias("val_start"),
        start(train + val).alias("test_start"), F.max("rows").alias("rows"),
    )


def read_boundaries(boundaries: DataFrame) -> tuple[datetime, datetime, datetime]:
    """The boundary row on the driver; fails when a split would be empty."""
    row = boundaries.first()
    starts = (row["train_start"], row["val_start"], row["test_start"])
    if None in starts or not starts[0] < starts[1] < starts[2]:
        raise InputError("cannot split without breaking a group of equal times")
    return starts


def assign_split(df: DataFrame, boundaries: DataFrame, time_col: str = "timestamp") -> DataFrame:
    """Add ``split`` from the one boundary row."""
    t = F.col(time_col)
    split = F.when(t >= F.col("test_start"), "test").when(t >= F.col("val_start"), "val")
    marks = boundaries.select("val_start", "test_start")
    return (
        df.crossJoin(F.broadcast(marks))
        .withColumn("split", split.otherwise("train"))
        .drop("val_start", "test_start")
    )


def split_ranges(df: DataFrame, time_col: str = "timestamp") -> DataFrame:
    return df.groupBy("split").agg(
        F.count("*").alias("rows"), F.min(time_col).alias("first"), F.max(time_col).alias("last")
    )


def check_splits(df: DataFrame, time_col: str = "timestamp") -> None:
    """Raise unless all three splits hold rows and follow each other in time."""
    found = {r["split"]: r for r in split_ranges(df, time_col).collect()}
    missing = [s for s in vocab.SPLITS if s not in found]
    if missing:
        raise InputError(f"empty splits: {missing}")
    for earlier, later in zip(vocab.SPLITS, vocab.SPLITS[1:]):
        if not found[earlier]["last"] < found[later]["first"]:
            raise InputError(f"{earlier} does not end before {later}")


# --- manifest --------------------------------------------------------------------------------
def manifest_totals(df: DataFrame) -> DataFrame:
    """One row: rows, positives, rate, time span, accounts, unknown categories."""
    positive = F.col("is_laundering") == 1
    totals = df.agg(
        F.count("*").alias("rows"),
        F.count_if(positive).alias("positives"),
        F.avg(positive.cast("double")).alias("positive_rate"),
        F.min("timestamp").alias("timestamp_min"),
        F.max("timestamp").alias("timestamp_max"),
        *[F.count_if(F.col(c) == vocab.UNKNOWN).alias(f"unknown_{c}") for c in CATEGORY_COLUMNS],
    )
    accounts = df.select(F.explode(F.array("sender_account", "receiver_account")).alias("a"))
    # Two one-row results side by side.
    return totals.crossJoin(accounts.distinct().agg(F.count("*").alias("unique_accounts")))


def manifest_splits(df: DataFrame) -> DataFrame:
    """Rows, positives, rate and time span of each split."""
    positive = F.col("is_laundering") == 1
    return df.groupBy("split").agg(
        F.count("*").alias("rows"), F.count_if(positive).alias("positives"),
        F.avg(positive.cast("double")).alias("positive_rate"),
        F.min("timestamp").alias("timestamp_min"), F.max("timestamp").alias("timestamp_max"),
    )


def manifest_types(df: DataFrame) -> DataFrame:
    """Positives by split and type."""
    positive = df.where(F.col("is_laundering") == 1)
    return positive.groupBy("split", "laundering_type").agg(F.count("*").alias("rows"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that depends on the rows but not on their order or partitioning."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(
        F.count("*").alias("rows"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum"),
        F.bit_xor(h).alias("hash_xor"),
    )


def dataset_id(prefix: str, source_hash: str, parameters: dict[str, object]) -> str:
    """A short id that follows from the source and the parameters."""
    import hashlib
    import json

    text = json.dumps({"source": source_hash, **parameters}, sort_keys=True)
    return f"{prefix}-{hashlib.sha256(text.encode()).hexdigest()[:12]}"


# --- sampling --------------------------------------------------------------------------------
def unit_hash(seed: int, *key: Column) -> Column:
    """A number in [0, 1) that depends only on the key and the seed."""
    mixed = F.xxhash64(F.lit(seed), *key)
    return F.pmod(mixed, F.lit(1 << 52)) / float(1 << 52)


def sample_negatives(
    df: DataFrame, rate: float, seed: int, key: str = "transaction_id",
    label: str = "is_laundering",
) -> DataFrame:
    """All positives and about ``rate`` of the negatives, the same on every run."""
    if not 0 < rate <= 1:
        raise ValueError("rate must be in (0, 1]")
    return df.where((F.col(label) == 1) | (unit_hash(seed, F.col(key)) < rate))
