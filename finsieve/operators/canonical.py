"""From received or raw records to canonical transactions, with validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finsieve import schemas, vocab
from finsieve.functions import scalars as S
from finsieve.functions.identity import display_identity


class InputError(ValueError):
    """Rows break the transaction contract."""


# --- received transactions -----------------------------------------------------------------
def from_received(df: DataFrame) -> DataFrame:
    """Rename received fields to the canonical record. Times without an offset are UTC."""
    when = F.col("timestamp")
    if dict(df.dtypes)["timestamp"] == "string":
        when = S.utc_timestamp(when, naive_is_utc=True)
    optional = [
        (F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c)
        for c in vocab.OPTIONAL_FIELDS
    ]
    return df.select(
        "transaction_id",
        when.alias("timestamp"),
        F.col("sender_iban").alias("sender_account"),
        F.col("receiver_iban").alias("receiver_account"),
        F.col("amount"),
        F.col("currency").alias("payment_currency"),
        *optional,
        *[c for c in ("seq",) if c in df.columns],
    )


def input_errors(df: DataFrame) -> Column:
    """Reasons against a canonical row, joined by ``; ``; empty for a good row."""
    types = dict(df.dtypes)
    checks = []
    for field in vocab.REQUIRED_FIELDS:
        if field not in df.columns:
            raise InputError(f"missing required column {field!r}")
        missing = F.col(field).isNull()
        if types[field] == "string":
            missing = S.is_missing(F.col(field))
        checks.append(F.when(missing, F.lit(f"missing {field}")))
    checks.append(
        F.when(
            ~S.is_missing(F.col("amount").cast("string"))
            & S.valid_amount(F.col("amount")).isNull(),
            F.lit("amount must be finite and > 0"),
        )
    )
    if types["timestamp"] == "string":
        bad_time = S.utc_timestamp(F.col("timestamp"), naive_is_utc=False).isNull()
        checks.append(
            F.when(
                ~S.is_missing(F.col("timestamp")) & bad_time,
                F.lit("timestamp must carry an offset"),
            )
        )
    return F.concat_ws("; ", *checks)


def canonicalize(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Validate, default and normalise; an ``errors`` text column is added.

    Only declared columns and those named in ``keep`` are carried along, so label
    columns can never reach the features.
    """
    errors = input_errors(df)
    types = dict(df.dtypes)
    when = F.col("timestamp")
    when = (
        S.utc_timestamp(when, naive_is_utc=False)
        if types["timestamp"] == "string"
        else when.cast("timestamp")
    )

    def optional(name: str) -> Column:
        return S.filled(F.col(name).cast("string")) if name in df.columns else F.lit(None)

    pay = S.normal_code(F.col("payment_currency"))
    home = F.lit(vocab.DEFAULT_COUNTRY)
    return df.select(
        F.col("transaction_id").cast("string").alias("transaction_id"),
        when.alias("timestamp"),
        F.col("sender_account").cast("string").alias("sender_account"),
        F.col("receiver_account").cast("string").alias("receiver_account"),
        S.valid_amount(F.col("amount")).alias("amount"),
        pay.alias("payment_currency"),
        F.coalesce(S.normal_code(optional("received_currency")), pay).alias("received_currency"),
        F.coalesce(S.normal_code(optional("sender_country")), home).alias("sender_country"),
        F.coalesce(S.normal_code(optional("receiver_country")), home).alias("receiver_country"),
        F.coalesce(
            S.normal_payment_type(optional("payment_type")), F.lit(vocab.UNKNOWN)
        ).alias("payment_type"),
        *keep,
        errors.alias("errors"),
    )


def accepted(canonical: DataFrame) -> DataFrame:
    return canonical.where(F.col("errors") == "").drop("errors")


def rejected(canonical: DataFrame) -> DataFrame:
    return canonical.where(F.col("errors") != "")


def require_valid(canonical: DataFrame) -> DataFrame:
    """Strict mode: fail the job on the first bad row, inside the scan of the rows."""
    first = F.concat(
        F.lit("bad transaction "), F.coalesce("transaction_id", F.lit("?")), F.lit(": "), "errors"
    )
    checked = F.when(F.col("errors") != "", F.raise_error(first)).otherwise(F.col("errors"))
    return canonical.withColumn("errors", checked).where(F.col("errors") == "").drop("errors")


def row_features(canonical: DataFrame) -> list[Column]:
    """The eight features that need no history, in vector order."""
    return [
        F.log1p("amount").cast("float").alias("log_amount"),
        S.utc_hour(F.col("timestamp")).alias("hour"),
        S.weekday(F.col("timestamp")).alias("day_of_week"),
        S.category_code(F.col("payment_type"), vocab.PAYMENT_TYPES).alias("payment_type_code"),
        (F.col("payment_currency") != F.col("received_currency"))
        .cast("tinyint").alias("currency_mismatch"),
        (F.col("sender_country") != F.col("receiver_country"))
        .cast("tinyint").alias("cross_border"),
        S.category_code(F.col("sender_country"), vocab.COUNTRIES).alias("sender_country_code"),
        S.category_code(F.col("receiver_country"), vocab.COUNTRIES)
        .alias("receiver_country_code"),
    ]


# --- contract rules --------------------------------------------------------------------------
def _length(name: str, low: int, high: int, required: bool) -> tuple[str, Column]:
    value = F.col(name) if required else F.coalesce(F.col(name), F.lit(""))
    bad = ~F.coalesce(F.length(value).between(low, high), F.lit(False))
    return f"{name} length", bad


def _range(name: str, low: float, high: float) -> tuple[str, Column]:
    return f"{name} range", F.col(name).isNotNull() & ~F.col(name).between(low, high)


def received_violations(df: DataFrame) -> Column:
    """Names of the contract rules a received transaction breaks."""
    rules: list[tuple[str, Column]] = []
    for side in ("sender", "receiver"):
        iban = S.clean_iban(F.col(f"{side}_iban"))
        rules.append((f"{side}_iban length", iban.isNull() | (F.length(iban) > 34)))
        rules.append(_length(f"{side}_name", 1, 200, required=True))
        rules.append(_length(f"{side}_city", 0, 100, required=False))
    rules.append(("amount range", S.valid_amount(F.col("amount")).isNull()))
    for name, longest in (
        ("currency", 3), ("description", 500), ("received_currency", 3), ("sender_country", 2),
        ("receiver_country", 2), ("payment_type", 50), ("sender_ip", 45), ("device_id", 100),
    ):
        if name in df.columns:
            rules.append(_length(name, 0, longest, required=False))
    if "sender_latitude" in df.columns:
        rules.append(_range("sender_latitude", -90, 90))
        rules.append(_range("sender_longitude", -180, 180))
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))


def alert_violations() -> Column:
    rules = [
        ("confidence range", ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))),
        ("severity domain",
         ~F.coalesce(F.col("severity").isin(*vocab.SEVERITY_RANK), F.lit(False))),
        ("title length", F.length(F.coalesce("title", F.lit(""))) > 200),
        ("description length", F.length(F.coalesce("description", F.lit(""))) > 2000),
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))


# --- labelled raw dataset ----------------------------------------------------------------------
def with_source_row(df: DataFrame) -> DataFrame:
    """Add ``source_row``: the 0-based row number in file order, without one big task.

    ``df`` must come straight from a file reader with the ``_block`` and ``_row``
    columns of :func:`finsieve.sources.files.read_labelled_csv`: rows inside a block
    have consecutive ids, so only one row per block takes part in the running total.
    """
    blocks = df.groupBy("_block").agg(F.count("*").alias("n"), F.min("_row").alias("_start"))
    # One row per file block: small next to the data, so one ordered pass is fine.
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return (
        df.join(blocks.drop("n"), "_block")
        .withColumn("source_row", F.col("_row") - F.col("_start") + F.col("_offset"))
        .drop("_row", "_start", "_offset", "_block")
    )


def raw_problems(raw: DataFrame) -> DataFrame:
    """One row with the number of rows that break each dataset rule."""
    digits = r"^\d+$"
    amount = S.scaled_amount(F.col("Amount"))
    return raw.agg(
        F.count("*").alias("rows"),
        F.count_if(
            ~F.coalesce(F.col("Sender_account").rlike(digits), F.lit(False))
            | ~F.coalesce(F.col("Receiver_account").rlike(digits), F.lit(False))
        ).alias("bad_accounts"),
        F.count_if(~F.coalesce(amount > 0, F.lit(False))).alias("bad_amounts"),
        F.count_if(~F.coalesce(F.col("Is_laundering").isin(0, 1), F.lit(False)))
        .alias("bad_labels"),
        F.count_if(
            F.to_timestamp(F.concat_ws(" ", "Date", "Time"), "yyyy-MM-dd HH:mm:ss").isNull()
        ).alias("bad_times"),
    )


def check_raw(raw: DataFrame) -> None:
    """Raise when the dataset is empty or any rule is broken (one aggregate row is read)."""
    counts = raw_problems(raw).first().asDict()
    if counts.pop("rows") == 0:
        raise InputError("source has no rows")
    broken = {name: n for name, n in counts.items() if n}
    if broken:
        raise InputError(f"source breaks dataset rules: {broken}")


def from_raw(raw: DataFrame, prefix: str = vocab.SOURCE_ID_PREFIX) -> DataFrame:
    """Raw labelled rows (with ``source_row``) to the canonical labelled record."""
    sender = display_identity(F.col("sender_account"))
    receiver = display_identity(F.col("receiver_account"))
    return (
        raw.select(
            F.concat(F.lit(prefix), F.lpad(F.col("source_row").cast("string"), 9, "0"))
            .alias("transaction_id"),
            F.to_timestamp(F.concat_ws(" ", "Date", "Time"), "yyyy-MM-dd HH:mm:ss")
            .alias("timestamp"),
            F.col("Sender_account").alias("sender_account"),
            F.col("Receiver_account").alias("receiver_account"),
            S.scaled_amount(F.col("Amount")).alias("amount"),
            S.translate_category(F.col("Payment_currency"), vocab.RAW_CURRENCIES)
            .alias("payment_currency"),
            S.translate_category(F.col("Received_currency"), vocab.RAW_CURRENCIES)
            .alias("received_currency"),
            S.translate_category(F.col("Sender_bank_location"), vocab.RAW_COUNTRIES)
            .alias("sender_country"),
            S.translate_category(F.col("Receiver_bank_location"), vocab.RAW_COUNTRIES)
            .alias("receiver_country"),
            S.translate_category(F.col("Payment_type"), vocab.RAW_PAYMENT_TYPES)
            .alias("payment_type"),
            F.col("Is_laundering").cast("tinyint").alias("is_laundering"),
            F.col("Laundering_type").alias("laundering_type"),
        )
        .withColumn("_s", sender)
        .withColumn("_r", receiver)
        .withColumns(
            {
                "sender_iban": F.col("_s.iban"),
                "sender_name": F.col("_s.name"),
                "receiver_iban": F.col("_r.iban"),
                "receiver_name": F.col("_r.name"),
            }
        )
        .select(*schemas.DATASET_COLUMNS)
    )
