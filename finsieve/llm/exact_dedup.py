"""Exact dedup against a persistent digest index, bucketed and sorted by digest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finsieve.llm.common import BLANKS, keyed, store, table, text_or_empty
from finsieve.session import work_folder


def normalised(text: str = "text") -> Column:
    """Every run of blanks as one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(text), BLANKS, " ")


def digest_of(text: str = "text") -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


class DigestIndex:
    """Digests of all documents taken in so far, each with the id that stays.

    Files lie below ``path``, in ``buckets`` buckets sorted by digest, so a sort-merge
    join with the index never shuffles the index. The number of buckets belongs to the
    files and must be the same whenever an index is opened again.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digest_index_{uuid.uuid4().hex[:12]}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS "
            f"LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, fresh: DataFrame) -> None:
        """Add rows (digest, keep_id) whose digests the index lacks."""
        fresh.repartition(self.buckets, "digest").write.insertInto(self.name)


def deduplicate(
    docs: DataFrame, index: DigestIndex, id_column: str = "doc_id", text_column: str = "text",
    key: str | None = None,
) -> DataFrame:
    """Take a batch into the index and say of every row whether it stays.

    Returns one row per input row: row_key, doc_id, digest (binary SHA-256 of the
    normalised text), keep_id (the id that stays for this text), group_size (rows of
    the batch with this text), kept. Of equal texts in a batch the smallest id stays;
    a null id comes last, and among rows with one id (repeated rows) exactly one stays.
    A text that an earlier batch brought is dropped, unless the row has the very id
    that the index keeps: taking a batch in again, after a crash or by mistake, gives
    the same answers. ``key`` names a column that is unique per row; else rows are
    numbered. Null texts count as empty; an empty table gives an empty result.
    """
    row = F.col(key) if key else F.monotonically_increasing_id()
    rows = docs.select(
        row.alias("row_key"), F.col(id_column).cast("long").alias("doc_id"),
        digest_of(text_column).alias("digest"),
    )
    rows = store(rows, "digests")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")
    groups = rows.groupBy("digest").agg(
        F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size")
    )
    unseen = groups.join(index.read().hint("merge"), "digest", "left_anti")
    index.append(unseen.select("digest", F.col("first.doc_id").alias("keep_id")))
    # Stored, so that both sides of the next join are shuffled for it and AQE may split
    # the one group that holds many rows.
    stays = store(
        groups.join(index.read().hint("merge"), "digest").select(
            "digest", "keep_id", "group_size", F.col("first.doc_id").alias("first_id"),
            F.col("first.row_key").alias("first_row"),
        ),
        "stays",
    )
    kept = (F.col("row_key") == F.col("first_row")) & F.col("keep_id").eqNullSafe(F.col("first_id"))
    return rows.join(stays.hint("merge"), "digest").select(
        "row_key", "doc_id", "digest", "keep_id", "group_size", kept.alias("kept")
    )


def keep_first(docs: DataFrame, index: DigestIndex, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns they came with."""
    rows, key = keyed(docs)
    dropped = deduplicate(rows, index, text_column=text_column, key=key).where(~F.col("kept"))
    gone = dropped.select(F.col("row_key").alias(key))
    return rows.join(gone, key, "left_anti").select(*docs.columns)


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index for one run, its buckets as many as shuffle partitions."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return DigestIndex(spark, work_folder(spark, "digest-index"), buckets)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = deduplicate(table(spark, sf_dir, "documents"), new_index(spark))
    return decisions.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP1_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
