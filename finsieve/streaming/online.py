"""Online history features: each micro-batch is scored against the stored past, then recorded.

The history is a table of recorded transactions by day. A batch reads only the days a
window can reach plus the last older event of its senders, so what is read does not
grow with the age of the history, and hot accounts are swept in chunks as in batch
jobs. Nothing lives in a process: after a crash the batch is simply repeated.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsieve.operators.history import build_features
from finsieve.operators.ordering import mark_first
from finsieve.schemas import CANONICAL_COLUMNS
from finsieve.session import cut_lineage
from finsieve.sources.files import path_exists

HORIZON_DAYS = 7


class OnlineHistory:
    """History table at ``path`` with a side table of each sender's last event."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark = spark
        self._events = f"{path.rstrip('/')}/events"
        self._last = f"{path.rstrip('/')}/last"

    def _stored(self, folder: str, batch_id: int) -> DataFrame | None:
        """Rows written by earlier batches; a repeated batch ignores its own rows."""
        if not path_exists(self._spark, folder):
            return None
        return self._spark.read.parquet(folder).where(F.col("batch_id") < batch_id)

    def prior(self, batch: DataFrame, batch_id: int) -> DataFrame | None:
        """Rows the windows of this batch can reach, plus older last events of senders."""
        stored = self._stored(self._events, batch_id)
        if stored is None:
            return None
        first = batch.agg(F.min("timestamp")).first()[0]
        if first is None:
            return None
        horizon = first - timedelta(days=HORIZON_DAYS)
        columns = [*CANONICAL_COLUMNS, "seq"]
        recent = stored.where(
            (F.col("day") >= F.lit(horizon.date())) & (F.col("timestamp") >= F.lit(horizon))
        ).select(*columns)
        senders = batch.select("sender_account").distinct()
        newest = F.max(F.struct("timestamp", "transaction_id", F.struct(*columns).alias("row")))
        older = (
            self._stored(self._last, batch_id)
            .where(F.col("timestamp") < F.lit(horizon))
            .join(senders, "sender_account", "left_semi")
            .groupBy("sender_account").agg(newest.alias("m")).select("m.row.*")
        )
        return recent.unionByName(older.select(*columns))

    def score_and_record(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Features of a batch of canonical rows (with ``seq``); first copies are stored."""
        batch = cut_lineage(batch.select(*CANONICAL_COLUMNS, "seq"))
        prior = self.prior(batch, batch_id)
        features = cut_lineage(build_features(batch, prior=prior))
        new = mark_first(batch, "transaction_id", ("timestamp", "seq")).where("is_first")
        if prior is not None:
            ids = new.select("transaction_id")
            known = prior.join(ids, "transaction_id", "left_semi").select("transaction_id")
            new = new.join(known, "transaction_id", "left_anti")
        new = cut_lineage(new.drop("is_first"))
        self._write(new, self._events, batch_id)
        newest = F.max(F.struct("timestamp", "transaction_id", F.struct("*").alias("row")))
        last = new.groupBy("sender_account").agg(newest.alias("m")).select("m.row.*")
        self._write(last.select(*new.columns), self._last, batch_id)
        return features

    def recorded(self, batch_id: int) -> DataFrame:
        """The rows that a batch added to the history."""
        return self._spark.read.parquet(f"{self._events}/batch_id={batch_id}")

    def _write(self, rows: DataFrame, folder: str, batch_id: int) -> None:
        """One folder per batch, replaced when the batch is repeated."""
        rows.withColumn("day", F.to_date("timestamp")).write.mode("overwrite").partitionBy(
            "day"
        ).parquet(f"{folder}/batch_id={batch_id}")

