"""First copies of a stream that loses no late row: an index of ids by day of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsieve.operators.ordering import mark_first
from finsieve.session import cut_lineage
from finsieve.sources.files import path_exists


class SeenIds:
    """Transaction ids taken so far, in a table by day, and counts of every batch.

    A row is a copy if its id was taken from a row at most ``horizon_days`` away in event
    time, or comes earlier in its own batch. A late row, however late, is looked up in the
    days around its own time, so it is kept unless it is a copy; a batch reads only the
    days that its rows touch. Repeating a batch replaces what it wrote.
    """

    def __init__(self, spark: SparkSession, path: str, horizon_days: int = 7) -> None:
        self._spark, self._horizon = spark, horizon_days
        self._ids, self._counts = f"{path.rstrip('/')}/ids", f"{path.rstrip('/')}/counts"

    def _latest_us(self, batch_id: int) -> int | None:
        if not path_exists(self._spark, self._counts):
            return None
        earlier = self._spark.read.parquet(self._counts).where(F.col("batch_id") < batch_id)
        return earlier.agg(F.max("latest_us")).first()[0]

    def _taken(self, rows: DataFrame, batch_id: int) -> DataFrame | None:
        if not path_exists(self._spark, self._ids):
            return None
        days = [r[0] for r in rows.select("day").distinct().collect()]  # calendar days
        near = {
            day_number + d
            for day_number in days for d in range(-self._horizon, self._horizon + 1)
        }
        stored = self._spark.read.parquet(self._ids).where(
            (F.col("batch_id") < batch_id) & F.col("day").isin(*near)
        )
        return stored.select("transaction_id", F.col("day").alias("taken_day"))

    def take(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """The rows of a batch whose ids are new; needs transaction_id and timestamp."""
        order = ["timestamp"] + [c for c in ("seq",) if c in batch.columns]
        day = F.datediff(F.to_date("timestamp"), F.lit("1970-01-01")).alias("day")
        rows = cut_lineage(mark_first(batch.select("*", day), "transaction_id", order, "is_first"))
        firsts = rows.where("is_first").dropDuplicates(["transaction_id"])
        taken = self._taken(rows, batch_id)
        if taken is not None:
            near = (F.col("day") - F.col("taken_day")).between(-self._horizon, self._horizon)
            same = firsts["transaction_id"] == taken["transaction_id"]
            firsts = firsts.join(taken, same & near, "left_anti")
        firsts = cut_lineage(firsts.drop("is_first"))
        firsts.select("transaction_id", "day").write.mode("overwrite").partitionBy("day").parquet(
            f"{self._ids}/batch_id={batch_id}"
        )
        latest = self._latest_us(batch_id)
        t = F.unix_micros("timestamp")
        late = F.lit(0).cast("long") if latest is None else F.count_if(t < latest)
        # Two one-row results side by side.
        counts = rows.agg(
            F.count("*").alias("rows"), late.alias("late"),
            F.max(t).alias("latest_us"),
        ).crossJoin(firsts.agg(F.count("*").alias("kept")))
        counts.write.mode("overwrite").parquet(f"{self._counts}/batch_id={batch_id}")
        return firsts.drop("day")

    def counts(self) -> DataFrame:
        """batch_id, rows, kept, repeated, late (older than all rows of earlier batches)."""
        return self._spark.read.parquet(self._counts).select(
            F.col("batch_id").cast("long"), "rows", "kept",
            (F.col("rows") - F.col("kept")).alias("repeated"), "late",
        )
