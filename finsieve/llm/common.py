"""Reading, word splitting, stored intermediate tables and row keys shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finsieve.session import work_folder

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array; an empty array for an empty or blank text."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def split_words(text: str | None) -> list[bytes]:
    """The same words as :func:`words_of`, in Python (bytes.split cuts at these six blanks)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def text_parts(texts: list[str], most_chars: int = 2_000_000) -> Iterator[slice]:
    """Slices of a batch whose texts together stay near ``most_chars``; at least one text each."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most_chars:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def store(df: DataFrame, name: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Write ``df`` below the cluster's shared folder and read it back.

    Cuts the lineage like a checkpoint, but compressed and column by column; it
    survives the loss of any executor.
    """
    path = work_folder(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    keys = list(partition_by)
    (writer.partitionBy(*keys) if keys else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def keyed(docs: DataFrame, id_column: str = "doc_id", name: str = "row_key") -> tuple[DataFrame, str]:
    """``docs`` with a unique long per row, and that column's name.

    The id itself where it is unique and never null; else the rows are stored once
    with a number each, so that later reads agree on it.
    """
    key = free_name(docs, name)
    ids = docs.select(F.col(id_column).cast("long").alias("id"))
    rows, plain = (
        ids.groupBy("id").count()
        .agg(F.sum("count"), F.count(F.when(F.col("id").isNotNull() & (F.col("count") == 1), 1)))
        .first()
    )
    if (rows or 0) == plain:
        return docs.withColumn(key, F.col(id_column).cast("long")), key
    return store(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key
