"""Importance resampling towards a target corpus over hashed word n-grams.

Two bags of buckets, of all documents and of all target texts, give a gain per bucket; a
document weighs the mean gain of its features. Gumbel noise from a hash of the id turns
the weights into a draw without replacement: the highest scores are taken.

Words come from a byte table and ``bytes.split``; a feature's bucket is the CRC-32 of its
bytes, and a longer feature's CRC goes on from the shorter one's (``zlib.crc32`` takes the
value so far), so that no feature is ever put together as a string.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finsieve.llm.common import free_name, store, table
from finsieve.llm.terms import terms, utf8, values

BUCKETS = 10_000
LONGEST = 2
LEAST_WORDS = 20
SHARE = 25
SEED = 7

RESULT = ("n_words", "n_features", "weight", "score", "rank")


def feature_crcs(words: list[bytes], longest: int = LONGEST) -> list[int]:
    """CRC-32 of every run of 1 to ``longest`` words joined by one space, shorter runs first."""
    runs = [crc32(w) for w in words]
    found = list(runs)
    for n in range(1, longest):
        runs = [crc32(w, crc32(b" ", seed)) for w, seed in zip(words[n:], runs)]
        found += runs
    return found


def bucket_counts(
    texts: DataFrame, text_column: str = "text", longest: int = LONGEST, buckets: int = BUCKETS
) -> np.ndarray:
    """Features per bucket over all texts. Each task sends at most ``buckets`` rows."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[int] = Counter()
        for batch in batches:
            for text in values(batch.column(0)):
                held.update([c % buckets for c in feature_crcs(terms(text), longest)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())],
            names=["bucket", "n"],
        )

    parts = texts.select(utf8(text_column)).mapInArrow(counted, "bucket long, n long")
    total = np.zeros(buckets, np.int64)
    # One row per bucket, whatever the corpus holds.
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():
        total[bucket] = n
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, smoothed by one."""
    s_all, t_all, n = int(source.sum()), int(target.sum()), len(source)
    return np.array(
        [
            math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n))))
            for s, t in zip(source.tolist(), target.tolist())
        ],
        np.int64,
    )


def noise(seed: int, doc_id: int | None) -> int:
    """Gumbel noise in thousandths from the first 32 bits of a SHA-256."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = int(digest[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(
    docs: DataFrame, bucket_gains: np.ndarray, keep: Sequence[str] = ("doc_id",),
    longest: int = LONGEST, seed: int = SEED, text_column: str = "text", id_column: str = "doc_id",
) -> DataFrame:
    """Columns ``keep`` with n_words, n_features, weight and score of every row."""
    kept = [c for c in keep if c not in RESULT]
    fields = [docs.schema[c] for c in kept]
    schema = T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in RESULT[:-1]]])
    names, buckets = schema.names, len(bucket_gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for doc_id, text in zip(values(batch.column(0)), values(batch.column(1))):
                words = terms(text)
                crcs = np.array(feature_crcs(words, longest), np.int64) % buckets
                total = int(bucket_gains[crcs].sum())
                weight = total // len(crcs) if len(crcs) else 0
                for column, value in zip(out, (len(words), len(crcs), weight, weight + noise(seed, doc_id))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], *[pa.array(c, pa.int64()) for c in out]], names=names
            )

    rows = docs.select(
        F.col(id_column).cast("long").alias(free_name(docs, "id")), utf8(text_column).alias(free_name(docs, "utf8")), *kept
    )
    return rows.mapInArrow(run, schema)


def ranked(scores: DataFrame, least_words: int, share: int, id_column: str) -> DataFrame:
    """``scores`` with ``rank``: the best ``share`` percent of rows with enough words.

    Runs of neighbouring scores are cut by range and written once; the rank is the place
    in the run plus the rows of the runs before, so no task sorts everything.
    """
    enough = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc_nulls_last(id_column)]
    runs = scores.where(enough).repartitionByRange(*order).withColumn("_run", F.spark_partition_id())
    runs = store(runs, "resampling-runs")
    sizes = {r: n for r, n in runs.groupBy("_run").count().collect()}  # one row per partition
    before, so_far = {}, 0
    for r in sorted(sizes):
        before[r], so_far = so_far, so_far + sizes[r]
    drawn = share * so_far // 100
    offsets = scores.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "_run int, _before long")
    place = F.row_number().over(Window.partitionBy("_run").orderBy(*order)) + F.col("_before")
    placed = runs.join(F.broadcast(offsets), "_run").withColumn("rank", place.cast("long"))
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scores.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return placed.select(*rest.columns).unionByName(rest)


def resample(
    docs: DataFrame, target: DataFrame, keep: Sequence[str] = ("doc_id",), share: int = SHARE,
    least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED,
    text_column: str = "text", id_column: str = "doc_id",
) -> DataFrame:
    """Every row of ``docs``: columns ``keep``, n_words, n_features, weight, score, rank (null: not drawn).

    Null, empty and wordless texts have no features and weigh 0; they and texts under
    ``least_words`` are never drawn. Repeated rows each count and compete for themselves;
    equal scores go by the smaller id, a null id (its noise is that of an empty id) last;
    rows alike in both may take either place. An empty target or corpus gives gains of
    smoothed zeros. A kept column named like a result column is left out; all texts are
    read whole, twice.
    """
    of = bucket_counts(docs, text_column, longest, buckets)
    to = bucket_counts(target, "text", longest, buckets)
    if id_column not in keep:
        keep = (*keep, id_column)
    rows = scored(docs, gains(of, to), keep, longest, seed, text_column, id_column)
    return ranked(store(rows, "resampling-scores"), least_words, share, id_column)


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs`` themselves, in all their columns but those named like results."""
    rows = resample(docs, target, keep=docs.columns, **options)
    return rows.where(F.col("rank").isNotNull()).drop(*RESULT)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and ranks of all ``documents`` towards all ``benchmark`` texts; see :func:`resample`."""
    rows = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1
    THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT) ORDER BY i) AS t FROM range(0, 256) AS r(i)
), texts AS (
  SELECT false AS wanted, doc_id AS id, text FROM documents
  UNION ALL SELECT true, item_id, text FROM benchmark
), cut AS (
  SELECT wanted, id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), features AS (
  SELECT wanted, id, unnest(w) AS f FROM cut
  UNION ALL
  SELECT wanted, id, w[i] || ' ' || w[i + 1] FROM cut, unnest(range(1, len(w))) AS r(i)
), hashed AS (
  SELECT f, xor(list_reduce(
    list_transform(range(1, length(hex(f)), 2), lambda i: ('0x' || substr(hex(f), i, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM features), crc_table
), placed AS (
  SELECT wanted, id, bucket FROM features JOIN hashed USING (f)
), counts AS (
  SELECT bucket, count(*) FILTER (NOT wanted) AS s, count(*) FILTER (wanted) AS t FROM placed GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + 10000)::DOUBLE)))::BIGINT AS g FROM counts
), weights AS (
  SELECT id, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight
  FROM placed JOIN gain USING (bucket) WHERE NOT wanted GROUP BY id
), scores AS (
  SELECT c.id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || c.id), 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296)))::BIGINT AS score
  FROM cut c LEFT JOIN weights USING (id) WHERE NOT wanted
), places AS (
  SELECT *, CASE WHEN n_words >= 20 THEN
    row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, id) END AS place,
    count(*) FILTER (n_words >= 20) OVER () AS n_long
  FROM scores
)
SELECT id AS doc_id, n_features::BIGINT AS n_features, weight, score,
  CASE WHEN place <= 25 * n_long // 100 THEN place END AS rank
FROM places
"""
