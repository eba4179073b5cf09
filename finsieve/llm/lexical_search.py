"""Ranked lexical search by norm buckets.

A document is a vector of term impacts. Vectors are ordered by length and cut into buckets
of neighbouring lengths. For a query and the score that its tenth document has so far, a
bucket whose longest vector can't reach that score (Cauchy-Schwarz) is passed over whole;
inside a bucket the query's largest coordinates give each document a partial product, and
Cauchy-Schwarz on what is left of both vectors decides who may still reach the score. Only
those are scored, exactly, in integers.

The queries are cut into blocks of bounded size. For one block the documents are reduced
to the block's vocabulary once and stored, in tasks of bounded size by length; each task
returns at most ``k`` rows per query.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finsieve.llm.common import store, table
from finsieve.llm.terms import terms, utf8, values

TOP = 10
#: Query text of one block, in bytes; its terms and vectors go to every task.
BLOCK_BYTES = 8_000_000
#: Documents whose vectors one task searches, and those of one norm bucket.
TASK_DOCS = 20_000
BUCKET_DOCS = 1_024
#: A bucket also ends where a vector is shorter than this share of its longest.
BUCKET_RATIO = 0.9
#: Share of a query's squared length that its focus coordinates cover.
FOCUS = 0.8
#: Bounds are doubles; scores within this of a bound are scored exactly.
SLACK = 1e-9

IMPACT = 1_000_000_000
B = 75


def length_factor(n: int, n_docs: int, n_terms: int) -> int:
    """The document's m: 100 - B plus B times its length over the mean length, rounded down."""
    return 100 - B + (B * n * n_docs) // n_terms


def term_weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Block:
    """A block of queries over one vocabulary: term numbers and counts of each item."""

    items: list
    columns: list[np.ndarray]
    counts: list[np.ndarray]
    vocabulary: dict[bytes, int]


def query_blocks(queries: DataFrame, id_column: str, text_column: str, block_bytes: int) -> Iterator[Block]:
    """Queries in blocks of about ``block_bytes`` of text, each read to the driver on its own.

    Rows that share an id are one item, with the text that sorts first. Items without a
    term have no results and are left out.
    """
    items = queries.groupBy(F.col(id_column).alias("item_id")).agg(
        F.min(F.coalesce(F.col(text_column).cast("string"), F.lit(""))).alias("text")
    )
    items = store(items, "search-items")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    for number in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number)
        block = Block([], [], [], {})
        for item, text in mine.orderBy("item_id").select("item_id", utf8("text")).collect():
            held = Counter(terms(bytes(text)))
            if held:
                numbers = [block.vocabulary.setdefault(t, len(block.vocabulary)) for t in held]
                block.items.append(item)
                block.columns.append(np.array(numbers, np.int64))
                block.counts.append(np.array(list(held.values()), np.int64))
        if block.items:
            yield block


def term_vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_column: str, text_column: str) -> DataFrame:
    """doc_id, n (all terms of the text) and the numbers and counts of the vocabulary's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = vocabulary.get
        for batch in batches:
            size, flat, counts, ends = [], [], [], [0]
            for text in values(batch.column(1)):
                words = terms(text)
                held = Counter(map(find, words))
                held.pop(None, None)
                size.append(len(words))
                flat += held.keys()
                counts += held.values()
                ends.append(len(flat))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(size, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32())),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), utf8(text_column))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def document_frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary; a task sends one row per term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            held += np.bincount(np.asarray(batch.column(0).flatten()), minlength=size)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["term", "n"])

    total = np.zeros(size, np.int64)
    parts = vectors.select("terms").mapInArrow(run, "term long, n long")
    for term, n in parts.groupBy("term").agg(F.sum("n")).collect():
        total[term] = n
    return total


def _rows(lists: pa.ListArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and where each row's values start (and the last ends)."""
    ends = np.asarray(lists.offsets).astype(np.int64)
    return np.asarray(lists.flatten()).astype(kind), ends - ends[0]


def _sums(values_: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each row; rows may be empty."""
    total = np.concatenate([np.zeros(1, values_.dtype), np.cumsum(values_)])
    return total[starts[1:]] - total[starts[:-1]]


def _impacts(flat: np.ndarray, tfs: np.ndarray, m: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return weights[flat] * ((IMPACT * tfs) // (1000 * tfs + 8 * m))


def with_norms(vectors: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """m and the length of each vector, whose coordinates are impacts over the root of the weight."""
    roots = np.sqrt(np.maximum(weights, 1).astype(float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lists, counts = batch.column(1).to_pylist(), batch.column(2), batch.column(3)
            m = [length_factor(x, n_docs, n_terms) for x in n]
            flat, starts = _rows(lists, np.int64)
            each = np.repeat(np.array(m, np.int64), np.diff(starts))
            p = _impacts(flat, _rows(counts, np.int64)[0], each, weights) / roots[flat]
            norm = np.sqrt(_sums(p * p, starts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(m, pa.int64()), pa.array(norm), lists, counts],
                names=["doc_id", "m", "norm", "terms", "tfs"],
            )

    rows = vectors.where(F.size("terms") > 0).select("doc_id", "n", "terms", "tfs")
    return rows.mapInArrow(run, "doc_id long, m long, norm double, terms array<int>, tfs array<int>")


class Best:
    """The ``k`` best documents of every query seen so far, and the score to reach."""

    def __init__(self, queries: int, k: int, least: np.ndarray):
        self.k = k
        self.least = np.maximum(least, 1)
        self.held: list[list[tuple[int, float, int | None]]] = [[] for _ in range(queries)]

    def offer(self, query: int, scores: np.ndarray, ids: list) -> None:
        held = self.held[query]
        # A null id sorts last among equal scores.
        held += [(-s, math.inf if i is None else i, i) for s, i in zip(scores.tolist(), ids)]
        held.sort(key=lambda x: x[:2])
        del held[self.k :]
        if len(held) == self.k:
            self.least[query] = max(self.least[query], -held[-1][0])


class Bucket:
    """Vectors of like length by document and, for the focus coordinates, by term."""

    def __init__(self, ids, m, norms, flat, tfs, starts, weights, roots):
        self.ids, self.norms, self.starts, self.flat = ids, norms, starts, flat
        self.impacts = _impacts(flat, tfs, np.repeat(m, np.diff(starts)), weights)
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(ids)), np.diff(starts))[order]
        self.p = (self.impacts / roots[flat])[order]
        self.terms, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat))

    def reaching(self, focus: np.ndarray, q_focus: np.ndarray, q_rest: float, least: float) -> np.ndarray:
        """Documents whose partial product and what the rest may add reach ``least``."""
        at = np.searchsorted(self.terms, focus)
        ok = at < len(self.terms)
        ok[ok] = self.terms[at[ok]] == focus[ok]
        partial, seen = np.zeros(len(self.ids)), np.zeros(len(self.ids))
        for i, q in zip(at[ok].tolist(), q_focus[ok].tolist()):
            part = slice(self.first[i], self.first[i + 1])
            owner, p = self.owner[part], self.p[part]
            partial[owner] += q * p
            seen[owner] += p * p
        rest = np.sqrt(np.maximum(self.norms * self.norms * (1 + SLACK) - seen, 0))
        return np.flatnonzero((partial + q_rest * rest) * (1 + SLACK) >= least)

    def exact(self, docs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Integer scores of ``docs``; ``counts`` holds the query's count for every term."""
        lengths = self.starts[docs + 1] - self.starts[docs]
        starts = np.concatenate([[0], np.cumsum(lengths)])
        places = np.arange(starts[-1]) + np.repeat(self.starts[docs] - starts[:-1], lengths)
        return _sums(counts[self.flat[places]] * self.impacts[places], starts)


def _bucket_cuts(norms: np.ndarray) -> Iterator[slice]:
    """Runs of falling norms: at most ``BUCKET_DOCS`` long and within ``BUCKET_RATIO``."""
    start = 0
    while start < len(norms):
        end = min(len(norms), start + BUCKET_DOCS)
        low = norms[start] * BUCKET_RATIO
        end = start + max(1, int(np.searchsorted(-norms[start:end], -low, side="right")))
        yield slice(start, end)
        start = end


def search_runs(vectors: DataFrame, block: Block, weights: np.ndarray, least: np.ndarray, k: int) -> DataFrame:
    """item (its number in the block), doc_id, score: the ``k`` best of every task's vectors.

    Batches hold vectors of like length, in any order.
    """
    roots = np.sqrt(np.maximum(weights, 1).astype(float))
    queries = []
    for columns, counts in zip(block.columns, block.counts):
        q = counts * roots[columns] * (weights[columns] > 0)
        order = np.argsort(-q, kind="stable")
        covered = np.cumsum(q[order] ** 2)
        total = float(covered[-1])
        size = int(np.searchsorted(covered, FOCUS * total)) + 1
        focus = order[:size]
        rest = math.sqrt(max(0.0, total * (1 + SLACK) - float(covered[min(size, len(order)) - 1])))
        queries.append((columns[focus], q[focus], rest))
    lengths = np.array([math.sqrt(float(((c * roots[t] * (weights[t] > 0)) ** 2).sum()))
                        for t, c in zip(block.columns, block.counts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries), k, least)
        dense = np.zeros(len(weights), np.int64)
        for batch in batches:
            batch = batch.take(pa.array(np.argsort(-np.asarray(batch.column(2)), kind="stable")))
            ids, norms = batch.column(0).to_pylist(), np.asarray(batch.column(2))
            m = np.asarray(batch.column(1))
            flat, starts = _rows(batch.column(3), np.int64)
            tfs = _rows(batch.column(4), np.int64)[0]
            for cut in _bucket_cuts(norms):
                lo, hi = starts[cut.start], starts[cut.stop]
                able = np.flatnonzero(lengths * norms[cut.start] * (1 + SLACK) >= best.least)
                if not len(able):
                    continue
                bucket = Bucket(
                    ids[cut], m[cut], norms[cut], flat[lo:hi], tfs[lo:hi],
                    starts[cut.start : cut.stop + 1] - lo, weights, roots,
                )
                for i in able.tolist():
                    docs = bucket.reaching(*queries[i], float(best.least[i]))
                    if not len(docs):
                        continue
                    dense[block.columns[i]] = block.counts[i]
                    scores = bucket.exact(docs, dense)
                    dense[block.columns[i]] = 0
                    good = np.flatnonzero(scores >= best.least[i])
                    if len(good):
                        best.offer(i, scores[good], [bucket.ids[d] for d in docs[good].tolist()])
        found = [(i, d, -s) for i, held in enumerate(best.held) for s, _, d in held]
        columns = list(zip(*found)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["item", "doc_id", "score"]
        )

    return vectors.select("doc_id", "m", "norm", "terms", "tfs").mapInArrow(
        run, "item long, doc_id long, score long"
    )


def _best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    docs: DataFrame, queries: DataFrame, k: int = TOP, id_column: str = "doc_id",
    text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text",
    block_bytes: int = BLOCK_BYTES, task_docs: int = TASK_DOCS,
) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` highest-scoring documents, score above 0.

    Null, empty and termless texts are no documents and no results. Repeated rows of
    ``docs`` each count and may each be a result; equal scores go by the smaller id, a
    null id last. Rows of ``queries`` that share an id are one item (the text that sorts
    first); a null item id is an id like any other. Terms repeated in an item count as
    often. Empty tables give no rows. Other columns of both tables are not read.

    The documents are read once per block of queries and their vectors stored twice, as
    they come and by length. The longest vectors are searched first, so that all tasks
    start with a score to beat.
    """
    spark = docs.sparkSession
    parts = []
    for block in query_blocks(queries, item_column, item_text_column, block_bytes):
        vectors = store(term_vectors(docs, block.vocabulary, id_column, text_column), "search-vectors")
        n_docs, n_terms, rows = vectors.agg(
            F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0)),
            F.count(F.when(F.size("terms") > 0, 1)),
        ).first()
        if not rows:
            continue
        df = document_frequencies(vectors, len(block.vocabulary))
        weights = np.array([term_weight(n, n_docs) for n in df.tolist()], np.int64)
        tasks = max(1, math.ceil(rows / task_docs))
        normed = with_norms(vectors, weights, n_docs, n_terms)
        runs = normed.repartitionByRange(tasks, F.desc("norm"), "doc_id")
        runs = runs.withColumn("run", F.spark_partition_id()).sortWithinPartitions(F.desc("norm"))
        runs = store(runs, "search-runs")
        none = np.zeros(len(block.items), np.int64)
        seeds = _best_of(search_runs(runs.where("run = 0"), block, weights, none, k), k)
        least = none.copy()
        for item, score in seeds.where(F.col("rank") == k).select("item", "score").collect():
            least[item] = score
        found = _best_of(search_runs(runs, block, weights, least, k), k)
        names = spark.createDataFrame(
            list(enumerate(block.items)), f"item long, item_id {queries.schema[item_column].dataType.simpleString()}"
        )
        parts.append(store(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "search-found"))
    if not parts:
        kind = queries.schema[item_column].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best ``documents`` for every ``benchmark`` item; see :func:`search`."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), q AS (
  SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL
), total AS (
  SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d
), tf AS (
  SELECT k, t, count(*) AS tf FROM (SELECT k, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL
), weight AS (
  SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, total GROUP BY t, n_docs
), m AS (
  SELECT k, doc_id, 25 + (75 * len(w)::BIGINT * n_docs) // n_terms AS m FROM d, total WHERE len(w) > 0
), scores AS (
  SELECT item_id, doc_id, k, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN weight USING (t) JOIN tf USING (t) JOIN m USING (k) GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""
