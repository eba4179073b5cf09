"""Substring dedup: word windows that occur earlier are cut out of the documents.

Suffix automata of reference shards give, for the passages streamed through them, the
matching statistics and with them the earliest occurrence of every window. Broadcasting
automata of the whole corpus to all documents would cost corpus x shards, so both sides
are first cut down to what repeats and then routed:

* Every window of ``WINDOW`` words has an anchor, the ``GRAM`` words in it with the
  smallest hash. Equal windows have equal anchors.
* The consecutive windows of one anchor are one piece of text, known by its anchor and the
  hash of its bytes. Equal pieces become one row with the earliest place by a partial
  aggregate, however many there are.
* Only anchors with several different pieces need an automaton. The texts are read again for
  the words of these, one place per piece, and the anchors are dealt to shards of bounded
  size. In a shard every anchor has its own automaton: others hold none of its windows.
* An anchor with more pieces than a shard holds goes to no automaton: its windows are rows,
  a partial aggregate finds the earliest place of each, and a piece keeps the windows that
  it wins. No task meets all its pieces.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finsieve.llm.common import free_name, keyed, store, table, text_parts
from finsieve.session import work_folder

WINDOW = 20
GRAM = 5
PIECES_PER_SHARD = 4000

#: Bytes hashed at a time: the arrays stay in the processor's cache.
_BYTES = 1 << 16
_FACTOR = 0x9E3779B97F4A7C15
#: The low bits of a gram's code are its place, so that the smallest code has the leftmost place.
_PLACE_BITS = 20

_IS_BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_FACTOR))


@cache
def _powers(factor: int) -> np.ndarray:
    """The powers of ``factor`` modulo 2^64, for every place in a stretch of bytes."""
    powers = np.full(2 * _BYTES, factor, np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


def flat_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts as bytes with one space behind each; the start of every word and
    the end; the number of the first word of every text and that of all words."""
    lengths = [len(t or b"") + 1 for t in texts]
    raw = np.frombuffer(b" ".join([t or b"" for t in texts]) + b" ", np.uint8)
    solid = ~_IS_BLANK[raw]
    stays = solid.copy()
    stays[1:] |= solid[:-1]
    flat = np.where(solid, raw, np.uint8(32))[stays]
    bounds = np.concatenate([[0], np.flatnonzero(flat == 32) + 1])
    solid[1:] &= ~solid[:-1].copy()
    first = np.searchsorted(np.flatnonzero(solid), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64))
    return flat, bounds, first


def word_hashes(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of every word's bytes: a polynomial by running sums, or xxh64 for very long words."""
    out = np.empty(len(bounds) - 1, np.uint64)
    long = np.flatnonzero(np.diff(bounds) > _BYTES)
    cuts = np.searchsorted(bounds, np.arange(0, bounds[-1] + _BYTES, _BYTES)).clip(max=len(out))
    cuts = np.unique(np.concatenate([cuts, long, long + 1])).tolist()
    powers, inverses = _powers(_FACTOR), _powers(pow(_FACTOR, -1, 1 << 64))
    for a, b in zip(cuts[:-1], cuts[1:]):
        stretch, starts = flat[bounds[a] : bounds[b]], bounds[a:b] - bounds[a]
        if b == a + 1 and len(stretch) > _BYTES:
            out[a] = xxhash.xxh64_intdigest(stretch.tobytes())
        else:
            out[a:b] = np.add.reduceat(_BYTE_CODES[stretch] * powers[: len(stretch)], starts) * inverses[starts]
    return _mixed(out)


def anchor_runs(
    flat: np.ndarray, bounds: np.ndarray, first: np.ndarray, window: int, gram: int
) -> tuple[np.ndarray, ...]:
    """(text number, first word, last window's first word, anchor) of all runs of windows with one
    anchor in the texts of :func:`flat_words`; words are counted over all texts.

    The anchor of a window is the leftmost of its grams with the smallest hash; as windows
    move on it never moves back, so the windows of one anchor are consecutive.
    """
    words, total = word_hashes(flat, bounds), len(bounds) - 1
    padded = np.concatenate([words, np.zeros(gram, np.uint64)])
    least = np.zeros(total, np.uint64)
    for k in range(gram):
        least += padded[k : k + total] * np.uint64(_FACTOR * (2 * k + 1) % (1 << 64))
    low = np.uint64((1 << _PLACE_BITS) - 1)
    least = (_mixed(least) & ~low) | (np.arange(total, dtype=np.uint64) & low)
    wide, target = 1, window - gram + 1
    while wide < target:
        step = min(wide, target - wide)
        least = np.concatenate([np.minimum(least[:-step], least[step:]), least[-step:]])
        wide += step
    lengths = np.diff(first)
    starts = np.flatnonzero(np.arange(total) + window <= np.repeat(first[1:], lengths))
    text, least = np.repeat(np.arange(len(lengths)), lengths)[starts], least[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(starts))[: len(at)] - 1
    return text[at], starts[at], starts[last], (least[at] >> np.uint64(_PLACE_BITS)).view(np.int64)


def _bytes_of(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def _runs(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in _bytes_of(batch, 2)]
            for part in text_parts(texts):
                flat, bounds, first = flat_words(texts[part])
                text, start, last, anchor = anchor_runs(flat, bounds, first, window, gram)
                data = flat.tobytes()
                begin, end = bounds[start].tolist(), (bounds[last + window] - 1).tolist()
                code = map(xxhash.xxh3_64_intdigest, [data[a:b] for a, b in zip(begin, end)])
                index = pa.array(text + part.start)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(index), batch.column(1).take(index), pa.array(anchor),
                        pa.array(np.fromiter(code, np.uint64, len(begin)).view(np.int64)),
                        pa.array((start - first[text]).astype(np.int32)),
                        pa.array((last + window - start).astype(np.int32)),
                    ],
                    names=["row_key", "rank", "anchor", "code", "start", "size"],
                )

    return run


def _wording(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the pieces that are asked for, one row each."""
    for batch in batches:
        texts = [t or b"" for t in _bytes_of(batch, 2)]
        for part in text_parts(texts):
            flat, bounds, first = flat_words(texts[part])
            data = flat.tobytes()
            asked = batch.column(3).slice(part.start, part.stop - part.start)
            fields = asked.flatten()
            text = np.repeat(np.arange(len(asked)), pc.list_value_length(asked).to_numpy(zero_copy_only=False))
            start = fields.field("start").to_numpy()
            begin = first[text] + start
            end = bounds[begin + fields.field("size").to_numpy()] - 1
            words = [data[a:b] for a, b in zip(bounds[begin].tolist(), end.tolist())]
            index = pa.array(text + part.start)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(index), batch.column(1).take(index), fields.field("start"),
                    fields.field("size"), fields.field("anchor"), fields.field("variants"),
                    pa.array(words, pa.binary()),
                ],
                names=["row_key", "rank", "start", "size", "anchor", "variants", "words"],
            )


class SuffixAutomaton:
    """Of many word sequences; knows for each state the smallest key of its end positions."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.key = [-1], [0], [math.inf]

    def _state(self, length: int, link: int, moves: dict[bytes, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.key.append(math.inf)
        return len(self.next) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The state of the longest suffix that p's move by ``word`` stands for."""
        following, link, length = self.next, self.link, self.length
        if length[p] + 1 == length[q]:
            return q
        clone = self._state(length[p] + 1, link[q], dict(following[q]))
        while p >= 0 and following[p].get(word) == q:
            following[p][word] = clone
            p = link[p]
        link[q] = clone
        return clone

    def add(self, words: list[bytes], key: int) -> None:
        """Add a sequence whose first word has ``key``, the next ``key + 1`` and so on."""
        following, link, length, keys = self.next, self.link, self.length, self.key
        last = 0
        for word in words:
            known = following[last].get(word)
            if known is not None:
                last = self._split(last, word, known)
            else:
                new = self._state(length[last] + 1, 0, {})
                p = last
                while p >= 0 and word not in following[p]:
                    following[p][word] = new
                    p = link[p]
                if p >= 0:
                    link[new] = self._split(p, word, following[p][word])
                last = new
            if key < keys[last]:
                keys[last] = key
            key += 1

    def finish(self) -> None:
        """Carry the smallest keys from every state to those of its suffixes."""
        keys, link = self.key, self.link
        for state in sorted(range(1, len(keys)), key=self.length.__getitem__, reverse=True):
            up = link[state]
            if keys[state] < keys[up]:
                keys[up] = keys[state]

    def matches(self, words: list[bytes], most: int) -> Iterator[tuple[int, float]]:
        """Matching statistics, up to ``most`` words: for every word the length of the longest
        sequence ending there that the automaton holds, and the smallest key it ends at."""
        following, link, length, keys = self.next, self.link, self.length, self.key
        state = matched = 0
        for word in words:
            while state and word not in following[state]:
                state = link[state]
                matched = length[state]
            if word in following[state]:
                state = following[state][word]
                matched += 1
            while length[link[state]] >= most if state else False:
                state = link[state]
            matched = min(matched, most)
            yield matched, keys[state]


def _beaten(window: int):
    """For each piece of a shard the windows that another piece has at an earlier place."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        places = sorted({*zip(group["rank"], group["row_key"])})
        number = {p: i for i, p in enumerate(places)}
        by_anchor: dict[int, list[int]] = {}
        for i, anchor in enumerate(group["anchor"].tolist()):
            by_anchor.setdefault(anchor, []).append(i)
        # Places in the order of documents, then of words; a key is that of a word.
        keys = [
            (number[rank, row] << 44) + start
            for rank, row, start in zip(group["rank"], group["row_key"], group["start"].tolist())
        ]
        texts = group["words"].tolist()
        found: list[list[int]] = [[] for _ in texts]
        for members in by_anchor.values():
            automaton, pieces = SuffixAutomaton(), []
            for i in members:
                words = texts[i].split(b" ")
                pieces.append((i, words, keys[i]))
                automaton.add(words, keys[i])
            automaton.finish()
            for i, words, key in pieces:
                found[i] = [
                    at - window + 1
                    for at, (matched, earliest) in enumerate(automaton.matches(words, window))
                    if matched == window and earliest < key + at
                ]
        out = group[["row_key", "start"]].assign(beaten=found)
        return out[[bool(f) for f in found]]

    return run


def _beaten_in_crowds(pieces: DataFrame, window: int) -> DataFrame:
    """What ``_beaten`` gives, for pieces of anchors that have too many for one task.

    Equal windows have equal anchors, so the earliest place among these pieces is the
    earliest of all; every window that a piece does not win is beaten.
    """
    offsets = F.sequence(F.lit(0), F.col("size") - window)
    split = F.split(F.col("words").cast("string"), " ")
    windows = (
        pieces.select("rank", "row_key", "start", split.alias("split"), F.explode(offsets).alias("offset"))
        .select(
            F.unhex(F.md5(F.array_join(F.slice("split", F.col("offset") + 1, F.lit(window)), " "))).alias("code"),
            F.struct("rank", "row_key", (F.col("start") + F.col("offset")).alias("at"), "start", "offset").alias("place"),
        )
    )
    wins = (
        windows.groupBy("code").agg(F.min("place").alias("place"))
        .groupBy("place.row_key", "place.start").agg(F.collect_list("place.offset").alias("wins"))
    )
    beaten = F.array_except(offsets, F.coalesce("wins", F.array().cast("array<int>")))
    return (
        pieces.select("row_key", "start", "size").join(wins, ["row_key", "start"], "left")
        .select("row_key", "start", beaten.alias("beaten")).where("size(beaten) > 0")
    )


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Within it, a job's shuffle files go when its result is stored, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bucketed(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` stored in buckets of ``key``: later joins on it shuffle only the other side."""
    spark = rows.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"bucketed_{uuid.uuid4().hex[:12]}"
    (
        rows.repartition(buckets, key).write.option("compression", "zstd").bucketBy(buckets, key)
        .option("path", work_folder(spark, "bucketed")).saveAsTable(name)
    )
    return spark.table(name)


def repeated_spans(texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(row_key, spans): word ranges [start, end) of ``texts`` that occur earlier.

    ``texts`` has row_key (unique), rank (long, never null: what comes earlier) and text,
    in buckets of row_key. A range is covered by windows of ``window`` words whose words also
    start at a smaller (rank, row_key) or before in the same text. Rows without any are
    not returned; ranges may overlap.
    """
    runs = store(
        texts.select("row_key", "rank", "text").mapInArrow(
            _runs(window, gram), "row_key long, rank long, anchor long, code long, start int, size int"
        ),
        "runs",
    )
    different = store(
        runs.groupBy("anchor", "code", "size").agg(
            F.min(F.struct("rank", "row_key", "start")).alias("first"), F.count(F.lit(1)).alias("n")
        ),
        "different-pieces",
    )
    several = different.groupBy("anchor").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1")
    asked = (
        different.select("anchor", "size", "first.row_key", "first.start").join(several, "anchor")
        .groupBy("row_key").agg(F.collect_list(F.struct("start", "size", "anchor", "variants")).alias("asked"))
    )
    # Read by both branches below and by the count: the texts are joined once.
    routed = store(
        texts.select("row_key", "rank", "text").join(asked.hint("merge"), "row_key").mapInArrow(
            _wording, "row_key long, rank long, start int, size int, anchor long, variants long, words binary"
        ),
        "routed",
    )
    crowded = F.col("variants") > PIECES_PER_SHARD
    reference = routed.where(~crowded).select("anchor", "words", "rank", "row_key", "start")
    shards = max(1, math.ceil(reference.count() / PIECES_PER_SHARD))
    beaten = (
        reference.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard")
        .applyInPandas(_beaten(window), "row_key long, start int, beaten array<int>")
        .unionByName(_beaten_in_crowds(routed.where(crowded), window))
    )

    def span(start, end):
        return F.struct(start.alias("start"), end.alias("end"))

    start = F.col("start")
    late = beaten.select("row_key", F.transform("beaten", lambda o: span(start + o, start + o + window)).alias("spans"))
    # Of equal pieces, all but the first go as a whole.
    copies = different.where("n > 1").select("anchor", "code", "size", "first")
    again = (
        runs.select("anchor", "code", "size", "row_key", "start").join(copies, ["anchor", "code", "size"])
        .where("row_key <> first.row_key OR start <> first.start")
        .select("row_key", F.array(span(start, start + F.col("size"))).alias("spans"))
    )
    return late.unionByName(again).groupBy("row_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def without_spans(texts: list[bytes], spans: pa.ListArray) -> pa.StructArray:
    """n_words, n_removed and kept_text of every text after its word ranges are cut out."""
    flat, bounds, first = flat_words(texts)
    count = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
    base, ranges, total = np.repeat(first[:-1], count), spans.flatten(), len(bounds) - 1
    edges = [np.bincount(base + ranges.field(f).to_numpy(), minlength=total + 1) for f in ("start", "end")]
    stays = np.cumsum(edges[0] - edges[1])[:total] == 0
    sums = np.concatenate([[0], np.cumsum(stays)])[first]
    kept = np.diff(sums)
    bytes_stay = np.repeat(stays, np.diff(bounds))
    # No space behind a text's last kept word.
    last = np.flatnonzero(stays)[sums[1:][kept > 0] - 1]
    bytes_stay[bounds[last + 1] - 1] = False
    ends = np.concatenate([[0], np.cumsum(bytes_stay)])[bounds[first]].astype(np.int32)
    text = pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(flat[bytes_stay]))
    n_words = np.diff(first)
    return pa.StructArray.from_arrays(
        [pa.array(n_words), pa.array(n_words - kept), text], names=["n_words", "n_removed", "kept_text"]
    )


def _cut(text_at: int, width: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in _bytes_of(batch, text_at)]
            for part in text_parts(texts):
                rows = batch.slice(part.start, part.stop - part.start)
                cut = without_spans(texts[part], rows.column(width))
                yield pa.RecordBatch.from_arrays([*rows.columns[:width], cut], names=names)

    return run


def deduplicate(
    docs: DataFrame, key: str, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW
) -> tuple[DataFrame, str]:
    """``docs`` and a struct (n_words, n_removed, kept_text) per row, and that column's name.

    A word goes if a window of ``window`` words around it also starts earlier: in a
    smaller doc_id (nulls come last; among equal ids in a smaller ``key``) or before in
    the same text. All windows are judged on the input. kept_text has the other words
    joined by one space. Null, empty and blank texts have no words; texts shorter than a
    window lose nothing. ``key`` must be unique. The whole rows are shuffled once.
    """
    spans, cut = free_name(docs, "spans"), free_name(docs, "cut")
    with shuffles_released(docs.sparkSession):
        rows = bucketed(docs, key)
        texts = rows.select(
            F.col(key).alias("row_key"), F.col(text_column).cast("string").alias("text"),
            F.coalesce(F.col(id_column).cast("long"), F.lit(2**63 - 1)).alias("rank"),
        )
        found = repeated_spans(texts, window)
    found = found.select(F.col("row_key").alias(key), F.col("spans").alias(spans))
    joined = rows.join(found.hint("merge"), key, "left").select(*docs.columns, spans)
    result = T.StructType().add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    schema = T.StructType([*docs.schema.fields, T.StructField(cut, result)])
    at, names = docs.columns.index(text_column), [*docs.columns, cut]
    return joined.mapInArrow(_cut(at, len(docs.columns), names), schema), cut


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated windows cut out of ``text``, and ``n_chars`` (if there) to match.

    Rows that lose no word keep their text as it is; no row goes.
    """
    rows, key = keyed(docs)
    done, cut = deduplicate(rows, key)
    changed = F.col(f"{cut}.n_removed") > 0
    new = {"text": F.col(f"{cut}.kept_text"), "n_chars": F.length(f"{cut}.kept_text").cast("long")}
    return done.select(
        *[F.when(changed, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in docs.columns]
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, key = keyed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    done, cut = deduplicate(docs, key)
    return done.select(
        "doc_id", f"{cut}.n_words", f"{cut}.n_removed",
        F.sha2(F.col(f"{cut}.kept_text").cast("binary"), 256).alias("kept_sha256"),
    )


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), windows AS (
  SELECT doc_id, i, list_slice(w, i, i + 19) AS g FROM d, unnest(range(1, len(w) - 18)) AS r(i)
), late AS (
  SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1
), removed AS (
  SELECT doc_id, list(DISTINCT i + k) AS gone FROM late, range(0, 20) AS o(k) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce(array_to_string(
    list_filter(list_transform(w, lambda x, i: CASE WHEN list_contains(gone, i) THEN NULL ELSE x END),
    lambda x: x IS NOT NULL), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN removed USING (doc_id)
"""
