"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts up to ``ORDER`` long with the counts of the bytes
that followed. A byte's code length comes from the longest context that was followed by it;
a longer context that was seen without it costs its escape probability (method C: d
different bytes in n give d / (n + d)), and what is left to the shorter context excludes
the bytes that the longer one knows. The code lengths over all bytes sum to one for every
context, so the total length of a text is exact. The language with the shortest code wins.

The statistics are frozen: the trees of all languages are merged into one table per length
of byte string, whose row holds the string's code length in every language with all
escapes already added, so a byte costs one look-up unless no language knows the string.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finsieve.llm.common import free_name, table
from finsieve.llm.terms import utf8, values

#: Longest context in bytes.
ORDER = 4
#: The bounded training sample of each language: different texts, in the order of a hash, at
#: most so many rows and until so many bytes are reached (the last text is taken whole).
TRAIN_ROWS = 1_000
TRAIN_BYTES = 2_000_000
#: Bytes scored at a time.
SLICE = 1_000_000
NO_LANGUAGE = "und"


# --- counting ---------------------------------------------------------------------------------
def string_keys(data: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """For n = 1, 2, ... ``most``: the last n bytes up to each place as one number.

    At places with fewer bytes before them the number is that of the shorter string.
    """
    key = data.astype(np.int64)
    yield key
    for n in range(1, most):
        longer = key.copy()
        longer[n:] |= data[:-n].astype(np.int64) << (8 * n)
        key = longer
        yield key


def sample(docs: DataFrame, train: F.Column, rows: int, size: int) -> DataFrame:
    """lang, text of each language's bounded sample; equal texts count once."""
    known = docs.where(train & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    text = F.col("text").cast("string")
    known = known.select("lang", text.alias("text"), F.xxhash64(text).alias("h"))
    # Only hashes travel; copies of a text meet as one row of each task.
    each = known.groupBy("lang", "h").agg(F.max(F.octet_length("text")).alias("size"))
    order = Window.partitionBy("lang").orderBy("h")
    first = each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= rows)
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    chosen = first.withColumn("before", before).where(F.coalesce("before", F.lit(0)) < size)
    picked = known.join(F.broadcast(chosen.select("lang", "h")), ["lang", "h"])
    return picked.groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")


def string_counts(texts: DataFrame, order: int) -> DataFrame:
    """lang, n, key, count of every byte string of 1 to ``order`` + 1 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(values(batch.column(0)), values(batch.column(1))):
                data = np.frombuffer(text, np.uint8)
                for n, keys in enumerate(string_keys(data, order + 1), 1):
                    key, count = np.unique(keys[n - 1 :], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(key), pa.string()),
                            pa.array(np.full(len(key), n, np.int32)), pa.array(key), pa.array(count),
                        ],
                        names=["lang", "n", "key", "count"],
                    )

    parts = texts.select("lang", utf8("text")).mapInArrow(run, "lang string, n int, key long, count long")
    return parts.groupBy("lang", "n", "key").agg(F.sum("count").alias("count"))


# --- the merged trees -------------------------------------------------------------------------
class Strings:
    """A set of byte strings of one length, looked up through an open-addressed hash table."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._start(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def _start(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers; -1 for strings that are not there."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self._start(keys)
        found = self.slots[at]
        going = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        at = at[going]
        while len(going):
            at = (at + 1) & (len(self.slots) - 1)
            there = self.slots[at]
            found[going] = there
            more = (there >= 0) & (self.keys[there] != keys[going])
            going, at = going[more], at[more]
        return found


@dataclass
class Trees:
    """Merged context trees: index n - 1 holds the strings of n bytes.

    ``bits`` are code lengths of a string's last byte after the others, ``escapes`` what a
    string costs as a context that lacks the next byte (0 where the language never saw it);
    one column per language. ``start`` is the escape of the empty context.
    """

    languages: list[str]
    strings: list[Strings]
    bits: list[np.ndarray]
    escapes: list[np.ndarray]
    start: np.ndarray

    def lengths(self, data: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Code length in bits of every byte in every language.

        ``known`` is how many bytes of context each place has within its text.
        """
        keys = list(string_keys(data, len(self.strings)))
        out = np.zeros((len(data), len(self.languages)), np.float32)
        left = np.arange(len(data))
        for n in range(len(self.strings), 0, -1):
            far = known[left] >= n - 1
            near, left = left[~far], left[far]
            found = self.strings[n - 1].find(keys[n - 1][left])
            hit = found >= 0
            out[left[hit]] += self.bits[n - 1][found[hit]]
            missed = left[~hit]
            if n > 1:
                # The context is the n - 1 bytes up to the place before.
                context = self.strings[n - 2].find(keys[n - 2][missed - 1])
                seen = context >= 0
                out[missed[seen]] += self.escapes[n - 2][context[seen]]
            else:
                out[missed] += self.start
            left = np.concatenate([near, missed])
        out[left] += 8.0
        return out


def build_trees(counts: pa.Table, order: int) -> Trees:
    """Frozen trees from lang, n, key, count."""
    langs = counts.column("lang").to_numpy(zero_copy_only=False)
    languages = sorted(set(langs))
    column = np.searchsorted(languages, langs) if languages else np.zeros(0, np.int64)
    n_of, key_of, count_of = (counts.column(c).to_numpy() for c in ("n", "key", "count"))
    width = len(languages)
    strings, bits, escapes = [], [], []
    shorter_bits = np.full((1, width), 8.0)
    start = np.zeros(width)
    for n in range(1, order + 2):
        mine = n_of == n
        keys, row = np.unique(key_of[mine], return_inverse=True)
        count = np.zeros((len(keys), width))
        count[row, column[mine]] = count_of[mine]
        # Strings grouped by context (all but the last byte, which is the lowest).
        contexts, group = np.unique(keys >> 8, return_inverse=True)
        # The same last byte after the context without its first byte.
        if n == 1:
            below = np.broadcast_to(shorter_bits, count.shape)
        else:
            below = shorter_bits[strings[-1].find(keys & ((1 << (8 * (n - 1))) - 1))]
        total, kinds, covered = (np.zeros((len(contexts), width)) for _ in range(3))
        np.add.at(total, group, count)
        np.add.at(kinds, group, count > 0)
        np.add.at(covered, group, np.where(count > 0, 2.0**-below, 0.0))
        followed = total > 0
        share = kinds / np.maximum(total + kinds, 1)
        cost = np.where(followed, -np.log2(np.maximum(share, 1e-300) / np.maximum(1 - covered, 1e-12)), 0.0)
        whole = (total + kinds)[group]
        own = -np.log2(np.where(count > 0, count, 1) / np.maximum(whole, 1))
        level = np.where(count > 0, own, cost[group] + below)
        if n == 1:
            start = cost[0] if len(contexts) else start
        else:
            # Contexts are strings of the level before.
            at = strings[-1].find(contexts)
            escapes[-1][at] = cost
        strings.append(Strings(keys))
        bits.append(level)
        escapes.append(np.zeros_like(level))
        shorter_bits = level
    return Trees(
        languages, strings, [b.astype(np.float32) for b in bits],
        [e.astype(np.float32) for e in escapes], start.astype(np.float32),
    )


def train_trees(
    docs: DataFrame, train: F.Column, order: int = ORDER, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES
) -> Trees:
    """Trees from the bounded sample of ``docs(text, lang)`` where ``train`` holds.

    The counts come to the driver: at most ``size`` bytes and one text per language, times
    the lengths of strings.
    """
    return build_trees(string_counts(sample(docs, train, rows, size), order).toArrow(), order)


# --- scoring ----------------------------------------------------------------------------------
def code_lengths(trees: Trees, texts: list[bytes]) -> np.ndarray:
    """Total code length in bits of each text in each language; texts of any length."""
    total = np.zeros((len(texts), len(trees.languages)))
    reach = len(trees.strings) - 1
    held: list[tuple[int, bytes, int]] = []
    size = 0

    def score() -> None:
        data = np.frombuffer(b"".join(part for _, part, _ in held), np.uint8)
        sizes = np.array([len(part) for _, part, _ in held])
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(data)) - np.repeat(starts, sizes)
        each = trees.lengths(data, place)
        # What was only there as context counts with the slice before.
        each[place < np.repeat(np.array([skip for _, _, skip in held]), sizes)] = 0
        sums = np.add.reduceat(each.astype(np.float64), starts)
        np.add.at(total, [i for i, _, _ in held], sums)

    for i, text in enumerate(texts):
        for at in range(0, len(text), SLICE):
            skip = min(at, reach)
            part = text[at - skip : at + SLICE]
            held.append((i, part, skip))
            size += len(part)
            if size >= SLICE:
                score()
                held, size = [], 0
    if held:
        score()
    return total


def identify(
    docs: DataFrame, trees: Trees, text_column: str = "text",
    prediction: str = "lang_pred", score: str = "score",
) -> DataFrame:
    """``docs`` with the language of the shortest code and its posterior (equal priors).

    Texts that are null, empty or without a letter, and all texts if ``trees`` learned no
    language, get ``und`` and 0. Ties go to the language that sorts first. Existing
    columns named ``prediction`` or ``score`` are replaced. Repeated rows are scored as
    often; texts of any length are scored whole.
    """
    rows = docs.drop(prediction, score)
    new = [T.StructField(prediction, T.StringType()), T.StructField(score, T.DoubleType())]
    schema = T.StructType([*rows.schema.fields, *new])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if ok and t else b"" for t, ok in zip(values(batch.column(0)), values(batch.column(1)))]
            found: list[str] = [NO_LANGUAGE] * len(texts)
            sure = np.zeros(len(texts))
            some = [i for i, t in enumerate(texts) if t]
            if some and trees.languages:
                bits = code_lengths(trees, [texts[i] for i in some])
                best = bits.argmin(axis=1)
                over = bits - bits[np.arange(len(some)), best][:, None]
                sure[some] = 1 / np.exp2(-np.minimum(over, 1000)).sum(axis=1)
                for i, b in zip(some, best.tolist()):
                    found[i] = trees.languages[b]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], pa.array(found, pa.string()), pa.array(sure)], names=names
            )

    letter = F.coalesce(F.col(text_column).cast("string").rlike(r"\p{L}"), F.lit(False))
    made = rows.select(
        utf8(text_column).alias(free_name(rows, "utf8")), letter.alias(free_name(rows, "letter")), *rows.columns
    )
    return made.mapInArrow(run, schema)


def is_held_out(id_column: str = "doc_id", modulus: int = 4, remainder: int = 2) -> F.Column:
    """Whether the CRC-32 of the id as text leaves the remainder; a null id counts as empty text."""
    text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus == remainder


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all ``documents``, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trees = train_trees(docs, ~is_held_out())
    rows = identify(docs.select("doc_id", "text", is_held_out().alias("held_out")), trees)
    return rows.select("doc_id", "held_out", "lang_pred", "score")
