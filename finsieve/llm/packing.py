"""Tokenising documents into pieces, and bounded-space online best-fit packing of the pieces."""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsieve.llm.common import store, table, text_parts

CAPACITY = 2048
OPEN_BINS = 4096
LOOK_AHEAD = 4096
PIECES_PER_TASK = 20_000

#: A run of white space with the run of other characters behind it. The tokenizer's own
#: pattern never joins a character with white space after it, so a text's ids are the ids
#: of its chunks one after another. U+001C..1F are white space to Python alone: not cut at.
CHUNKS = re.compile("[^\\S\x1c-\x1f]*[\\S\x1c-\x1f]+|[^\\S\x1c-\x1f]+")
_CACHED_CHUNKS = 1_200_000
_BLANK_FIRST = re.compile("[^\\S\x1c-\x1f]+[\\S\x1c-\x1f]")
_ENCODERS: dict[str, ChunkEncoder] = {}


def _line_starts(text: str) -> list[int]:
    """The numbers of the words that begin a line, in a text with single blanks between words."""
    return [0, *accumulate(line.count(" ") + 1 for line in text.split("\n")[:-1])]


class ChunkEncoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, chunk by chunk.

    ``known`` has the ids of chunks, ``spaced`` those of words with a space in front. Python workers live on between tasks, and so does the cache, which is emptied when
    it would hold more than ``_CACHED_CHUNKS`` chunks.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        # Each character of a token stands for one byte of the text.
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)

    @classmethod
    def at(cls, path: str) -> ChunkEncoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def _make_room(self) -> None:
        if len(self.known) + len(self.spaced) > _CACHED_CHUNKS:
            self.known, self.spaced = {}, {}

    def _cut(self, texts: list[str]) -> list[list[str]]:
        chunks = [CHUNKS.findall(t) for t in texts]
        self._know({c for found in chunks for c in found})
        return chunks

    def _know(self, chunks: set[str]) -> None:
        new = list(chunks.difference(self.known))
        self.known.update(zip(new, self._encoded(new)))

    def chunked(self, texts: list[str]) -> list[list[str]]:
        """The chunks of each text; ``known`` holds them all until the next call."""
        self._make_room()
        return self._cut(texts)

    def __call__(self, texts: list[str]) -> list[bytes]:
        self._make_room()
        # Most texts have words with one space or line feed between them, and no regular
        # expression is needed to cut these.
        words = [t.split() for t in texts]
        plain = [bool(w) and " ".join(w) == t.replace("\n", " ") for t, w in zip(texts, words)]
        others = iter(self._cut([t for t, p in zip(texts, plain) if not p]))
        new = list(set().union(*[w for w, p in zip(words, plain) if p]).difference(self.spaced))
        self.spaced.update(zip(new, self._encoded([" " + w for w in new])))
        starts = [_line_starts(t) if p else [] for t, p in zip(texts, plain)]
        self._know({
            "\n" + w[at] if at else w[0] for w, found in zip(words, starts) for at in found
        })
        get, spaced = self.known.__getitem__, self.spaced.__getitem__
        out = []
        for w, found in zip(words, starts):
            if not found:
                out.append(b"".join(map(get, next(others))))
                continue
            parts = list(map(spaced, w))
            for at in found:
                parts[at] = get("\n" + w[at] if at else w[0])
            out.append(b"".join(parts))
        return out

    def _encoded(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk; many in one call where they may stand side by side."""
        out: list[bytes] = [b""] * len(chunks)
        side_by_side = []
        for i, chunk in enumerate(chunks):
            if _BLANK_FIRST.match(chunk):
                side_by_side.append(i)
            else:
                ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
                out[i] = struct.pack(f"<{len(ids)}I", *ids)
        for at in range(0, len(side_by_side), 500):
            group = side_by_side[at : at + 500]
            code = self.tokenizer.encode("".join([chunks[i] for i in group]), add_special_tokens=False)
            ids = np.array(code.ids, dtype="<u4")
            ends = np.cumsum([len(chunks[i].encode()) for i in group])
            stops = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1
            raw, start = ids.tobytes(), 0
            for i, stop in zip(group, stops.tolist()):
                out[i] = raw[4 * start : 4 * stop]
                start = stop
        return out


def encode_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0,
    id_column: str = "doc_id", text_column: str = "text", key: str | None = None,
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: row_key, doc_id, piece, start, length, ids.

    A document is its tokens and ``end_id``. Longer documents are cut from the end, so
    that only the first piece may be shorter than ``capacity``. ``ids`` are bytes,
    little-endian unsigned 32-bit. A null or empty text is the one token ``end_id``.
    One pass over the documents without a shuffle; a text is in memory with its tokens.
    """
    end = struct.pack("<I", end_id)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ChunkEncoder.at(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for part in text_parts(texts):
                at, number, begin, length, ids = [], [], [], [], []
                for i, code in enumerate(encode(texts[part]), part.start):
                    code += end
                    n = len(code) // 4
                    cut = n % capacity or capacity
                    cuts = [0, *range(cut, n + 1, capacity)] if n > capacity else [0, n]
                    for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        at.append(i)
                        number.append(p)
                        begin.append(a)
                        length.append(b - a)
                        ids.append(code[4 * a : 4 * b])
                index = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(index), batch.column(1).take(index),
                        pa.array(number, pa.int32()), pa.array(begin, pa.int64()),
                        pa.array(length, pa.int64()), pa.array(ids, pa.binary()),
                    ],
                    names=["row_key", "doc_id", "piece", "start", "length", "ids"],
                )

    row = F.col(key) if key else F.monotonically_increasing_id()
    return docs.select(
        row.alias("row_key"), F.col(id_column).cast("long").alias("doc_id"),
        F.col(text_column).cast("string").alias("text"),
    ).mapInArrow(pieces, "row_key long, doc_id long, piece int, start long, length long, ids binary")


class OpenBins:
    """At most ``most`` open bins in lists by free space; a bitset says which lists hold any."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.open, self.made = 0, 0, 0
        self.levels: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        level = self.levels[free]
        found = level.pop()
        if not level:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, size: int) -> tuple[int, int]:
        """The bin for an item and its offset there: the open bin with least room that fits."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            chosen = self._take(free)
        else:
            chosen, free = self.made, self.capacity
            self.made += 1
        offset, left = self.capacity - free, free - size
        if left:
            self.levels[left].append(chosen)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return chosen, offset


def best_fit(
    pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
    look_ahead: int = LOOK_AHEAD, pieces_per_task: int = PIECES_PER_TASK,
) -> DataFrame:
    """``pieces`` with sequence_id and offset: sequences of at most ``capacity`` tokens, no gaps.

    ``pieces`` needs row_key, piece and length (1 to ``capacity``; a longer piece or one
    without a length is an error); what other columns it has goes along. Each task packs
    about ``pieces_per_task`` pieces, whatever the size of the table, as a stream: the
    next ``look_ahead`` pieces are put in falling order, each goes to the open bin that
    it fills best, and beyond ``open_bins`` open bins the fullest closes. The number of
    tasks needs one count of ``pieces``, which should therefore be stored.
    """
    schema = pieces.drop("sequence_id", "offset").schema.add("sequence_id", "long").add("offset", "long")
    rows = pieces.drop("sequence_id", "offset")
    tasks = max(1, math.ceil(rows.count() / pieces_per_task))
    names = rows.columns

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        bins = OpenBins(capacity, open_bins)
        for batch in batches:
            for at in range(0, batch.num_rows, look_ahead):
                part = batch.slice(at, look_ahead)
                sizes = part.column(names.index("length")).to_pylist()
                if any(not s or s < 1 or s > capacity for s in sizes):
                    raise ValueError(f"a piece must have 1 to {capacity} tokens")
                where: list = [None] * len(sizes)
                for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
                    where[i] = bins.place(sizes[i])
                extra = [
                    pa.array([base + w[0] for w in where], pa.int64()),
                    pa.array([w[1] for w in where], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *extra], names=[*names, "sequence_id", "offset"]
                )

    # In an order that a repeated task finds again.
    spread = rows.repartition(tasks, F.xxhash64("row_key", "piece")).sortWithinPartitions(
        F.xxhash64("piece", "row_key"), "row_key", "piece"
    )
    return spread.mapInArrow(packed, schema)


def pack_documents(docs: DataFrame, tokenizer: str, key: str | None = None) -> DataFrame:
    """Pieces of ``docs`` with ids_crc32 in place of the ids, and their places."""
    pieces = encode_pieces(docs, tokenizer, key=key)
    pieces = store(pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32"), "pieces")
    return best_fit(pieces)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path()).drop("row_key")
