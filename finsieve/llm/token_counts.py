"""Edit-aware token counts: a segment tree of pre-token runs per document.

A leaf of the tree is a run of ``LEAF`` pre-token chunks with its characters and tokens;
inner nodes are sums. An edit finds its leaves by descending over character sums, encodes
only these leaves again (and a neighbour where the cut between two chunks is lost) and
renews the sums above them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finsieve.llm.common import store, table
from finsieve.llm.packing import ChunkEncoder, tokenizer_path

LEAF = 32

STATE = T.StructType([
    T.StructField("row_key", T.LongType()), T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("leaf_chars", T.ArrayType(T.IntegerType(), False)),
    T.StructField("leaf_tokens", T.ArrayType(T.IntegerType(), False)),
])


class SumTree:
    """Sums over leaves in an array: node i has the children 2i and 2i + 1."""

    def __init__(self, leaves: list[int]):
        self.width = 1 << max(0, len(leaves) - 1).bit_length()
        self.sums = [0] * self.width + leaves + [0] * (self.width - len(leaves))
        for i in range(self.width - 1, 0, -1):
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    def total(self) -> int:
        return self.sums[1]

    def set(self, leaf: int, value: int) -> None:
        at = self.width + leaf
        change = value - self.sums[at]
        while change and at:
            self.sums[at] += change
            at >>= 1

    def find(self, position: int) -> tuple[int, int]:
        """The leaf that holds ``position`` (of 0 .. total - 1), and the sum before it."""
        at, before = 1, 0
        while at < self.width:
            at *= 2
            if position - before >= self.sums[at]:
                before += self.sums[at]
                at += 1
        return at - self.width, before


class CountedText:
    """A text in leaves, with trees over their characters and tokens."""

    def __init__(self, encode: ChunkEncoder, leaves: list[str], tokens: list[int]):
        self.encode, self.leaves = encode, leaves or [""]
        self.chars = SumTree([len(x) for x in self.leaves])
        self.tokens = SumTree(tokens or [0])
        self.encoded_chars = 0

    def n_tokens(self) -> int:
        return self.tokens.total()

    def edit(self, offset: int, deleted: int, inserted: str) -> None:
        """Replace ``deleted`` characters at ``offset`` by ``inserted``; both are cut to the text."""
        total = self.chars.total()
        offset = min(max(offset, 0), total)
        end = min(offset + max(deleted, 0), total)
        first, before = self.chars.find(max(min(offset, total - 1), 0))
        last = self.chars.find(end - 1)[0] if end > offset else first
        region = "".join(self.leaves[first : last + 1])
        region = region[: offset - before] + inserted + region[end - before :]
        # A cut holds where white space follows something else; otherwise take the neighbour in.
        while first > 0 and not (region and _blank(region[0])):
            first -= 1
            region = self.leaves[first] + region
        while last + 1 < len(self.leaves) and not (region and not _blank(region[-1])):
            last += 1
            region += self.leaves[last]
        self.encoded_chars += len(region)
        self.leaves[first : last + 1] = [region] + [""] * (last - first)
        self.chars.set(first, len(region))
        self.tokens.set(first, len(self.encode([region])[0]) // 4)
        for leaf in range(first + 1, last + 1):
            self.chars.set(leaf, 0)
            self.tokens.set(leaf, 0)

    def state(self) -> tuple[str, list[int], list[int]]:
        """Text and leaves without empty ones; leaves grown too long are cut again."""
        sizes, tokens = [], []
        for text, n in zip(self.leaves, self.tokens.sums[self.tokens.width :]):
            if len(text) > 64 * LEAF:
                more_sizes, more_tokens = leaves_of(self.encode, [text])[0]
                sizes += more_sizes
                tokens += more_tokens
            elif text:
                sizes.append(len(text))
                tokens.append(n)
        return "".join(self.leaves), sizes, tokens


def _blank(char: str) -> bool:
    return char.isspace() and not "\x1c" <= char <= "\x1f"


def leaves_of(encode: ChunkEncoder, texts: list[str]) -> list[tuple[list[int], list[int]]]:
    """Characters and tokens of the leaves of each text."""
    out = []
    for chunks in encode.chunked(texts):
        known = encode.known
        ends = [0, *accumulate(map(len, chunks))]
        counts = [0, *accumulate(len(known[c]) // 4 for c in chunks)]
        marks = [*range(0, len(chunks), LEAF), len(chunks)] if chunks else []
        out.append((
            [ends[b] - ends[a] for a, b in zip(marks, marks[1:])],
            [counts[b] - counts[a] for a, b in zip(marks, marks[1:])],
        ))
    return out


def build(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The first state of all documents: row_key, doc_id, text, n_tokens, leaf_chars, leaf_tokens.

    A null or empty text has no leaves and no tokens.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ChunkEncoder.at(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(2).to_pylist()]
                leaves = leaves_of(encode, texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array(texts, pa.string()),
                        pa.array([sum(t) for _, t in leaves], pa.int64()),
                        pa.array([c for c, _ in leaves], pa.list_(pa.int32())),
                        pa.array([t for _, t in leaves], pa.list_(pa.int32())),
                    ],
                    names=STATE.names,
                )

    return docs.select(
        F.monotonically_increasing_id().alias("row_key"), F.col(id_column).cast("long").alias("doc_id"),
        F.col(text_column).cast("string").alias("text"),
    ).mapInArrow(run, STATE)


def with_edits(state: DataFrame, edits: DataFrame) -> DataFrame:
    """``state`` with the edits of each document, in the order of ``seq``, in one array column.

    ``edits`` has doc_id, seq, offset, deleted, inserted; ties in seq go by the other columns.
    A document's own edits are all that ever meets in one row.
    """
    mine = edits.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("seq", "offset", "deleted", "inserted"))).alias("edits")
    )
    return state.join(mine, "doc_id", "left")


def apply_edits(state: DataFrame, tokenizer: str) -> DataFrame:
    """The state after the edits in column ``edits`` (array of offset, deleted, inserted, in order).

    Adds tokens_before and encoded_chars, the characters that were encoded again. Offsets
    are in characters of the text as the edits before left it and are cut to it; a null
    offset means 0, a null deleted 0, a null inserted nothing; no edits change nothing.
    """
    schema = T.StructType([
        *STATE.fields, T.StructField("tokens_before", T.LongType()), T.StructField("encoded_chars", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ChunkEncoder.at(tokenizer)
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(2, 7)]
            out = []
            for text, before, chars, tokens, edits in zip(*columns):
                text = text or ""
                ends = [0, *accumulate(chars or ())]
                counted = CountedText(encode, [text[a:b] for a, b in zip(ends, ends[1:])], list(tokens or ()))
                for e in edits or ():
                    counted.edit(e["offset"] or 0, e["deleted"] or 0, e["inserted"] or "")
                new, sizes, counts = counted.state()
                out.append((new, counted.n_tokens(), sizes, counts, before, counted.encoded_chars))
            text, n, sizes, counts, before, again = zip(*out) if out else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(n, pa.int64()),
                    pa.array(sizes, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())),
                    pa.array(before, pa.int64()), pa.array(again, pa.int64()),
                ],
                names=schema.names,
            )

    return state.select(*STATE.names, "edits").mapInArrow(run, schema)


def drawn_edits(count: int = 3):
    """Edits as an array expression, drawn from the id and the text: ``count`` of them, each
    replacing up to 15 characters somewhere by up to 31 characters from elsewhere in the text."""
    size = F.length("text")
    edits = []
    for k in range(count):
        draw = [F.pmod(F.xxhash64("doc_id", F.lit(k), F.lit(j)), F.lit(1 << 40)) for j in range(4)]
        edits.append(F.struct(
            F.lit(k).alias("seq"), (draw[0] % (size + 1)).cast("long").alias("offset"),
            (draw[1] % 16).cast("long").alias("deleted"),
            F.substring("text", (draw[2] % (size + 1) + 1).cast("int"), (draw[3] % 32).cast("int")).alias("inserted"),
        ))
    return F.array(*edits)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count before and after three edits drawn from its own row."""
    path = tokenizer_path()
    state = store(build(table(spark, sf_dir, "documents"), path), "token-counts")
    edited = apply_edits(state.withColumn("edits", drawn_edits()), path)
    return edited.select(
        "doc_id", "tokens_before", F.col("n_tokens").alias("tokens_after"), "encoded_chars",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )
