"""A Katz backoff language model: counts, backoff weights and scores of whole documents.

Probabilities: an n-gram seen at least ``MIN_COUNT`` times has its Good-Turing discounted
count over its history's count; any other token gets the history's backoff weight times
its probability after the shorter history, down to single tokens and, for unknown ones, the
mass that discounting left. Backoff weights are computed from all seen n-grams of a history,
so the probabilities of all known tokens and of "unknown" add up to exactly 1.

Data flow: documents become blocks of token numbers. A block asks for each n-gram it
holds once, together with its own count; the requests are dealt by hash to buckets, which add
up and answer each block. Keys are sorted 64-bit hashes, written as differences. The totals
of histories travel in the same way. The driver sees a few sums per order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finsieve.llm.common import store, table, text_parts

ORDER = 2
#: Longer n-grams seen less often count as unseen (Katz drops singletons).
MIN_COUNT = 2
#: Counts up to this one are discounted.
DISCOUNTED = 5
BLOCK_CHARS = 6_000_000
KEYS_PER_BUCKET = 2_000_000

SENT = "kind string, order int, block long, bucket int, payload array<binary>, stats array<long>"
_START, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_CACHED_WORDS = 300_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _WordHashes()


def pack(values: np.ndarray) -> bytes:
    """The numbers byte plane by byte plane, compressed."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).reshape(-1).view(dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def longer(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of n-grams from the keys of their histories and last words."""
    x = history * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; bytes.lower and bytes.split know ASCII alone."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Block:
    """Some whole documents as token numbers, and the n-gram keys at each token."""

    def __init__(self, payload: list[bytes]):
        self.rows, self.ids = unpack(payload[0], np.int64), unpack(payload[1], np.int64)
        self.no_id = unpack(payload[2], np.uint8).astype(bool)
        self.train, self.lengths = unpack(payload[3], np.uint8), unpack(payload[4], np.int64)
        self.words = unpack(payload[5], np.uint64)[unpack(payload[6], np.uint32)]
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.rank = np.arange(len(self.words)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.trained = self.train[self.doc].astype(float)

    def before(self, values: np.ndarray, first) -> np.ndarray:
        """Each token's neighbour on the left; ``first`` at the start of a document."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.rank == 0] = first
        return out

    def keys(self, order: int) -> np.ndarray:
        found = self.words
        for _ in range(1, order):
            found = longer(self.before(found, _START), self.words)
        return found

    def holds(self, order: int) -> np.ndarray:
        """Where an n-gram of this order ends: one start marker at most goes before a document."""
        return self.rank >= order - 2


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    base, made = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        texts = [t or "" for t in batch["text"]]
        for part in text_parts(texts, BLOCK_CHARS):
            if len(_HASHES) > _CACHED_WORDS:
                _HASHES.clear()
            bags = [tokens_of(t) for t in texts[part]]
            lengths = np.array([len(b) + 1 for b in bags], np.int64)
            flat = np.full(lengths.sum(), _END)
            inner = np.ones(len(flat), bool)
            inner[np.cumsum(lengths) - 1] = False
            flat[inner] = np.fromiter(
                map(_HASHES.__getitem__, (w for b in bags for w in b)), np.uint64, int(inner.sum())
            )
            words, number, count = np.unique(flat, return_inverse=True, return_counts=True)
            # Numbers by falling frequency: their high bytes are mostly 0.
            order = np.argsort(-count, kind="stable")
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words), dtype=np.uint32)
            ids = batch["doc_id"].iloc[part]
            payload = [
                pack(batch["row_key"].iloc[part].to_numpy(np.int64)), pack(ids.fillna(0).to_numpy(np.int64)),
                pack(ids.isna().to_numpy().astype(np.uint8)), pack(batch["train"].iloc[part].to_numpy().astype(np.uint8)),
                pack(lengths), pack(words[order]), pack(place[number]),
            ]
            yield pd.DataFrame({
                "kind": ["block"], "order": [0], "block": [base + made], "bucket": [0],
                "payload": [payload], "stats": [[len(flat)]],
            })
            made += 1


def _requests(block: int, order: int, buckets: int, kind: str, keys: np.ndarray, *values: np.ndarray) -> pd.DataFrame:
    """Sorted keys and their values, one row per bucket of keys; buckets are equal key ranges."""
    cuts = np.searchsorted(keys >> np.uint64(32), [b * 2**32 // buckets for b in range(buckets + 1)])
    rows = [(b, x, y) for b, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
    return pd.DataFrame({
        "kind": kind, "order": order, "block": block, "bucket": [b for b, _, _ in rows],
        "payload": [[pack_sorted(keys[x:y]), *[pack(v[x:y]) for v in values]] for _, x, y in rows],
        "stats": [None] * len(rows),
    }, columns=["kind", "order", "block", "bucket", "payload", "stats"])


def _count_requests(order: int, buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, payload in zip(batch["block"], batch["payload"]):
                block = Block(payload)
                for n in range(1, order + 1):
                    at = block.holds(n)
                    keys, place = np.unique(block.keys(n)[at], return_inverse=True)
                    count = np.bincount(place, weights=block.trained[at], minlength=len(keys)).astype(np.int64)
                    yield _requests(number, n, buckets, "count", keys, count)

    return run


def _answer_counts(group: pd.DataFrame) -> pd.DataFrame:
    """Add up the counts of a bucket; tell each block the totals and which n-grams are its to report."""
    order, bucket = int(group["order"].iloc[0]), int(group["bucket"].iloc[0])
    group = group.sort_values("block")
    keys = [unpack_sorted(p[0]) for p in group["payload"]]
    counts = np.concatenate([unpack(p[1], np.int64) for p in group["payload"]])
    known, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    total = np.bincount(place, weights=counts).astype(np.int64)
    mine = np.zeros(len(counts), np.int64)
    mine[first] = 1
    told = 2 * total[place] + mine
    ends = np.cumsum([len(k) for k in keys])
    seen = total >= (1 if order == 1 else MIN_COUNT)
    stats = [int((total == r).sum()) for r in range(1, DISCOUNTED + 2)] + [int(total.sum()), int((total > 0).sum())]
    rows = [("table", order, -1, bucket, [pack_sorted(known[seen]), pack(total[seen])], stats)]
    for block, start, stop in zip(group["block"], ends - [len(k) for k in keys], ends):
        rows.append(("counts", order, block, bucket, [pack(told[start:stop])], None))
    return pd.DataFrame(rows, columns=["kind", "order", "block", "bucket", "payload", "stats"])


def _answer_sums(group: pd.DataFrame) -> pd.DataFrame:
    """Add up two numbers per history of a bucket and tell each block the totals."""
    order, bucket = int(group["order"].iloc[0]), int(group["bucket"].iloc[0])
    group = group.sort_values("block")
    keys = [unpack_sorted(p[0]) for p in group["payload"]]
    known, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [
        np.bincount(place, weights=np.concatenate([unpack(p[i], float) for p in group["payload"]]))
        for i in (1, 2)
    ]
    ends = np.cumsum([len(k) for k in keys])
    some = sums[0] > 0
    rows = [("weights", order, -1, bucket, [pack_sorted(known[some]), pack(sums[0][some]), pack(sums[1][some])], None)]
    for block, start, stop in zip(group["block"], ends - [len(k) for k in keys], ends):
        rows.append(("sums", order, block, bucket, [pack(s[place[start:stop]]) for s in sums], None))
    return pd.DataFrame(rows, columns=["kind", "order", "block", "bucket", "payload", "stats"])


def good_turing(found: list[int]) -> list[float]:
    """Discounts d_1 .. d_k from n_1 .. n_(k+1), the numbers of n-grams seen once, twice, ...

    Where the formula gives no number in (0, 1), half a count is taken off instead, so some
    mass is always left for what was not seen.
    """
    n = [0, *found]
    k = len(found) - 1
    common = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    out = []
    for r in range(1, k + 1):
        better = (r + 1) * n[r + 1] / (n[r] * r) if n[r] else 1.0
        d = (better - common) / (1 - common) if common < 1 else 1.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


class Model:
    """What the driver knows: discounts and totals. Everything per n-gram comes with the block."""

    def __init__(self, stats: dict[int, list[int]], order: int, documents: int):
        k = DISCOUNTED
        self.order, self.documents = order, documents
        none = [0] * (k + 3)
        self.discounts = {}
        for n in range(1, order + 1):
            d = good_turing(stats.get(n, none)[: k + 1])
            if n > 1:
                d = [0.0 if r < MIN_COUNT else x for r, x in enumerate(d, 1)]
            self.discounts[n] = np.array([0.0, *d])
        self.tokens, self.types = stats.get(1, none)[k + 1 :]
        ones = sum(c * r * (1 - d) for r, (c, d) in enumerate(zip(stats.get(1, none), self.discounts[1][1:]), 1))
        # The mass of unknown tokens; half a token if nothing was taken off.
        self.missing = (ones or 0.5) / self.tokens if self.tokens else 1.0
        self.scale = 1.0 if ones or not self.tokens else self.tokens / (self.tokens + 0.5)
        if not ones and self.tokens:
            self.missing = 0.5 / (self.tokens + 0.5)

    def discounted(self, order: int, count: np.ndarray) -> np.ndarray:
        d = self.discounts[order]
        return np.where(count < len(d), d[np.minimum(count, len(d) - 1)], 1.0) * count

    def probabilities(self, block: Block, order: int, counts: dict, sums: dict) -> np.ndarray:
        """The probability of every token after up to ``order - 1`` tokens, by recursion."""
        if order == 1:
            c = counts[1]
            known = self.discounted(1, c) / max(self.tokens, 1) * self.scale
            return np.where(c > 0, known, self.missing)
        lower = self.probabilities(block, order - 1, counts, sums)
        at = block.holds(order)
        of_history = block.before(counts[order - 1], self.documents if order == 2 else 0).astype(float)[at]
        discounted_sum, lower_sum = sums[order]
        # A history whose n-grams leave nothing is counted once more, as unseen.
        of_history = np.where(of_history - discounted_sum < 1e-9, of_history + 1, of_history)
        left = (of_history - discounted_sum) / of_history
        weight = left / np.maximum(1 - lower_sum, 1e-300)
        c = counts[order][at]
        own = self.discounted(order, c) / of_history
        out = lower.copy()
        out[at] = np.where(c >= MIN_COUNT, own, weight * lower[at])
        return out


def _gathered(group: pd.DataFrame, order: int) -> tuple[int, Block, dict, dict, dict, dict]:
    """A block, and for each order the totals and the ownership at each token."""
    by = {(k, n, b): p for k, n, b, p in zip(group["kind"], group["order"], group["bucket"], group["payload"])}
    block = Block(by["block", 0, 0])
    counts, mine, first = {}, {}, {}
    for n in range(1, order + 1):
        told = [unpack(p[0], np.int64) for _, p in sorted((b, p) for (k, m, b), p in by.items() if (k, m) == ("counts", n))]
        at = block.holds(n)
        told = np.concatenate(told) if told else np.zeros(0, np.int64)
        _, index, place = np.unique(block.keys(n)[at], return_index=True, return_inverse=True)
        counts[n] = np.zeros(len(block.words), np.int64)
        counts[n][at] = (told // 2)[place]
        first[n] = np.flatnonzero(at)[index]
        mine[n] = (told % 2).astype(bool)
    sums = {}
    for n in range(2, order + 1):
        parts = sorted((b, p) for (k, m, b), p in by.items() if (k, m) == ("sums", n))
        if parts:
            _, place = np.unique(block.before(block.keys(n - 1), _START)[block.holds(n)], return_inverse=True)
            sums[n] = tuple(np.concatenate([unpack(p[i], float) for _, p in parts])[place] for i in (0, 1))
    return int(group["block"].iloc[0]), block, counts, sums, mine, first


def _history_requests(model: Model, order: int, buckets: int):
    """What a block's own seen n-grams take from their histories, and all histories it needs."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        number, block, counts, sums, mine, first = _gathered(group, order)
        lower = model.probabilities(block, order - 1, counts, sums)
        history = block.before(block.keys(order - 1), _START)
        keys, place = np.unique(history[block.holds(order)], return_inverse=True)
        spot = np.zeros(len(block.words), np.int64)
        spot[block.holds(order)] = place
        own = first[order][mine[order]]
        own = own[counts[order][own] >= MIN_COUNT]
        took = model.discounted(order, counts[order][own])
        values = [np.bincount(spot[own], weights=w, minlength=len(keys)) for w in (took, lower[own])]
        return _requests(number, order, buckets, "sum", keys, *values)

    return run


def _scored(model: Model):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        _, block, counts, sums, _, _ = _gathered(group, model.order)
        p = np.log10(model.probabilities(block, model.order, counts, sums))
        base = np.log10((counts[1] + 0.5) / (model.tokens + 0.5 * (model.types + 1)))

        def per_doc(values: np.ndarray) -> np.ndarray:
            return np.bincount(block.doc, weights=values, minlength=len(block.lengths))

        return pd.DataFrame({
            "row_key": block.rows, "doc_id": pd.Series(block.ids).astype("Int64").mask(block.no_id),
            "training": block.train.astype(bool), "n_tokens": block.lengths,
            "n_known": per_doc(counts[1] > 0).astype(np.int64), "base_score": per_doc(base), "score": per_doc(p),
        })

    return run


def score_documents(
    docs: DataFrame, training: Column, order: int = ORDER, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Learn from the rows where ``training`` holds and score all rows.

    Returns row_key, doc_id, training, n_tokens, n_known (tokens seen in training), base_score
    (add-half unigram), score (log10 of the model's probability) and train_tokens. A null
    or empty text is the end token alone; rows with one id are scored one by one; without
    any training row every token is unknown and has probability 1. The tables of counts and
    backoff sums, by order, stay below the shared folder as "katz-counts" and "katz-weights".
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_key"), F.col(id_column).cast("long").alias("doc_id"),
        F.col(text_column).cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("train"),
    )
    # Dealt anew, so that a block has many documents however the files were cut.
    blocks = store(rows.mapInPandas(_blocks, SENT), "katz-blocks")
    tokens = blocks.agg(F.sum(F.col("stats")[0])).first()[0] or 0
    buckets = max(8, -(-tokens // KEYS_PER_BUCKET))

    asked = blocks.select("block", "payload").mapInPandas(_count_requests(order, buckets), SENT)
    counts = store(asked.groupBy("order", "bucket").applyInPandas(_answer_counts, SENT), "katz-counts", ["kind"])
    sums = (
        counts.where("kind = 'table'").select("order", F.posexplode("stats").alias("i", "n"))
        .groupBy("order", "i").agg(F.sum("n").alias("n")).orderBy("order", "i").collect()
    )
    stats: dict[int, list[int]] = {}
    for r in sums:
        stats.setdefault(r["order"], []).append(int(r["n"]))
    trained = rows.agg(F.count(F.when(F.col("train"), 1))).first()[0]
    model = Model(stats, order, trained)

    told = counts.where("kind = 'counts'").select(blocks.columns)
    for n in range(2, order + 1):
        known = blocks.unionByName(told.where(F.col("order") <= n))
        wanted = known.groupBy("block").applyInPandas(_history_requests(model, n, buckets), SENT)
        sums = store(wanted.groupBy("bucket").applyInPandas(_answer_sums, SENT), "katz-weights", ["kind"])
        told = told.unionByName(sums.where("kind = 'sums'").select(blocks.columns))
    scored = blocks.unionByName(told).groupBy("block").applyInPandas(
        _scored(model),
        "row_key long, doc_id long, training boolean, n_tokens long, n_known long, base_score double, score double",
    )
    return scored.withColumn("train_tokens", F.lit(model.tokens).cast("long"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    scored = score_documents(table(spark, sf_dir, "documents"), ~held)
    return scored.select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
