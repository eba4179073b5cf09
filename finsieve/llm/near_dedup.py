"""Near-duplicates by ProbMinHash signatures of weighted shingles, banding and verification.

A text's shingles are its runs of five words, weighted by how often they occur. The
signature estimates the probability Jaccard similarity of two weighted sets; a second one,
with all weights 1, the plain Jaccard similarity. Equal bands of either give candidates;
candidates are verified on all their shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finsieve.llm.common import keyed, split_words, store, table, text_parts

SHINGLE = 5
THRESHOLD = 0.8
#: A pair at 0.8 shares no band with probability (1 - 0.8^5)^40 = 1e-7.
BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
#: Pairs whose signatures agree in less than this share are not verified; at 0.8 that
#: happens with probability below 1e-20.
LEAST_ESTIMATE = 0.4

_CACHED_WORDS = 300_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles_of(bags: list[list[bytes]], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count) of all texts, ordered by text and hash.

    A text of fewer words than ``size`` is one shingle; a text without words has none.
    """
    if len(_HASHES) > _CACHED_WORDS:
        _HASHES.clear()
    lengths = np.array([len(b) for b in bags], np.int64)
    flat = np.fromiter(
        map(_HASHES.__getitem__, (w for b in bags for w in b)), np.uint64, int(lengths.sum())
    )
    padded = np.concatenate([flat, np.zeros(size, np.uint64)])
    owner = np.repeat(np.arange(len(bags)), lengths)
    rank = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    starts = np.flatnonzero((rank + size <= lengths[owner]) | (rank == 0))
    room = lengths[owner[starts]] - rank[starts]
    h = np.zeros(len(starts), np.uint64)
    for k in range(size):
        word = np.where(room > k, padded[starts + k], np.uint64(0))
        h = _mixed(h * _STEP + word + np.uint64(k + 1))
    owner = owner[starts]
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return owner[at], h[at], np.diff(np.append(at, len(h)))


def signatures(owner: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """ProbMinHash: for every text and register the element with the earliest arrival.

    The arrivals of an element are a Poisson process with its weight as rate, each at a
    random register, all drawn from the element's hash. An element is through when its
    next arrival is later than the latest register of its text. All elements of all
    texts draw their n-th arrival together.
    """
    earliest = np.full(texts * REGISTERS, np.inf)
    winner = np.zeros(texts * REGISTERS, np.uint64)
    latest = np.full(texts, np.inf)
    owner, h = owner.astype(np.int64), h.copy()
    rate, at, n = weight.astype(float), np.zeros(len(h)), 0
    while len(h):
        n += 1
        draw = _mixed(h + np.uint64(int(_STEP) * n % 2**64))
        at = at - np.log(((draw >> np.uint64(11)).astype(float) + 1) * 2.0**-53) / rate
        register = (_mixed(draw ^ _STEP) >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)
        place = owner * REGISTERS + register.astype(np.int64)
        np.minimum.at(earliest, place, at)
        won = earliest[place] == at
        winner[place[won]] = h[won]
        # owner is sorted and stays so.
        alive = owner[np.flatnonzero(np.diff(owner, prepend=-1))]
        latest[alive] = earliest.reshape(texts, REGISTERS)[alive].max(axis=1)
        on = at < latest[owner]
        owner, h, rate, at = owner[on], h[on], rate[on], at[on]
    return (winner >> np.uint64(32)).astype("<u4").reshape(texts, REGISTERS)


def _set_signatures(owner: np.ndarray, h: np.ndarray, counts: np.ndarray, texts: int) -> list[bytes | None]:
    """Signatures with all counts 1, of texts that repeat a shingle; None where that changes nothing."""
    out: list[bytes | None] = [None] * texts
    repeats = np.unique(owner[counts > 1])
    if len(repeats):
        on = np.isin(owner, repeats)
        number = np.searchsorted(repeats, owner[on])
        raw = signatures(number, h[on], np.ones(len(number)), len(repeats))
        for text, row in zip(repeats.tolist(), raw):
            out[text] = row.tobytes()
    return out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column(2).to_pylist()]
        digests, signed, flat = [], [], []
        for part in text_parts(texts):
            words = [split_words(t) for t in texts[part]]
            digests += [hashlib.blake2b(b" ".join(b), digest_size=16).digest() for b in words]
            owner, h, counts = shingles_of(words)
            raw = signatures(owner, h, counts, len(words))
            signed += [row.tobytes() if b else None for row, b in zip(raw, words)]
            flat += _set_signatures(owner, h, counts, len(words))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array(digests, pa.binary()),
                pa.array(signed, pa.binary()), pa.array(flat, pa.binary()),
            ],
            names=["row_key", "doc_id", "words_digest", "signature", "set_signature"],
        )


def sketch(docs: DataFrame, key: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """row_key, doc_id, words_digest (of the word sequence), signature (null without words), set_signature.

    set_signature is null where it equals signature: in texts that repeat no shingle.
    """
    return docs.select(
        F.col(key).alias("row_key"), F.col(id_column).cast("long").alias("doc_id"),
        F.col(text_column).cast("string").alias("text"),
    ).mapInArrow(_sketches, "row_key long, doc_id long, words_digest binary, signature binary, set_signature binary")


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        hashes, counts = [], []
        for part in text_parts(texts):
            owner, h, c = shingles_of([split_words(t) for t in texts[part]])
            cuts = np.searchsorted(owner, np.arange(part.stop - part.start + 1))
            for a, b in zip(cuts, cuts[1:]):
                hashes.append(h[a:b].tobytes())
                counts.append(c[a:b].astype("<u4").tobytes() if (c[a:b] != 1).any() else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())],
            names=["node", "hashes", "counts"],
        )


def similarity(ha: np.ndarray, ca: np.ndarray, hb: np.ndarray, cb: np.ndarray) -> tuple[float, float]:
    """The exact probability Jaccard similarity by counts and the plain one of two shingle sets."""
    if not len(ha) or not len(hb):
        return 0.0, 0.0
    spot = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    both = hb[spot] == ha
    shared = int(both.sum())
    plain = shared / (len(ha) + len(hb) - shared)
    xa, xb = ca[both].astype(float), cb[spot[both]].astype(float)
    only_a, only_b = float(ca.sum() - xa.sum()), float(cb.sum() - xb.sum())
    total = 0.0
    ratios, number = np.unique(xb / xa, return_inverse=True)
    for i, ratio in enumerate(ratios):
        # Scaled so that this shingle weighs the same on both sides.
        most = np.maximum(xa, xb / ratio).sum() + only_a + only_b / ratio
        total += xa[number == i].sum() / most
    return total, plain


def _by_bytes(batch: pa.RecordBatch, columns: tuple[int, ...], most: int = 8_000_000) -> Iterator[slice]:
    """Slices of a batch whose values in ``columns`` together stay near ``most`` bytes; at least one row each."""
    start = size = 0
    for i in range(batch.num_rows):
        size += sum(len(batch.column(c)[i].as_buffer() or b"") for c in columns)
        if size >= most:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield slice(start, batch.num_rows)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def view(column: pa.Array, i: int, kind: str) -> np.ndarray | None:
        return np.frombuffer(column[i].as_buffer(), kind) if column[i].is_valid else None

    for batch in batches:
        good = []
        for i in range(batch.num_rows):
            ha, hb = view(batch.column(2), i, "<u8"), view(batch.column(4), i, "<u8")
            ca, cb = view(batch.column(3), i, "<u4"), view(batch.column(5), i, "<u4")
            ca = np.ones(len(ha), np.uint32) if ca is None else ca
            cb = np.ones(len(hb), np.uint32) if cb is None else cb
            if max(similarity(ha, ca, hb, cb)) >= THRESHOLD - 1e-12:
                good.append(i)
        yield pa.RecordBatch.from_arrays(
            [batch.column(i).take(pa.array(good, pa.int64())) for i in (0, 1)], names=["a", "b"]
        )


def _agreement(x: Column, y: Column) -> Column:
    """The share of registers in which two signatures agree."""
    same = F.filter(
        F.sequence(F.lit(0), F.lit(REGISTERS - 1)),
        lambda i: F.substring(x, 4 * i + 1, F.lit(4)) == F.substring(y, 4 * i + 1, F.lit(4)),
    )
    return F.size(same) / REGISTERS


def verify(pairs: DataFrame, nodes: DataFrame, shingles: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar: first by either signature, then exactly by shingles.

    The joins are on one end each; a node in very many pairs is split by AQE.
    """
    def ends(side: str, of: DataFrame, *columns: str) -> DataFrame:
        return of.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])

    signed = ("signature", "set_signature")
    as_sets = [F.coalesce(f"set_signature_{side}", f"signature_{side}") for side in "ab"]
    likely = (
        pairs.join(ends("b", nodes, *signed), "b").join(ends("a", nodes, *signed), "a")
        .where(
            (_agreement(F.col("signature_a"), F.col("signature_b")) >= LEAST_ESTIMATE)
            | (
                F.coalesce("set_signature_a", "set_signature_b").isNotNull()
                & (_agreement(*as_sets) >= LEAST_ESTIMATE)
            )
        )
        .select("a", "b")
    )
    likely = store(likely, "likely-pairs")
    rows = (
        likely.join(ends("b", shingles, "hashes", "counts"), "b")
        .join(ends("a", shingles, "hashes", "counts"), "a")
        .select("a", "b", "hashes_a", "counts_a", "hashes_b", "counts_b")
    )
    return store(rows.mapInArrow(_verified, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component, for nodes with links.

    Smallest labels travel along the links; then each label is replaced by its own
    label, which halves the way that is left.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        heard = (
            both.join(labels.withColumnRenamed("node", "a"), "a")
            .groupBy(F.col("b").alias("node")).agg(F.min("label").alias("heard"))
        )
        lower = store(
            labels.join(heard, "node").select("node", F.least("label", "heard").alias("label"), F.col("label").alias("old")),
            "labels",
        )
        up = lower.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = store(lower.join(up, "label").select("node", F.col("top").alias("label"), "old"), "labels")
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def band_keys(nodes: DataFrame) -> DataFrame:
    """(key, node): one row per node and distinct band of its two signatures.

    Both kinds share their keys: a text that repeats no shingle has one signature for both,
    and has to meet the counts of some texts and the sets of others.
    """
    width = 4 * ROWS

    def bands(column: str) -> Column:
        return F.array(
            *[F.xxhash64(F.lit(b), F.substring(column, width * b + 1, width)) for b in range(BANDS)]
        )

    keys = F.when(F.col("set_signature").isNull(), bands("signature")).otherwise(
        F.array_union(bands("signature"), bands("set_signature"))
    )
    return nodes.select(F.explode(keys).alias("key"), "node")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = batch.column(0).to_pylist()
        raw, counted = batch.column(1), batch.column(2)
        for part in _by_bytes(batch, (1,)):
            hashes = [np.frombuffer(raw[i].as_buffer(), "<i8") for i in range(part.start, part.stop)]
            counts = [
                np.frombuffer(counted[i].as_buffer(), "<u4") if counted[i].is_valid else np.ones(len(h), np.uint32)
                for i, h in zip(range(part.start, part.stop), hashes)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array(nodes[part], np.int64), [len(h) for h in hashes])),
                    pa.array(np.concatenate(hashes)), pa.array(np.concatenate(counts).astype(np.int32)),
                ],
                names=["node", "shingle", "count"],
            )


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [
        "shingle", "node", "label", "size", "at", "weight", "before",
        "short_sets", "by_sets", "short_counts", "by_counts", "repeats",
    ]
    for batch in batches:
        if not batch.num_rows:
            continue
        node, label, size, weight = (batch.column(i).to_numpy() for i in range(4))
        # One row per shared shingle, the rarest of each node first.
        cuts = batch.column(4).offsets.to_numpy()
        cuts, flat = cuts - cuts[0], batch.column(4).flatten()
        shingle, count = flat.field(1).to_numpy(), flat.field(2).to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(node)), np.diff(cuts))
        sums = np.concatenate([[0], np.cumsum(count)])
        at = np.arange(len(owner)) - cuts[owner] + (size - np.diff(cuts))[owner]
        before = sums[:-1] - sums[cuts[:-1]][owner] + (weight - (sums[cuts[1:]] - sums[cuts[:-1]]))[owner]
        by_sets = 5 * at <= size[owner]
        by_counts = 5 * before <= weight[owner]
        on = np.flatnonzero(by_sets | by_counts)
        who = owner[on]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(x) for x in (
                    shingle[on], node[who], label[who], size[who], at[on], weight[who], before[on],
                    9 * at[on] <= size[who], by_sets[on], 9 * before[on] <= weight[who], by_counts[on],
                    (weight != size)[who],
                )
            ],
            names=names,
        )


def rare_pairs(nodes: DataFrame, shingles: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``nodes`` (node, label) with different labels that may be similar; none is missed.

    All shingles are put in one order, by the number of nodes that hold them, then by
    hash. A pair with plain Jaccard of 0.8 shares 4/9 of the sum of both sizes, so the first
    shingle both have is among the first fifth of the larger text's and the first ninth of
    the smaller one's, and enough is left behind it. Where the other text lacks shares u and
    v of the two weights, probability Jaccard is at most (1-u)(1-v)/(1-uv); what stands
    before the first common shingle is lacking, so that is at most a fifth of either weight
    and at most a ninth of one. (For a common shingle i the reciprocal of its term is at
    least 1/p_i + v/q_i; the terms are concave in p and q, so their sum is at most that of
    the sums.) Where no shingle repeats, both measures are the same. A text with over a
    fifth of its own words meets nobody.
    """
    own = shingles.join(nodes.select("node"), "node")
    opened = store(own.mapInArrow(_opened, "node long, shingle long, count int"), "member-shingles")
    common = opened.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    totals = opened.groupBy("node").agg(
        F.count(F.lit(1)).alias("size"), F.sum(F.col("count").cast("long")).alias("weight")
    )
    shared = (
        opened.join(common, "shingle").groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct("n", "shingle", "count"))).alias("shared"))
    )
    prefixes = store(
        totals.join(shared, "node").join(nodes, "node")
        .where("5 * (size - size(shared)) <= size OR size <> weight")
        .select("node", "label", "size", "weight", "shared")
        .mapInArrow(
            _prefixes,
            "shingle long, node long, label long, size long, at long, weight long, before long, "
            "short_sets boolean, by_sets boolean, short_counts boolean, by_counts boolean, repeats boolean",
        ),
        "prefixes",
    )
    # Nodes of the largest class under a shingle never meet each other there.
    several = (
        prefixes.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("shingle").agg(F.max(F.struct("n", "label")).alias("top"), F.count(F.lit(1)).alias("labels"))
        .where("labels > 1").select("shingle", F.col("top.label").alias("top"))
    )
    rows = prefixes.join(several, "shingle").withColumn("top", F.col("label") == F.col("top"))
    x = rows.where("short_sets OR short_counts").alias("x")
    y = rows.withColumn(
        "meets_top", F.explode(F.when(F.col("top"), F.array(F.lit(False))).otherwise(F.array(F.lit(True), F.lit(False))))
    ).alias("y")
    by_sets = F.expr(
        "x.short_sets AND y.by_sets AND (x.size < y.size OR x.size = y.size AND x.node < y.node) "
        "AND 9 * least(x.size - x.at, y.size - y.at) >= 4 * (x.size + y.size)"
    )
    by_counts = F.expr(
        "(x.repeats OR y.repeats) AND x.short_counts AND y.by_counts "
        "AND 5 * (x.weight - x.before) * (y.weight - y.before) >= 4 * (x.weight * y.weight - x.before * y.before)"
    )
    return (
        x.join(y, F.expr("x.shingle = y.shingle AND x.top = y.meets_top AND x.label <> y.label") & (by_sets | by_counts))
        .select(F.expr("least(x.node, y.node)").alias("a"), F.expr("greatest(x.node, y.node)").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, key: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: row_key, doc_id, class_id, class_size, kept.

    Two rows are linked when their shingles' probability Jaccard similarity by counts,
    or their plain Jaccard similarity, is at least 0.8; a class is all that hangs
    together by links. class_id is the smallest doc_id of the class (null only if all its ids
    are null) and that row alone is kept; among equal ids, one row. Texts with the same
    words are linked, also those without any word (null, empty, blank); other texts of
    fewer than five words are one shingle, so they are similar only when equal.

    Equal texts are one node from the start. In a bucket every node is compared with the
    smallest one. Only nodes of buckets that then hold different classes are looked at
    again, by :func:`rare_pairs`. So a group of very many copies is never paired with
    itself, nor are texts that share one common passage.
    """
    rows = store(sketch(docs, key, id_column, text_column), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")
    nodes = store(
        rows.groupBy("words_digest")
        .agg(
            F.min(first).alias("first"), F.first("signature").alias("signature"),
            F.first("set_signature").alias("set_signature"),
        )
        .select("words_digest", F.col("first.row_key").alias("node"), "signature", "set_signature"),
        "nodes",
    )
    signed = nodes.where("signature IS NOT NULL").select("node", "signature", "set_signature")
    keys = band_keys(signed)
    leads = keys.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = store(keys.join(leads, "key").select("key", "node", "lead"), "buckets")

    wanted = buckets.select("node").distinct()
    texts = docs.select(F.col(key).alias("node"), F.col(text_column).cast("string").alias("text"))
    shingles = store(
        texts.join(wanted, "node").mapInArrow(_shingle_rows, "node long, hashes binary, counts binary"),
        "shingles",
    )
    stars = (
        buckets.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    )
    links = verify(stars, signed, shingles)
    labels = components(links)

    named = buckets.join(labels, "node", "left").select(
        "key", "node", F.coalesce("label", "node").alias("label")
    )
    mixed = (
        named.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"))
        .where("least <> most").select("key")
    )
    inside = store(named.join(mixed, "key").select("node", "label").distinct(), "mixed-nodes")
    across = rare_pairs(inside, shingles)
    more = verify(across, signed, shingles)
    labels = components(links.union(more))

    node_labels = nodes.join(labels, "node", "left").select(
        "words_digest", F.coalesce("label", "node").alias("label")
    )
    placed = store(rows.drop("signature", "set_signature").join(node_labels, "words_digest").drop("words_digest"), "placed")
    classes = store(
        placed.groupBy("label").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("class_size"))
        .select(
            "label", F.col("first.doc_id").alias("class_id"),
            F.col("first.row_key").alias("kept_row"), "class_size",
        ),
        "classes",
    )
    return placed.join(classes, "label").select(
        "row_key", "doc_id", "class_id", "class_size", (F.col("row_key") == F.col("kept_row")).alias("kept")
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class of near-duplicates, with the columns it came with."""
    rows, key = keyed(docs)
    gone = near_duplicates(rows, key).where(~F.col("kept")).select(F.col("row_key").alias(key))
    return rows.join(gone, key, "left_anti").select(*docs.columns)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, key = keyed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return near_duplicates(docs, key).drop("row_key")
