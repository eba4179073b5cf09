"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded by one
hidden layer over measured features; a gated attention gives each passage a weight, and
the weighted sum of the encodings is scored. Only documents have labels: the weights of
passages are learned through them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finsieve.llm.common import free_name, split_words, store, table
from finsieve.llm.quality_rules import STOP_WORDS

PASSAGE = 100
#: The model is fitted on at most so many labelled rows, in hash order, and on no further row
#: once their passages are this many. Of a row that takes part every passage is encoded, as
#: scoring does with all rows.
TRAIN_DOCS = 4000
TRAIN_PASSAGES = 200_000
HIDDEN, GATES, EPOCHS, SEED = 24, 12, 40, 7
THRESHOLD = 0.3

_SYMBOLS = frozenset(b"#*$%&|<>")
_STOPS = frozenset(w.encode() for w in STOP_WORDS)
_WORD_MEASURES = 10
_PASSAGE_MEASURES = _WORD_MEASURES + 6
_CACHED_WORDS = 300_000


def _word_row(word: bytes) -> tuple[float, ...]:
    text = word.decode("utf-8", "replace")
    letters = sum(c.isalpha() for c in text)
    upper = sum(c.isupper() for c in text)
    return (
        len(text), letters, upper, sum(c.isdigit() for c in text),
        sum(b in _SYMBOLS for b in word), sum(c in "!?" for c in text),
        sum(c in ".,;:" for c in text), word in _STOPS,
        letters > 1 and upper == letters, letters == 0,
    )


class PassageMeasures:
    """Feature rows of passages; numbers words once and looks their measures up by number."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.rows: list[tuple[float, ...]] = []
        self.matrix = np.zeros((0, _WORD_MEASURES), np.float32)

    def _numbered(self, words: list[bytes]) -> np.ndarray:
        if len(self.numbers) > _CACHED_WORDS:
            self.__init__()
        numbers = self.numbers
        for word in set(words).difference(numbers):
            numbers[word] = len(self.rows)
            self.rows.append(_word_row(word))
        if len(self.rows) > len(self.matrix):
            fresh = np.array(self.rows[len(self.matrix) :], np.float32)
            self.matrix = np.concatenate([self.matrix, fresh])
        return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Feature rows of all passages, and each text's number of passages (at least 1)."""
        bags = [split_words(t) for t in texts]
        n_words = np.array([len(b) for b in bags], np.int64)
        lines = np.array([(t or "").count("\n") for t in texts], np.float32)
        counts = np.maximum(1, -(-n_words // PASSAGE))
        owner = np.repeat(np.arange(len(bags)), counts)
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        sizes = np.minimum(PASSAGE, n_words[owner] - rank * PASSAGE)
        flat = self._numbered([w for b in bags for w in b])
        out = np.zeros((len(owner), _PASSAGE_MEASURES), np.float32)
        place = np.repeat(np.arange(len(owner)), sizes)
        full = np.flatnonzero(sizes)
        if len(flat):
            starts = (np.cumsum(sizes) - sizes)[full]
            out[full, :_WORD_MEASURES] = np.add.reduceat(self.matrix[flat], starts, axis=0)
            # Different words, and words equal to the one before, within the passage.
            order = np.lexsort((flat, place))
            p, w = place[order], flat[order]
            new = np.ones(len(p), bool)
            new[1:] = (p[1:] != p[:-1]) | (w[1:] != w[:-1])
            out[:, _WORD_MEASURES] = np.bincount(p[new], minlength=len(owner))
            again = np.zeros(len(p), bool)
            again[1:] = (flat[1:] == flat[:-1]) & (place[1:] == place[:-1])
            out[:, _WORD_MEASURES + 1] = np.bincount(place[again], minlength=len(owner))
        size = np.maximum(sizes, 1).astype(np.float32)[:, None]
        chars = np.maximum(out[:, :1], 1)
        per_char = out[:, 1:7] / chars
        per_word = np.concatenate([out[:, :1] / (10 * size), out[:, 7:12] / size], axis=1)
        context = np.stack(
            [
                np.log1p(sizes) / 5, np.log1p(n_words[owner]) / 10,
                lines[owner] / np.maximum(n_words[owner], 1), n_words[owner] == 0,
            ],
            axis=1,
        )
        return np.concatenate([per_char, per_word, context], axis=1).astype(np.float32), counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class GatedAttention:
    """relu encoder, attention softmax(w . (tanh(V h) * sigmoid(U h))), logistic output."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        x = (x - self.mean) / self.scale
        h = np.maximum(0, x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (t * g) @ p["w"]
        starts = np.cumsum(counts) - counts
        bag = np.repeat(np.arange(len(counts)), counts)
        s = np.exp(s - np.maximum.reduceat(s, starts)[bag])
        a = s / np.add.reduceat(s, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        y = _sigmoid(z @ p["c"] + p["b"])
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "y": y, "bag": bag, "starts": starts}

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.forward(x, counts)["y"]

    def attention(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.forward(x, counts)["a"]

    def gradients(self, x: np.ndarray, counts: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.weights, self.forward(x, counts)
        d_out = (f["y"] - label) / len(label)
        d_z = (d_out[:, None] * p["c"])[f["bag"]]
        d_a = (d_z * f["h"]).sum(1)
        mean_d = np.add.reduceat(f["a"] * d_a, f["starts"])[f["bag"]]
        d_s = f["a"] * (d_a - mean_d)
        d_tg = d_s[:, None] * p["w"]
        d_t, d_g = d_tg * f["g"] * (1 - f["t"] ** 2), d_tg * f["t"] * f["g"] * (1 - f["g"])
        d_h = f["a"][:, None] * d_z + d_t @ p["V"].T + d_g @ p["U"].T
        d_h = d_h * (f["h"] > 0)
        return {
            "E": f["x"].T @ d_h, "e": d_h.sum(0), "V": f["h"].T @ d_t, "U": f["h"].T @ d_g,
            "w": (f["t"] * f["g"]).T @ d_s, "c": f["z"].T @ d_out, "b": np.array(d_out.sum()),
        }

    @classmethod
    def fit(cls, x: np.ndarray, counts: np.ndarray, label: np.ndarray) -> GatedAttention:
        """Adam on the logistic loss, with fixed seeds: the same bags give the same model."""
        rng = np.random.default_rng(SEED)
        d = x.shape[1]
        p = {
            "E": rng.normal(0, math.sqrt(2 / d), (d, HIDDEN)), "e": np.zeros(HIDDEN),
            "V": rng.normal(0, 0.3, (HIDDEN, GATES)), "U": rng.normal(0, 0.3, (HIDDEN, GATES)),
            "w": rng.normal(0, 0.3, GATES), "c": rng.normal(0, 0.3, HIDDEN), "b": np.zeros(()),
        }
        model = cls(x.mean(0), x.std(0) + 1e-3, p)
        first = np.cumsum(counts) - counts
        m = {k: np.zeros_like(v) for k, v in p.items()}
        v = {k: np.zeros_like(v) for k, v in p.items()}
        step = 0
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(len(counts)), max(1, len(counts) // 64)):
                step += 1
                rows = np.concatenate([np.arange(first[i], first[i] + counts[i]) for i in part])
                for k, g in model.gradients(x[rows], counts[part], label[part]).items():
                    g = g + 1e-4 * p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - 0.005 * (m[k] / (1 - 0.9**step)) / (
                        np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8
                    )
        return model


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (doc_id, text, quality) of at most TRAIN_DOCS labelled ids in hash order.

    Only ids whose crc32 (of the id as text) mod 5 is not 0 take part; null or
    contradictory labels of an id do not.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .where("quality = most").drop("most")
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = texts.select("doc_id").join(known, "doc_id").dropDuplicates(["doc_id"])
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    return texts.join(F.broadcast(chosen), "doc_id")


def _bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    measures = PassageMeasures()
    for batch in batches:
        x, counts = measures(batch["text"].tolist())
        out = []
        for rows in np.split(x, np.cumsum(counts)[:-1]):
            out.append(rows.astype("<f4").tobytes())
        yield pd.DataFrame({
            "doc_id": batch["doc_id"], "quality": batch["quality"], "n_passages": counts, "bag": out,
        })


def train(docs: DataFrame, labels: DataFrame) -> GatedAttention | float:
    """The fitted model, or the share of label 1 (0.5 without labels) if one class is missing.

    Rows that share an id count one by one. What reaches the driver is bounded by TRAIN_DOCS
    rows, and by TRAIN_PASSAGES passages and those of the row that reaches that number.
    """
    bags = training_rows(docs, labels).mapInPandas(
        _bags, "doc_id long, quality int, n_passages long, bag binary"
    )
    drawn = store(bags, "bags").orderBy(F.xxhash64("doc_id"), "doc_id", "bag").limit(TRAIN_DOCS)
    # One window over at most TRAIN_DOCS rows.
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "bag").rowsBetween(Window.unboundedPreceding, -1)
    taken = drawn.withColumn("before", F.coalesce(F.sum("n_passages").over(before), F.lit(0)))
    found = (
        taken.where(F.col("before") < TRAIN_PASSAGES).select("doc_id", "quality", "bag")
        .orderBy("doc_id", "bag").toPandas()
    )
    label = found["quality"].to_numpy(float)
    if len(np.unique(label)) < 2:
        return float(label[0]) if len(label) else 0.5
    rows = [np.frombuffer(b, "<f4").reshape(-1, _PASSAGE_MEASURES) for b in found["bag"]]
    return GatedAttention.fit(np.concatenate(rows), np.array([len(r) for r in rows]), label)


def with_score(docs: DataFrame, model: GatedAttention | float, name: str, text_column: str = "text") -> DataFrame:
    """``docs`` with the probability of label 1 in column ``name``, from the text alone.

    A null, empty or blank text is a bag of one empty passage.
    """
    if isinstance(model, float):
        return docs.withColumn(name, F.lit(model))

    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        measures = PassageMeasures()
        for part in parts:
            texts = part.tolist()
            out = [np.zeros(0)]
            for at in range(0, len(texts), 500):
                out.append(model.score(*measures(texts[at : at + 500])))
            yield pd.Series(np.concatenate(out))

    score = F.pandas_udf(scored, "double")
    return docs.withColumn(name, score(F.col(text_column).cast("string")))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, with their columns."""
    name = free_name(docs, "quality_score")
    rows = with_score(docs, train(docs, labels), name)
    return rows.where(F.col(name) >= threshold).select(*docs.columns)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return with_score(docs, model, "score").select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
