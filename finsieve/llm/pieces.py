"""SentencePiece encoding and decoding over a lattice of pieces per word.

For every distinct word the substrings of bounded length are looked up in the piece table;
those found are the edges of the word's lattice, and the best segmentation is folded over the
edges: by score for unigram models (Viterbi), in the order of merges for BPE models, whose
scores are merge ranks. Characters that no piece covers become byte pieces. Words are encoded
once per Python worker and remembered.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsieve.llm.common import table, text_parts

SPACE = "▁"
#: Spaces belong to the word behind them; no piece joins a character with a space or a
#: line feed behind it.
_WORDS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
_CACHED_WORDS = 400_000
_SHORT = 64
_CODECS: dict[tuple[str, str], PieceCodec] = {}


class PieceCodec:
    """The piece table of a model file, and the ids of words seen lately."""

    def __init__(self, path: str, kind: str = "bpe"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind, size = kind, model.get_piece_size()
        self.byte_id, self.table, self.raw = {}, {}, []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.raw.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i):
                self.raw.append(b"")
            else:
                if not model.is_unknown(i):
                    self.table[piece] = (i, model.get_score(i))
                self.raw.append(piece.replace(SPACE, " ").encode())
        self.rank = {piece: -score for piece, (_, score) in self.table.items()}
        self.none = float("inf")
        self.longest = max(map(len, self.table))
        self.spaced: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str, kind: str = "bpe") -> PieceCodec:
        if (path, kind) not in _CODECS:
            _CODECS[path, kind] = cls(path, kind)
        return _CODECS[path, kind]

    def edges(self, word: str) -> dict[tuple[int, int], tuple[int, float]]:
        """The lattice: (start, end) of every substring that is a piece, with id and score."""
        known, longest, n = self.table, self.longest, len(word)
        return {
            (a, b): found
            for a in range(n)
            for b in range(a + 1, min(a + longest, n) + 1)
            if (found := known.get(word[a:b])) is not None
        }

    def _merged(self, word: str) -> list[tuple[int, int]]:
        """BPE: always join the two neighbours whose edge ranks best, the leftmost of equals."""
        return self._merged_short(word) if len(word) <= _SHORT else self._merged_long(word)

    def _merged_long(self, word: str) -> list[tuple[int, int]]:
        """With a queue of all edges that join two neighbours."""
        edges, n = self.edges(word), len(word)
        following, before = list(range(1, n + 1)), list(range(-1, n))
        queue: list[tuple[float, int, int, int]] = []

        def offer(a: int, middle: int, b: int) -> None:
            if (a, b) in edges:
                heapq.heappush(queue, (-edges[a, b][1], a, middle, b))

        for a in range(n - 1):
            offer(a, a + 1, a + 2)
        while queue:
            _, a, middle, b = heapq.heappop(queue)
            if following[a] != middle or middle >= n or following[middle] != b:
                continue
            following[a], following[middle] = b, -1
            if b < n:
                before[b] = a
                offer(a, b, following[b])
            if a:
                offer(before[a], a, b)
        cuts, at = [], 0
        while at < n:
            cuts.append((at, following[at]))
            at = following[at]
        return cuts

    def _merged_short(self, word: str) -> list[tuple[int, int]]:
        """With a list of the ranks of all neighbours: quicker for few of them."""
        get, none = self.rank.get, self.none
        cuts = list(range(len(word) + 1))
        ranks = [get(word[a : a + 2], none) for a in range(len(word) - 1)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            del cuts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(word[cuts[i - 1] : cuts[i + 1]], none)
            if i < len(ranks):
                ranks[i] = get(word[cuts[i] : cuts[i + 2]], none)
        return list(zip(cuts, cuts[1:]))

    def _viterbi(self, word: str) -> list[tuple[int, int]]:
        """Unigram: the way through the lattice with the largest sum of scores; uncovered
        characters are edges of their own, worse than any piece."""
        edges, n = self.edges(word), len(word)
        least = min((s for _, s in self.table.values()), default=0.0) - 10
        best: list[tuple[float, int]] = [(0.0, 0)] + [(-np.inf, 0)] * n
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                edge = edges.get((start, end))
                score = edge[1] if edge else least if start == end - 1 else -np.inf
                if best[start][0] + score > best[end][0]:
                    best[end] = (best[start][0] + score, start)
        cuts, at = [], n
        while at:
            cuts.append((best[at][1], at))
            at = best[at][1]
        return cuts[::-1]

    def _word(self, word: str) -> bytes:
        ids: list[int] = []
        for a, b in self._merged(word) if self.kind == "bpe" else self._viterbi(word):
            found = self.table.get(word[a:b])
            if found:
                ids.append(found[0])
            else:
                ids += [self.byte_id[x] for x in word[a:b].encode("utf-8", "surrogatepass")]
        return np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit bytes."""
        if len(self.spaced) + len(self.bare) > _CACHED_WORDS:
            self.spaced, self.bare = {}, {}
        out, line = [], self._word("\n")
        for text in texts:
            words = text.split()
            # A space that was a SPACE mark already, or more blanks, takes the general way.
            if words and SPACE not in text and " ".join(words) == text.replace("\n", " "):
                spaced = self.spaced
                for w in set(words).difference(spaced):
                    spaced[w] = self._word(SPACE + w)
                parts = list(map(spaced.__getitem__, words))
                at = 0
                for row in text.split("\n")[:-1]:
                    at += row.count(" ") + 1
                    parts[at] = line + self._bare(words[at])
                out.append(b"".join(parts))
            else:
                marked = SPACE + text.replace(" ", SPACE) if text else ""
                out.append(b"".join(map(self._bare, _WORDS.findall(marked))))
        return out

    def _bare(self, word: str) -> bytes:
        if word not in self.bare:
            self.bare[word] = self._word(word)
        return self.bare[word]

    def decode(self, ids: bytes) -> str:
        """The text of ids; the space that encoding put in front goes again."""
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace")[1:]


def encode(
    docs: DataFrame, model: str, kind: str = "bpe", id_column: str = "doc_id", text_column: str = "text",
    also_decoded: bool = False,
) -> DataFrame:
    """doc_id, text and ids (bytes, little-endian unsigned 32-bit) of every row, in one pass.

    ``also_decoded`` adds what the ids decode to, made by the same Python worker.

    A null or empty text has no ids. No white space is dropped or changed, except that the
    character U+2581 is encoded like a space.
    """
    names = ["doc_id", "text", "ids", *["decoded"] * also_decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec.at(model, kind)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in text_parts(texts):
                ids = codec.encode(texts[part])
                columns = [
                    batch.column(0).slice(part.start, part.stop - part.start),
                    pa.array(texts[part], pa.string()), pa.array(ids, pa.binary()),
                ]
                if also_decoded:
                    columns.append(pa.array([codec.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string, ids binary" + ", decoded string" * also_decoded)


def decode(coded: DataFrame, model: str, kind: str = "bpe") -> DataFrame:
    """``coded`` (with a column ids) and the column decoded; null ids give a null text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec.at(model, kind)
        for batch in batches:
            ids = batch.column(batch.schema.names.index("ids")).to_pylist()
            text = pa.array([None if x is None else codec.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, "decoded"])

    coded = coded.drop("decoded")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields)
    return coded.mapInArrow(run, f"{fields}, decoded string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of pieces and their checksum, and whether decoding gives the text back."""
    path = model_path()
    coded = encode(table(spark, sf_dir, "documents"), path, also_decoded=True)
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"),
        (F.col("decoded") == F.translate("text", SPACE, " ")).alias("round_trip"),
    )
