import random
import struct
import zlib

from finsieve.llm.packing import (
    CAPACITY,
    ChunkEncoder,
    OpenBins,
    best_fit,
    encode_pieces,
    pack_documents,
    tokenizer_path,
)

from helpers import awkward, documents, prose


def reference_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_chunks_have_the_ids_of_the_whole_text():
    rng = random.Random(4)
    texts = ["".join(rng.choice(" \n\t\x1c\x85 a1'!.s日　") for _ in range(30)) for _ in range(1500)]
    texts += ["", " ", "a b\nc d", "<|endoftext|> x", "it's  we'll", prose(3, 50)]
    codes = ChunkEncoder.at(tokenizer_path())(texts)
    assert [list(struct.unpack(f"<{len(c) // 4}I", c)) for c in codes] == reference_ids(texts)


def test_pieces_rebuild_the_documents(spark):
    rows = [(n, t) for n, (_, t) in enumerate(awkward())]
    found = {}
    for r in encode_pieces(documents(spark, rows), tokenizer_path()).collect():
        assert len(r.ids) == 4 * r.length and 0 < r.length <= CAPACITY
        found.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, bytes(r.ids)))
    for (i, _), ids in zip(rows, reference_ids([t for _, t in rows])):
        pieces = sorted(found[i])
        code = b"".join(p[3] for p in pieces)
        assert list(struct.unpack(f"<{len(code) // 4}I", code)) == [*ids, 0]
        assert [p[0] for p in pieces] == list(range(len(pieces)))
        assert [p[1] for p in pieces] == [sum(q[2] for q in pieces[:k]) for k in range(len(pieces))]
        assert all(p[2] == CAPACITY for p in pieces[1:])


def test_sequences_have_no_gaps_and_few_are_needed(spark):
    rows = awkward() + [(100 + i, prose(i, random.Random(i).randrange(1, 700))) for i in range(400)]
    out = pack_documents(documents(spark, rows), tokenizer_path()).collect()
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= CAPACITY
    total = sum(r.length for r in out)
    assert len(bins) <= 1.03 * total / CAPACITY + 2
    crc = {(r.doc_id, r.piece): r.ids_crc32 for r in out}
    ids = reference_ids([rows[-1][1]])[0] + [0]
    cut = len(ids) % CAPACITY or CAPACITY
    assert crc[rows[-1][0], 0] == zlib.crc32(struct.pack(f"<{cut}I", *ids[:cut]))


def test_bins_choose_the_tightest_and_close_the_fullest():
    bins = OpenBins(10, 2)
    assert [bins.place(s) for s in (6, 7, 3)] == [(0, 0), (1, 0), (1, 7)]
    assert bins.place(5) == (2, 0)
    # Three would be open now (4, 5 and 2 left): the fullest closes.
    assert bins.place(8) == (3, 0) and bins.open == 2
    assert bins.place(2) == (0, 6)


def test_empty_table_clashing_names_and_bad_lengths(spark):
    import pytest

    assert pack_documents(documents(spark, []), tokenizer_path()).count() == 0
    pieces = spark.createDataFrame([(1, 0, 5, "x", 9)], "row_key long, piece int, length long, note string, offset int")
    (row,) = best_fit(pieces).collect()
    assert (row.note, row.offset) == ("x", 0)
    with pytest.raises(Exception, match="1 to 2048 tokens"):
        best_fit(spark.createDataFrame([(1, 0, 5000)], "row_key long, piece int, length long")).collect()
