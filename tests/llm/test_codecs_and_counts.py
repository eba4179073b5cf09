import random

import numpy as np
import sentencepiece

from finsieve.llm.common import store
from finsieve.llm.packing import ChunkEncoder, tokenizer_path
from finsieve.llm.pieces import PieceCodec, decode, encode, model_path
from finsieve.llm.token_counts import CountedText, SumTree, apply_edits, build, drawn_edits, leaves_of, with_edits

from helpers import awkward, documents, prose

ODD = ["", " ", "  a  b ", " x", "x ", "a\n", "\n\na", "▁x y", "日本語 语", "\U0001f600é é​", "a\tb c", "\x1c \x85", "ab" * 300]


def noise(seed, n=25):
    rng = random.Random(seed)
    return "".join(rng.choice("ab  \n\tétheinging▁日\U0001f600") for _ in range(n))


def test_piece_ids_are_those_of_the_library():
    model = sentencepiece.SentencePieceProcessor(model_file=model_path())
    codec = PieceCodec.at(model_path())
    texts = ODD + [noise(i) for i in range(800)] + [prose(1, 300), noise(9, 400).replace(" ", "")]
    for text, ids in zip(texts, codec.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(text)
        assert codec.decode(ids) == text.replace("▁", " ")


def test_both_ways_of_merging_and_viterbi_agree_with_brute_force():
    codec = PieceCodec.at(model_path())
    for seed in range(200):
        word = "▁" + noise(seed, 14).replace(" ", "")
        assert codec._merged_long(word) == codec._merged_short(word)
    unigram = PieceCodec(model_path(), "unigram")
    for word in ["▁the", "tion", "▁hations"]:
        cuts = unigram._viterbi(word)
        assert cuts[0][0] == 0 and cuts[-1][1] == len(word)
        score = sum(unigram.edges(word)[c][1] for c in cuts)

        def ways(at):
            if at == len(word):
                yield 0.0
            for (a, b), (_, s) in unigram.edges(word).items():
                if a == at:
                    for rest in ways(b):
                        yield s + rest

        assert score == max(ways(0))


def test_spark_round_trip(spark):
    rows = awkward() + [(60 + i, t) for i, t in enumerate(ODD)]
    out = decode(encode(documents(spark, rows), model_path()), model_path()).collect()
    assert len(out) == len(rows)
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in out)
    assert encode(documents(spark, []), model_path()).count() == 0


def test_sum_tree_finds_leaves():
    tree = SumTree([3, 0, 2, 5])
    assert [tree.find(p) for p in (0, 2, 3, 4, 5, 9)] == [(0, 0), (0, 0), (2, 3), (2, 3), (3, 5), (3, 5)]
    tree.set(0, 1)
    assert tree.total() == 8 and tree.find(1) == (2, 1)


def test_counts_after_edits_are_those_of_the_whole_text():
    encode_all = ChunkEncoder.at(tokenizer_path())
    rng = random.Random(3)
    again = whole = 0
    for text in ODD + [prose(i, 400) for i in range(40)]:
        sizes, tokens = leaves_of(encode_all, [text])[0]
        cuts = np.cumsum([0, *sizes]).tolist()
        counted = CountedText(encode_all, [text[a:b] for a, b in zip(cuts, cuts[1:])], list(tokens))
        for _ in range(8):
            at, gone = rng.randrange(len(text) + 1), rng.choice([0, 1, 5, 300])
            new = rng.choice(["", " ", "x", " foo bar", "\n", " a  b ", "\x1c", "é"])
            counted.edit(at, gone, new)
            text = text[:at] + new + text[at + gone :]
            assert counted.n_tokens() == len(encode_all.tokenizer.encode(text, add_special_tokens=False).ids)
        again, whole = again + counted.encoded_chars, whole + 8 * len(text)
        new_text, sizes, tokens = counted.state()
        assert (new_text, sum(sizes), sum(tokens)) == (text, len(text), counted.n_tokens())
    assert again < whole / 2


def test_spark_states_take_one_batch_of_edits_after_another(spark):
    rows = [(n, t) for n, (_, t) in enumerate(awkward())]
    path = tokenizer_path()
    state = store(build(documents(spark, rows), path), "test-state")
    assert state.count() == len(rows)
    first = store(apply_edits(state.withColumn("edits", drawn_edits()), path), "test-state")
    edits = spark.createDataFrame(
        [(0, 2, 0, 4, "zz"), (0, 1, 3, None, " new words "), (1, 1, None, 2, None), (99, 1, 0, 0, "x")],
        "doc_id long, seq int, offset long, deleted long, inserted string",
    )
    second = apply_edits(with_edits(first.drop("tokens_before", "encoded_chars"), edits), path).collect()
    tokenizer = ChunkEncoder.at(path).tokenizer
    before = {r.doc_id: r for r in first.collect()}
    assert len(second) == len(rows)
    for r in second:
        assert r.n_tokens == len(tokenizer.encode(r.text, add_special_tokens=False).ids) == sum(r.leaf_tokens)
        assert r.tokens_before == before[r.doc_id].n_tokens
    text = before[0].text
    text = text[:3] + " new words " + text[3:]
    assert {r.doc_id: r.text for r in second}[0] == "zz" + text[4:]
    assert build(documents(spark, []), path).count() == 0
