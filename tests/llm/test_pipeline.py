import random
import re
import struct
import zlib

import corpus_pipeline
from finsieve.llm.packing import CAPACITY, ChunkEncoder, tokenizer_path
from finsieve.llm.quality_model import THRESHOLD, PassageMeasures, train

from helpers import components, documents, prose, words
from test_near_dedup import counted, similarity
from test_substring_dedup import expected


def corpus():
    rng = random.Random(11)
    passages = [prose(500 + i, 50, 5000) for i in range(4)]
    rows = []
    for i in range(120):
        text = "the of and " + prose(i, rng.randrange(40, 250), 5000)
        if i % 6 == 0:
            text = text.replace(" ", "### ")
        if i % 5 == 0:
            text += "\n" + rng.choice(passages)
        rows.append((i, text))
    for i in range(0, 60, 3):
        copy = rows[i][1].split(" ")
        copy[len(copy) // 2] = "edit"
        rows += [(200 + i, rows[i][1].replace(" ", "  ")), (300 + i, " ".join(copy))]
    rows += [(400, None), (401, ""), (402, " "), (403, prose(7, 9000, 5000))]
    return rows


def test_each_stage_does_its_work_on_what_is_left(spark, tmp_path):
    rows = corpus()
    docs = documents(spark, rows, extra=False)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    marks = [(i, int("###" not in (t or "")), 0) for i, t in rows if i < 400]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "substrings", "pack"]
    left, results = docs, []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, left, str(tmp_path)).write.parquet(path)
        left = spark.read.parquet(path)
        results.append(left.collect())
        if name != "pack":
            assert left.columns == docs.columns
    quality, exact, near, cut, packed = results

    model = train(docs, labels)
    scores = model.score(*PassageMeasures()([t for _, t in rows]))
    want = {i: t for (i, t), s in zip(rows, scores) if s >= THRESHOLD}
    assert {r.doc_id: r.text for r in quality} == want
    assert 0 < len(want) < len(rows)

    first = {}
    for i, t in sorted(want.items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
    want = {i: want[i] for i in first.values()}
    assert {r.doc_id: r.text for r in exact} == want

    ids = sorted(want)
    sets, bags = {i: counted(want[i]) for i in ids}, {i: words(want[i]) for i in ids}
    pairs = [
        (a, b) for n, a in enumerate(ids) for b in ids[:n]
        if bags[a] == bags[b] or max(similarity(*sets[a], *sets[b])) >= 0.8
    ]
    groups = components(pairs, ids)
    want = {i: want[i] for i in ids if groups[i][0] == i}
    assert pairs and {r.doc_id: r.text for r in near} == want

    rows_left = sorted(want.items())
    kept = {rows_left[n][0]: v for n, v in expected(rows_left).items()}
    want = {i: kept[i][2] if kept[i][1] else t for i, t in rows_left}
    assert {r.doc_id: r.text for r in cut} == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in cut)
    assert any(v[1] for v in kept.values())

    tokenizer = ChunkEncoder.at(tokenizer_path()).tokenizer
    pieces = {}
    for r in packed:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    assert pieces.keys() == want.keys()
    for i, t in want.items():
        code = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for _, start, length, crc in pieces[i]:
            assert crc == zlib.crc32(struct.pack(f"<{length}I", *code[start : start + length]))
        assert sum(p[2] for p in pieces[i]) == len(code)
    places = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= CAPACITY

    whole = corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, left.drop("sequence_id", "offset").collect()))


def test_stages_take_empty_tables(spark, tmp_path):
    docs = documents(spark, [], extra=False)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_all_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries().keys()
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if re.match(r"op\d+_", n)} == {f"op{n}" for n in range(1, 14)}
    assert __spark_entry__.oracle_sql().keys() <= names
