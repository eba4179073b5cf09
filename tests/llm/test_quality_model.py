import zlib

import numpy as np
import pytest

from finsieve.llm.quality_model import (
    PASSAGE,
    GatedAttention,
    PassageMeasures,
    keep_good,
    train,
    training_rows,
    with_score,
)

from helpers import awkward, documents, prose


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def corpus():
    rows = []
    for i in range(160):
        text = "the and of " + prose(i, 150, 3000)
        rows.append((i, text if i % 4 else text.replace(" ", "&&& ")))
    return rows, [(i, int(i % 4 > 0), 0) for i, _ in rows]


def test_gradients_are_those_of_differences():
    rng = np.random.default_rng(0)
    counts = np.array([1, 3, 2])
    x, y = rng.normal(size=(6, 5)), np.array([0.0, 1.0, 1.0])
    model = GatedAttention.fit(x, counts, y)
    model.weights = {name: np.array(w) for name, w in model.weights.items()}

    def loss():
        p = np.clip(model.score(x, counts), 1e-12, 1 - 1e-12)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = model.gradients(x, counts, y)
    for name, w in model.weights.items():
        flat = w.reshape(-1)
        for i in rng.choice(flat.size, min(4, flat.size), replace=False):
            old = flat[i]
            flat[i] = old + 1e-6
            up = loss()
            flat[i] = old - 1e-6
            down = loss()
            flat[i] = old
            assert grads[name].reshape(-1)[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_held_out_documents_are_told_apart(spark):
    rows, marks = corpus()
    docs = documents(spark, rows)
    model = train(docs, labels(spark, marks))
    out = with_score(docs, model, "p").select("doc_id", "p").collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all((r.p >= 0.3) == (r.doc_id % 4 > 0) for r in held)
    good = keep_good(docs, labels(spark, marks))
    assert good.columns == docs.columns
    assert {r.doc_id % 4 for r in good.select("doc_id").collect()} == {1, 2, 3}


def test_only_allowed_and_clear_labels_are_learned_from(spark):
    rows, marks = corpus()
    odd = marks + [(1, 0, 0), (None, 1, 0), (6, None, 0)]
    used = {r.doc_id for r in training_rows(documents(spark, rows), labels(spark, odd)).collect()}
    assert used == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 and i != 1}


def test_attention_weighs_passages(spark):
    measures = PassageMeasures()
    x, counts = measures([prose(1, PASSAGE * 3 + 1), "", None])
    assert counts.tolist() == [4, 1, 1]
    rows, marks = corpus()
    model = train(documents(spark, rows), labels(spark, marks))
    weights = model.attention(x, counts)
    assert weights[:4].sum() == pytest.approx(1) and weights[4] == 1


def test_awkward_rows_missing_classes_and_empty_tables(spark):
    rows, marks = corpus()
    model = train(documents(spark, rows), labels(spark, marks))
    out = with_score(documents(spark, awkward()), model, "p").select("p").collect()
    assert len(out) == len(awkward()) and all(0 <= r.p <= 1 for r in out)
    assert with_score(documents(spark, []), model, "p").count() == 0
    assert train(documents(spark, rows), labels(spark, [])) == 0.5
    assert train(documents(spark, rows), labels(spark, [(2, 1, 0), (3, 1, 0)])) == 1.0
    assert keep_good(documents(spark, []), labels(spark, marks)).count() == 0


def test_fit_takes_whole_rows_until_its_passages_are_enough(spark, monkeypatch):
    from finsieve.llm import quality_model

    long_text = prose(1, 100 * PASSAGE)
    rows = [(i, long_text if i % 2 else prose(i, 30)) for i in range(200)] + [(7, long_text), (7, "x"), (None, "y")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality_model.GatedAttention, "fit", lambda x, counts, label: seen.append((len(x), counts, label)))
    train(documents(spark, rows), labels)
    monkeypatch.setattr(quality_model, "TRAIN_PASSAGES", 450)
    train(documents(spark, rows), labels)
    (whole, counts, _), (some, few, _) = seen
    assert whole == counts.sum() and set(counts) == {1, 100}
    assert set(few) == {1, 100} and 450 <= some < 550 and len(few) < len(counts)
