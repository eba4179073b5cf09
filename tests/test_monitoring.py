"""Evaluation, drift, dataset rules, feature store and experiments."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from finsieve import vocab
from finsieve.operators import dataset as B
from finsieve.operators import drift as D
from finsieve.operators import evaluation as E
from finsieve.operators import experiments as X
from finsieve.operators import feature_store as V
from finsieve.operators import training as M
from finsieve.operators.canonical import InputError
from finsieve.operators.prefix import exact_percentiles

LABELS = (1, 1, 0, 1, 0, 0, 0, 1, 0, 0)
SCORES = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1)


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(list(zip(LABELS, SCORES)), "label int, score double")


def test_thresholds(scored):
    table = E.score_table(scored)
    assert E.choose_threshold(table, 0.5).first()["threshold"] == 0.2
    best = E.choose_threshold(table, 0.75).first()
    assert (best["threshold"], best["precision"], best["recall"]) == (0.6, 0.75, 0.75)
    assert E.choose_threshold(table, 1.1).first()["threshold"] is None
    point = E.at_threshold(scored, F.lit(0.6)).first()
    assert [point[c] for c in ("tp", "fp", "fn", "tn")] == [3, 1, 1, 5]


def test_ranking(scored, spark):
    row = E.ranking_metrics(E.score_table(scored)).first()
    hits, ap = 0, 0.0
    for i, y in enumerate(LABELS, 1):
        hits += y
        ap += y * hits / i / 4
    assert row["pr_auc"] == pytest.approx(ap)
    wins = [
        (a > b) + 0.5 * (a == b) for a, y in zip(SCORES, LABELS) if y
        for b, z in zip(SCORES, LABELS) if not z
    ]
    assert row["roc_auc"] == pytest.approx(sum(wins) / len(wins))
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5)], "label int, score double")
    assert E.ranking_metrics(E.score_table(tied)).first()["roc_auc"] == 0.5


def test_gate_fails_on_missing_values(scored):
    rows = {r["metric"]: r["passed"] for r in E.check_targets(E.evaluate(scored, 0.6)).collect()}
    assert len(rows) == len(vocab.MODEL_TARGETS) and rows["recall"] and not rows["num_trees"]


def test_percentiles(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.exponential(5, 400), [7.0] * 300])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    row = exact_percentiles(df, "v", (0.5, 0.9, 0.99), ("a", "b", "c")).first()
    for name, p in zip("abc", (50, 90, 99)):
        assert row[name] == pytest.approx(np.percentile(values, p))
    assert row["n"] == 700 and row["max"] == values.max()


def test_drift_figures(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 1, 500), rng.normal(0.4, 1.2, 350)
    ref = spark.createDataFrame([(float(v), str(int(v > 0))) for v in a], "x double, c string")
    cur = spark.createDataFrame([(float(v), str(int(v > 0))) for v in b], "x double, c string")
    edges = np.linspace(min(a.min(), b.min()), max(a.max(), b.max()), 11)
    ra = (np.histogram(a, edges)[0] + 1) / (len(a) + 10)
    rb = (np.histogram(b, edges)[0] + 1) / (len(b) + 10)
    report = {r["feature"]: r for r in D.feature_report(ref, cur, ("c",)).collect()}
    assert report["x"]["psi"] == pytest.approx(np.sum((rb - ra) * np.log(rb / ra)))
    both = np.sort(np.concatenate([a, b]))
    gap = np.abs(
        np.searchsorted(np.sort(a), both, "right") / len(a)
        - np.searchsorted(np.sort(b), both, "right") / len(b)
    ).max()
    assert report["x"]["statistic"] == pytest.approx(gap)
    assert report["x"]["drift_detected"] and report["x"]["reference_std"] == pytest.approx(a.std())
    counts = np.array([(a <= 0).sum(), (a > 0).sum()]) + 1
    seen = np.array([(b <= 0).sum(), (b > 0).sum()]) + 1
    expected = counts * seen.sum() / counts.sum()
    stat = ((seen - expected) ** 2 / expected).sum()
    assert report["c"]["statistic"] == pytest.approx(stat)
    assert report["c"]["p_value"] == pytest.approx(math.erfc(math.sqrt(stat / 2)))
    whole = D.data_recommendations(D.data_report(D.feature_report(ref, cur, ("c",)))).first()
    assert whole["has_drift"] and whole["severity"] == "critical"
    same = D.data_report(D.feature_report(ref, ref, ("c",))).first()
    assert not same["has_drift"] and same["severity"] == "none"


def test_chi_square_tail():
    assert D._chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert D._chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05)
    assert D._chi_square_tail(2.0, 2) == pytest.approx(math.exp(-1))


def test_model_drift(spark):
    def table(**values):
        return spark.createDataFrame(list(values.items()), "metric string, value double")

    changes = D.model_drift(table(f1=0.9, auc=0.95, only=1.0), table(f1=0.7, auc=0.95))
    row = D.model_report(changes).first()
    assert row["has_drift"] and row["severity"] == "critical" and len(row["recommendations"]) == 4
    calm = D.model_report(D.model_drift(table(f1=0.9), table(f1=0.9))).first()
    assert not calm["has_drift"] and calm["recommendations"] == []


def test_split_moves_behind_ties(spark):
    # Twenty rows; rows 6-9 and 13-15 share their time.
    hours = [0, 1, 2, 3, 4, 5, 6, 6, 6, 6, 10, 11, 12, 13, 13, 13, 16, 17, 18, 19]
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(hours=h),) for h in hours]
    df = spark.createDataFrame(rows, "timestamp timestamp")
    _, val, test = B.read_boundaries(B.split_boundaries(df, 0.40, 0.30))
    assert (val, test) == (start + timedelta(hours=10), start + timedelta(hours=16))
    done = B.assign_split(df, B.split_boundaries(df, 0.40, 0.30))
    B.check_splits(done)
    assert {r["split"]: r["rows"] for r in B.split_ranges(done).collect()} == {
        "train": 10, "val": 6, "test": 4}
    same = spark.createDataFrame(rows[6:10], "timestamp timestamp")
    with pytest.raises(InputError):
        B.read_boundaries(B.split_boundaries(same))


def test_fingerprint_ignores_order(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    other = df.orderBy(F.desc("id")).repartition(7)
    assert B.fingerprint(df).first() == B.fingerprint(other).first()
    assert B.fingerprint(df.where("id != 3")).first() != B.fingerprint(df).first()
    kept = B.sample_negatives(
        df.withColumn("is_laundering", (F.col("id") < 10).cast("int")), 0.2, 5, "id")
    n = kept.count()
    assert kept.where("is_laundering = 1").count() == 10 and 130 < n < 290
    assert kept.repartition(3).count() == n


def test_point_in_time(spark):
    group = V.FeatureGroup("g", "e", "ts", ("v",))
    rng, start = random.Random(4), datetime(2024, 1, 1)

    def rows(n):
        return [(f"E{rng.randrange(3)}", start + timedelta(hours=rng.randrange(60)), i)
                for i in range(n)]

    left, right = rows(80), rows(40)
    known = {(e, t): v for e, t, v in sorted(right)}
    right = [(e, t, v) for (e, t), v in known.items()]
    schema = "e string, ts timestamp, {} int"
    for hot in (10**6, 3):
        found = V.point_in_time(
            group, spark.createDataFrame(left, schema.format("n")),
            spark.createDataFrame(right, schema.format("v")), tolerance_us=10 * 3_600_000_000,
            hot_rows=hot, chunk_us=5 * 3_600_000_000,
        ).collect()
        wanted = {}
        for e, t, n in left:
            past = [(u, v) for f, u, v in right if f == e and t - timedelta(hours=10) <= u <= t]
            wanted[n] = max(past)[1] if past else None
        assert {r["n"]: r["v"] for r in found} == wanted
    with pytest.raises(ValueError):
        group.check(spark.createDataFrame(left, schema.format("n")))


def test_assignment_and_results(spark):
    import hashlib

    plan = spark.createDataFrame(
        [("t", "running", 0, "control", 0.6, True), ("t", "running", 1, "new", 0.4, False)],
        "test_id string, status string, position int, variant string, traffic double, "
        "is_control boolean")
    users = spark.range(500).select(F.lit("t").alias("test_id"), F.col("id").cast("string")
                                    .alias("user_id"))
    for r in X.assign_by_hash(users, plan).collect():
        digest = hashlib.md5(f"t_{r['user_id']}".encode()).hexdigest()
        share = int(digest, 16) % 100 / 100
        assert r["variant"] == ("control" if share < 0.6 else "new")
    totals = spark.createDataFrame(
        [("t", "control", 2000, 200), ("t", "new", 2000, 280)],
        "test_id string, variant string, samples long, successes long")
    row = X.ab_results(totals, plan).first()
    pool = 480 / 4000
    z = 0.04 / math.sqrt(pool * (1 - pool) * 2 / 2000)
    assert row["z"] == pytest.approx(z) and row["result"] == "treatment_wins"
    assert row["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)))
    few = X.ab_results(totals, plan, min_samples=5000).first()
    assert few["result"] == "inconclusive" and few["samples_needed"] == 3000
    seen = X.assign_by_bandit(
        users, plan, spark.createDataFrame(
            [("t", "new", True)] * 60 + [("t", "control", False)] * 60,
            "test_id string, variant string, success boolean"), 1)
    assert seen.where("variant = 'new'").count() > 490


def test_trees_explain_their_scores(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(800):
        values = [float(rng.integers(0, 8)) for _ in vocab.FEATURE_NAMES]
        rows.append((i, *values, int(values[0] + values[8] > 8)))
    schema = "seq long, " + ", ".join(f"{n} double" for n in vocab.FEATURE_NAMES) + ", label int"
    df = spark.createDataFrame(rows, schema)
    model = M.fit_trees(df, M.GridPoint(3, 0.3, 1.0), max_trees=4)
    trees = M.extract_trees(model)
    mine = {r["seq"]: r for r in M.explain_trees(df, trees, "seq", k=15).collect()}
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=list(vocab.FEATURE_NAMES), outputCol="x").transform(df)
    for r in model.transform(ready).select("seq", "probability").collect():
        found = mine[r["seq"]]
        assert found["score"] == pytest.approx(float(r["probability"][1]), abs=1e-9)
        margin = found["base_value"] + sum(f["contribution"] for f in found["top_features"])
        assert 1 / (1 + math.exp(-margin)) == pytest.approx(found["score"])
    staged = M.staged_scores(df, trees, ["seq"], 2)
    last = {r["seq"]: r["score"] for r in staged.where("num_trees = 4").collect()}
    assert all(last[k] == pytest.approx(v["score"]) for k, v in mine.items())
    line = M.train_baseline(df)
    out = M.explain_linear(df, line, k=15).first()
    total = out["base_value"] + sum(f["contribution"] for f in out["top_features"])
    assert 1 / (1 + math.exp(-total)) == pytest.approx(out["score"])
    with pytest.raises(InputError):
        M.check_features(vocab.FEATURE_NAMES[::-1])


def test_filter_on_a_linear_score_is_planned_in_bounded_space(spark):
    from finsieve.plans.models import stored_model

    columns = ", ".join(f"{n} double" for n in vocab.FEATURE_NAMES)
    df = spark.createDataFrame([(0, *[1.0] * 15), (1, *[9.0] * 15)], f"seq long, {columns}")
    model = stored_model()
    assert set(M.explain_linear(df, model).columns) == {*df.columns, "base_value", "score", "top_features"}
    priced = M.explain_linear(df, model).where("score >= 0.6").select("seq", "score")
    # Planned as far as the parts go, not further: with columns of parts this does not end.
    projected = priced._jdf.queryExecution().analyzed().toString()
    assert "_c_" not in projected
    assert [r["seq"] for r in priced.join(df, "seq").collect()] == [1]


def test_bandit_draws_are_spread(spark):
    variants = spark.createDataFrame(
        [("T", "running", 0, "a", 0.5, True), ("T", "running", 1, "b", 0.5, False)],
        "test_id string, status string, position int, variant string, traffic double, is_control boolean")
    asked = spark.range(50).select("id", F.lit("T").alias("test_id")).coalesce(1)
    outcomes = asked.select("test_id", F.lit("b").alias("variant"), (F.col("id") > 1).alias("success"))
    drawn = X.assign_by_bandit(asked, variants, outcomes, 5)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_seed" in plan.split("MapInPandas")[1]
    assert drawn.where("variant = 'b'").count() > 40
