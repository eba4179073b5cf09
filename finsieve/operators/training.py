"""Model training and scoring on the feature matrix with Spark ML.

Rows need the feature columns and ``label``. Trained trees and coefficients are small
plain values on the driver; all row work is done by Spark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsieve import vocab
from finsieve.functions.scalars import sigmoid
from finsieve.operators.canonical import InputError
from finsieve.operators.evaluation import (
    best_candidate,
    choose_threshold,
    evaluate,
    ranking_metrics,
    score_table,
)
from finsieve.sources.files import path_exists, read_dataset

CATEGORY_SIZES = {
    "payment_type_code": len(vocab.PAYMENT_TYPES),
    "sender_country_code": len(vocab.COUNTRIES),
    "receiver_country_code": len(vocab.COUNTRIES),
}
NUMERIC = tuple(n for n in vocab.FEATURE_NAMES if n not in CATEGORY_SIZES)
MAX_TREES, MAX_DEPTH = 200, 6


def check_features(columns: Sequence[str], version: str = vocab.FEATURE_SET_VERSION) -> None:
    """Names and order of the features must be those the model was made for."""
    if version != vocab.FEATURE_SET_VERSION:
        raise InputError(f"feature set {version} is not {vocab.FEATURE_SET_VERSION}")
    if tuple(columns) != vocab.FEATURE_NAMES:
        raise InputError("feature columns differ from the model's in name or order")


# --- logistic baseline --------------------------------------------------------------------------------
@dataclass(frozen=True)
class LinearModel:
    """Everything needed to score a row without Spark ML."""

    intercept: float
    mean: dict[str, float]
    scale: dict[str, float]
    coefficients: dict[str, float]
    category_coefficients: dict[str, list[float]]

    def parts(self) -> dict[str, Column]:
        """Contribution of each feature to the log-odds."""
        out = {}
        for name in vocab.FEATURE_NAMES:
            value = F.col(name).cast("double")
            if name in CATEGORY_SIZES:
                size = CATEGORY_SIZES[name]
                code = F.when(value.between(0, size - 1), value).otherwise(0).cast("int")
                weights = F.array(*[F.lit(w) for w in self.category_coefficients[name]])
                out[name] = F.element_at(weights, code + 1)
            else:
                centred = (value - F.lit(self.mean[name])) / F.lit(self.scale[name])
                out[name] = centred * F.lit(self.coefficients[name])
        return out

    def margin(self) -> Column:
        total = F.lit(self.intercept)
        for part in self.parts().values():
            total += part
        return total

    def score(self) -> Column:
        return sigmoid(self.margin())


def _one_hot(name: str, size: int) -> list[Column]:
    code = F.when(F.col(name).between(0, size - 1), F.col(name)).otherwise(0)
    return [(code == i).cast("double") for i in range(size)]


def train_baseline(rows: DataFrame, c: float = 1.0, max_iter: int = 200) -> LinearModel:
    """Class-balanced logistic regression on standardised numbers and one-hot codes."""
    stats = rows.agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("pos"),
        *[F.avg(F.col(f).cast("double")).alias(f"m_{f}") for f in NUMERIC],
        *[F.stddev_pop(F.col(f).cast("double")).alias(f"s_{f}") for f in NUMERIC],
    ).first()
    n, pos = stats["n"], stats["pos"]
    if not 0 < pos < n:
        raise InputError("both classes are needed")
    mean = {f: float(stats[f"m_{f}"]) for f in NUMERIC}
    scale = {f: float(stats[f"s_{f}"]) or 1.0 for f in NUMERIC}
    numbers = [(F.col(f).cast("double") - mean[f]) / scale[f] for f in NUMERIC]
    codes = [x for name, size in CATEGORY_SIZES.items() for x in _one_hot(name, size)]
    weight = F.when(F.col("label") == 1, n / (2.0 * pos)).otherwise(n / (2.0 * (n - pos)))
    design = rows.select(
        array_to_vector(F.array(*numbers, *codes)).alias("x"),
        F.col("label").cast("double").alias("label"), weight.alias("w"),
    )
    model = LogisticRegression(
        featuresCol="x", labelCol="label", weightCol="w", regParam=1.0 / (c * n),
        standardization=False, maxIter=max_iter, tol=1e-8,
    ).fit(design)
    values = [float(v) for v in model.coefficients]
    at = len(NUMERIC)
    by_category = {}
    for name, size in CATEGORY_SIZES.items():
        by_category[name] = values[at : at + size]
        at += size
    return LinearModel(
        float(model.intercept), mean, scale, dict(zip(NUMERIC, values)), by_category
    )


def top_contributions(parts: Column, k: int = 5) -> Column:
    """The k (feature, value, contribution) with the largest effect, ties by name."""

    def order(a: Column, b: Column) -> Column:
        x, y = F.abs(a["contribution"]), F.abs(b["contribution"])
        return (
            F.when(x > y, -1).when(x < y, 1).when(a["feature"] < b["feature"], -1)
            .when(a["feature"] > b["feature"], 1).otherwise(0)
        )

    return F.slice(F.array_sort(parts, order), 1, k)


def explain_linear(rows: DataFrame, model: LinearModel, k: int = 5) -> DataFrame:
    """Score, base value and strongest contributions of every row."""
    # The parts are no columns of their own: a filter on the score would double its
    # constraints with each of them while it is planned.
    parts = F.array(
        *[
            F.struct(
                F.lit(n).alias("feature"), F.col(n).cast("double").alias("value"),
                part.alias("contribution"),
            )
            for n, part in model.parts().items()
        ]
    )
    return rows.withColumns(
        {
            "base_value": F.lit(model.intercept), "score": model.score(),
            "top_features": top_contributions(parts, k),
        }
    )


# --- boosted trees --------------------------------------------------------------------------------
@dataclass(frozen=True)
class Tree:
    """One regression tree as arrays; leaves point to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left_codes: list[frozenset[float] | None]
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int


def _flatten(node, nodes: list, level: int) -> int:
    at = len(nodes)
    nodes.append(None)
    if node.subtreeDepth() == 0:
        nodes[at] = (0, 0.0, None, at, at, node.prediction(), level)
        return at
    split = node.split()
    categories = None
    threshold = 0.0
    if split.getClass().getSimpleName() == "CategoricalSplit":
        categories = frozenset(split.leftCategories())
    else:
        threshold = split.threshold()
    left = _flatten(node.leftChild(), nodes, level + 1)
    right = _flatten(node.rightChild(), nodes, level + 1)
    nodes[at] = (
        split.featureIndex(), threshold, categories, left, right, node.prediction(), level
    )
    return at


def extract_trees(model: GBTClassificationModel) -> list[tuple[float, Tree]]:
    """(weight, tree) pairs of a fitted model; at most 200 trees of depth 6."""
    out = []
    for weight, tree in zip(model.treeWeights, model.trees):
        nodes: list = []
        _flatten(tree._java_obj.rootNode(), nodes, 0)
        columns = list(zip(*nodes))
        out.append(
            (
                float(weight),
                Tree(
                    np.array(columns[0]), np.array(columns[1]), list(columns[2]),
                    np.array(columns[3]), np.array(columns[4]), np.array(columns[5]),
                    max(columns[6]),
                ),
            )
        )
    return out


def _goes_left(tree: Tree, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    chosen = x[np.arange(len(x)), tree.feature[at]]
    left = chosen <= tree.threshold[at]
    for node in np.unique(at):
        codes = tree.left_codes[node]
        if codes is not None:
            mine = at == node
            left[mine] = np.isin(chosen[mine], list(codes))
    return left


def _walk(tree: Tree, x: np.ndarray, effects: np.ndarray | None, weight: float) -> np.ndarray:
    """Leaf values; adds what each split changed to the effect of its feature."""
    rows = np.arange(len(x))
    at = np.zeros(len(x), dtype=int)
    for _ in range(tree.depth):
        nxt = np.where(_goes_left(tree, at, x), tree.left[at], tree.right[at])
        if effects is not None:
            change = 2.0 * weight * (tree.value[nxt] - tree.value[at])
            np.add.at(effects, (rows, tree.feature[at]), np.where(nxt == at, 0.0, change))
        at = nxt
    return tree.value[at]


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return pdf[list(vocab.FEATURE_NAMES)].to_numpy(dtype=float)


def explain_trees(
    rows: DataFrame, trees: list[tuple[float, Tree]], key: str, k: int = 5
) -> DataFrame:
    """Score, base value and strongest contributions in log-odds of every row.

    Each split on a row's path adds the change of the node mean to its feature, so base
    plus contributions is the log-odds of the score.
    """
    base = 2.0 * sum(w * t.value[0] for w, t in trees)
    names = list(vocab.FEATURE_NAMES)
    key_type = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _matrix(pdf)
            effects = np.zeros(x.shape)
            for weight, tree in trees:
                _walk(tree, x, effects, weight)
            yield pd.DataFrame(
                {key: pdf[key], "values": list(x), "effects": list(effects)}
            )

    found = rows.select(key, *names).mapInPandas(
        run, f"{key} {key_type}, values array<double>, effects array<double>"
    )
    parts = F.transform(
        F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("n"), "values", "effects"),
        lambda p: F.struct(
            p["n"].alias("feature"), p["values"].alias("value"),
            p["effects"].alias("contribution"),
        ),
    )
    margin = F.lit(base) + F.aggregate("effects", F.lit(0.0), lambda a, e: a + e)
    return found.select(
        key, sigmoid(margin).alias("score"), F.lit(base).alias("base_value"),
        top_contributions(parts, k).alias("top_features"),
    )


def staged_scores(
    rows: DataFrame, trees: list[tuple[float, Tree]], keep: Sequence[str], every: int
) -> DataFrame:
    """(num_trees, score, keep...) rows: the score after each ``every`` trees."""
    steps = sorted({*range(every, len(trees) + 1, every), len(trees)})
    types = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _matrix(pdf)
            margin = np.zeros(len(x))
            for i, (weight, tree) in enumerate(trees, 1):
                margin = margin + 2.0 * weight * _walk(tree, x, None, weight)
                if i in steps:
                    out = pdf[list(keep)].copy()
                    out["num_trees"] = i
                    out["score"] = 1.0 / (1.0 + np.exp(-margin))
                    yield out

    schema = ", ".join(f"{c} {types[c]}" for c in keep) + ", num_trees int, score double"
    columns = list(dict.fromkeys([*keep, *vocab.FEATURE_NAMES]))
    return rows.select(*columns).mapInPandas(run, schema)


@dataclass(frozen=True)
class GridPoint:
    depth: int
    step_size: float
    positive_weight: float


DEFAULT_GRID = tuple(
    GridPoint(*p) for p in product((4, MAX_DEPTH), (0.05, 0.1), (1.0, 4.0))
)


def fit_trees(rows: DataFrame, point: GridPoint, max_trees: int, seed: int = 7):
    """One boosted-tree model on the feature matrix."""
    if not 1 <= point.depth <= MAX_DEPTH or not 1 <= max_trees <= MAX_TREES:
        raise ValueError("depth or number of trees is out of bounds")
    weight = F.when(F.col("label") == 1, point.positive_weight).otherwise(1.0)
    numbers = rows.select(
        *[F.col(f).cast("double").alias(f) for f in vocab.FEATURE_NAMES],
        F.col("label").cast("double").alias("label"), weight.alias("w"),
    )
    design = VectorAssembler(inputCols=list(vocab.FEATURE_NAMES), outputCol="x").transform(numbers)
    return GBTClassifier(
        featuresCol="x", labelCol="label", weightCol="w", maxDepth=point.depth,
        maxIter=max_trees, stepSize=point.step_size, seed=seed, subsamplingRate=0.8,
        minInstancesPerNode=100, featureSubsetStrategy="all",
    ).fit(design.select("x", "label", "w"))


def grid_results(
    train: DataFrame, val: DataFrame, grid: Sequence[GridPoint] = DEFAULT_GRID,
    max_trees: int = MAX_TREES, every: int = 10,
) -> tuple[DataFrame, dict[int, list[tuple[float, Tree]]]]:
    """(candidate, num_trees, pr_auc): best tree count of each point on validation data.

    The training rows are read once per tree level of every point, so cache them first.
    """
    models, parts = {}, []
    for i, point in enumerate(grid):
        models[i] = extract_trees(fit_trees(train, point, max_trees))
        table = score_table(
            staged_scores(val, models[i], ["label"], every), keys=["num_trees"]
        )
        best = ranking_metrics(table, ["num_trees"]).orderBy(F.desc("pr_auc"), "num_trees")
        parts.append(best.limit(1).select(F.lit(i).alias("candidate"), "num_trees", "pr_auc"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out, models


# --- two stages --------------------------------------------------------------------------------
def select_model(
    spark, features_path: str, out_path: str, floor: float = vocab.MIN_PRECISION,
) -> LinearModel:
    """Stage one: train and choose a threshold; only train and val folders are read."""
    columns = [*vocab.FEATURE_NAMES, "is_laundering", "split"]
    rows = read_dataset(spark, features_path, ("train", "val"), columns)
    rows = rows.withColumnRenamed("is_laundering", "label")
    model = train_baseline(rows.where("split = 'train'"))
    val = rows.where("split = 'val'").select("label", model.score().alias("score"))
    chosen = choose_threshold(score_table(val), floor).first()
    text = json.dumps({"model": asdict(model), "threshold": chosen["threshold"]})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(
        f"{out_path.rstrip('/')}/selection"
    )
    return model


def locked_test(spark, features_path: str, out_path: str) -> DataFrame:
    """Stage two: the test folder is read once, with the stored model and threshold."""
    out = out_path.rstrip("/")
    if path_exists(spark, f"{out}/test-report"):
        raise InputError("the test split was already used")
    stored = json.loads(spark.read.text(f"{out}/selection").first()[0])
    if stored["threshold"] is None:
        raise InputError("no threshold reached the precision floor")
    model = LinearModel(**stored["model"])
    rows = read_dataset(spark, features_path, ("test",), [*vocab.FEATURE_NAMES,
                                                          "is_laundering", "laundering_type"])
    scored = rows.select(
        F.col("is_laundering").alias("label"), model.score().alias("score"),
        F.col("laundering_type").alias("typology"),
    )
    report = evaluate(scored, stored["threshold"], typology="typology")
    report.write.parquet(f"{out}/test-report")
    return spark.read.parquet(f"{out}/test-report")


__all__ = [
    "DEFAULT_GRID", "GridPoint", "LinearModel", "best_candidate", "check_features",
    "explain_linear", "explain_trees", "extract_trees", "fit_trees", "grid_results",
    "locked_test", "select_model", "staged_scores", "top_contributions", "train_baseline",
]
