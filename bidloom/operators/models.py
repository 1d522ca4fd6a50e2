"""Tabular models: split, train, evaluate, predict, explain, persist."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.sources.staging import stage_table

SEED = 42
TREES = 100
DEPTH = 10
LOGISTIC_ITERATIONS = 1000


def train_share(key: str, test_size: float = 0.2, seed: int = SEED) -> Column:
    """True for training rows; depends on the key alone, so any re-run or layout agrees."""
    digest = F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))), 1, 8)
    bucket = F.conv(digest, 16, 10).cast("bigint") % 10_000
    return bucket >= int(test_size * 10_000)


def split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    train = train_share(key, test_size, seed)
    return df.where(train), df.where(~train)


@dataclass
class TrainedModel:
    pipeline: PipelineModel
    features: list[str]
    target: str
    model_type: str
    task: str
    measure: Callable[[], dict[str, float]] = dict

    @cached_property
    def metrics(self) -> dict[str, float]:
        """Figures of both shares; the rows are scored when they are first asked for."""
        return self.measure()

    def check_features(self, df: DataFrame, ignore: tuple[str, ...] = ()) -> None:
        given = set(df.columns) - {self.target, *ignore}
        if given != set(self.features):
            raise ValueError(f"features mismatch, expected {self.features}")

    def predict(self, df: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
        self.check_features(df, ignore)
        return self.pipeline.transform(df).drop("_features", "rawPrediction", "probability")

    def predict_proba(self, df: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
        self.check_features(df, ignore)
        scored = self.pipeline.transform(df)
        if "probability" not in scored.columns:
            raise ValueError("model has no class probabilities")
        return scored.withColumn("probability", vector_to_array("probability")).drop("_features", "rawPrediction")

    def feature_importance(self) -> DataFrame:
        last = self.pipeline.stages[-1]
        if not hasattr(last, "featureImportances"):
            raise ValueError("model has no feature importances")
        pairs = [(name, float(last.featureImportances[i])) for i, name in enumerate(self.features)]
        spark = _session()
        return spark.createDataFrame(pairs, "feature string, importance double").orderBy(
            F.desc("importance"), "feature"
        )

    def metrics_table(self) -> DataFrame:
        rows = [(name, float(value)) for name, value in self.metrics.items()]
        return _session().createDataFrame(rows, "metric string, value double")

    def save(self, path: str) -> None:
        """Model and its facts side by side under ``path``."""
        self.pipeline.write().overwrite().save(f"{path}/model")
        facts = [(self.features, self.target, self.model_type, self.task, self.metrics)]
        _session().createDataFrame(facts, _FACTS).coalesce(1).write.mode("overwrite").json(f"{path}/facts")

    @staticmethod
    def load(path: str) -> TrainedModel:
        facts = _session().read.schema(_FACTS).json(f"{path}/facts").first()
        return TrainedModel(
            PipelineModel.load(f"{path}/model"),
            list(facts["features"]),
            facts["target"],
            facts["model_type"],
            facts["task"],
            lambda: dict(facts["metrics"]),
        )


_FACTS = (
    "features array<string>, target string, model_type string, task string, metrics map<string,double>"
)


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.active()


def _estimator(model_type: str, task: str, target: str, n_train: int, options: dict):
    common = {"featuresCol": "_features", "labelCol": target}
    trees = {
        "numTrees": options.get("n_estimators", TREES),
        "maxDepth": options.get("max_depth", DEPTH),
        "seed": SEED,
    }
    if task == "classification" and model_type == "random_forest":
        return RandomForestClassifier(**common, **trees)
    if task == "classification" and model_type == "logistic_regression":
        # an L2 penalty of weight 1 on the summed loss is 1/n on the mean loss
        return LogisticRegression(
            **common,
            maxIter=options.get("max_iter", LOGISTIC_ITERATIONS),
            regParam=1.0 / max(n_train, 1),
            elasticNetParam=0.0,
            standardization=False,
        )
    if task == "regression" and model_type == "random_forest":
        return RandomForestRegressor(**common, **trees, featureSubsetStrategy="all")
    if task == "regression" and model_type == "linear_regression":
        return LinearRegression(**common, regParam=0.0, solver="normal")
    raise ValueError(f"unknown model type: {model_type} for {task}")


def classification_metrics(scored: DataFrame, target: str) -> dict[str, float]:
    """Accuracies of both shares and weighted figures of the test share, from (_train, target, prediction).

    They come from one confusion table of at most two shares times classes squared rows.
    """
    table = scored.groupBy("_train", F.col(target).cast("double").alias("y"), "prediction").agg(F.count("*").alias("n"))
    rows = table.collect()

    def share(train: bool) -> list[tuple[float, float, int]]:
        return [(r["y"], r["prediction"], r["n"]) for r in rows if r["_train"] == train]

    def accuracy(cells: list) -> float:
        total = sum(n for *_, n in cells)
        return sum(n for y, p, n in cells if y == p) / total if total else float("nan")

    test = share(False)
    total = sum(n for *_, n in test)
    weighted = {"precision": 0.0, "recall": 0.0, "f1_score": 0.0}
    for label in {y for y, _, _ in test}:
        hit = sum(n for y, p, n in test if y == label and p == label)
        actual = sum(n for y, _, n in test if y == label)
        predicted = sum(n for _, p, n in test if p == label)
        precision = hit / predicted if predicted else 0.0
        recall = hit / actual
        both = precision + recall
        for name, value in zip(weighted, (precision, recall, 2 * precision * recall / both if both else 0.0), strict=True):
            weighted[name] += value * actual / total
    return {"train_accuracy": accuracy(share(True)), "test_accuracy": accuracy(test), **weighted}


def _regression_metrics(scored: DataFrame, target: str) -> dict[str, float]:
    y = F.col(target).cast("double")
    error = F.avg(F.pow(y - F.col("prediction"), 2))
    rows = scored.groupBy("_train").agg(error.alias("mse"), F.var_pop(y).alias("spread")).collect()
    out = {}
    for name, train in (("train", True), ("test", False)):
        row = next((r for r in rows if r["_train"] == train), None)
        known = row is not None and row["spread"]
        out[f"{name}_r2"] = 1 - row["mse"] / row["spread"] if known else float("nan")
        out[f"{name}_rmse"] = row["mse"] ** 0.5 if row is not None else float("nan")
    return out


def train_model(
    df: DataFrame,
    target: str,
    key: str,
    model_type: str = "random_forest",
    task: str = "classification",
    test_size: float = 0.2,
    **options,
) -> TrainedModel:
    """Fit on the training share and measure on both shares.

    Features are all columns except the key and the target.
    """
    if target not in df.columns:
        raise ValueError(f"target column '{target}' not found")
    features = [c for c in df.columns if c not in (target, key)]
    # written once, since fitting makes several passes over the same rows, and dealt by key: a table in one row group
    # would be fitted in one task. Sorted, so that the draws of a forest do not depend on the order of arrival
    dealt = df.withColumn("_train", train_share(key, test_size)).repartition(F.col(key)).sortWithinPartitions(key, *features)
    table = stage_table(dealt, "model-input")
    sizes = table.agg(F.count_if("_train").alias("train"), F.count("*").alias("all")).first()
    assembler = VectorAssembler(inputCols=features, outputCol="_features")
    estimator = _estimator(model_type, task, target, sizes["train"], options)
    fitted = Pipeline(stages=[assembler, estimator]).fit(table.where("_train").drop("_train"))
    figures = classification_metrics if task == "classification" else _regression_metrics

    def measure() -> dict[str, float]:
        return figures(fitted.transform(table), target) | {
            "n_features": float(len(features)),
            "n_train_samples": float(sizes["train"]),
            "n_test_samples": float(sizes["all"] - sizes["train"]),
        }

    return TrainedModel(fitted, features, target, model_type, task, measure)
