"""Training, tuning and scoring of the classifier set."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrow.functions.text import unnest
from lexigrow.operators.metrics import confusion_metrics, roc_auc
from lexigrow.operators.sampling import class_weights, sample_per_class, stratified_folds
from lexigrow.operators.scoring import label_from_score
from lexigrow.session import settled

# The classifier names that form the score columns.
NAMES = ("RandomForest", "NaiveBayes", "SVC", "MLP", "LogisticRegression", "DecisionTree", "SGD")
HARD_LABEL = ("SVC", "SGD")
RESULT_SCHEMA = (
    "clf_name string, train_score double, test_scores map<string,double>, "
    "params map<string,string>"
)


@dataclass
class Candidate:
    """An estimator and the parameter maps to search."""

    name: str
    estimator: object
    grid: list[dict] = field(default_factory=list)


def _grid(estimator, **options) -> list[dict]:
    maps: list[dict] = [{}]
    for name, values in options.items():
        param = estimator.getParam(name)
        maps = [{**m, param: value} for m in maps for value in values]
    return maps


def candidate(
    name: str, n_features: int, n_rows: int, full: bool = True, iterations: int | None = None,
    seed: int = 7,
) -> Candidate:
    """The estimator behind a name with its search grid; ``full=False`` keeps one candidate.

    Balanced weights sum to the row count, so a cost of C becomes ``regParam = 1 / (C * rows)``.
    """
    common = {"labelCol": "label", "featuresCol": "features"}
    weight = {"weightCol": "weight"}
    strength = 1.0 / max(n_rows, 1)
    if name == "RandomForest":
        est = RandomForestClassifier(**common, **weight, numTrees=100, seed=seed)
        grid = _grid(est, maxDepth=[4, 5, 6], featureSubsetStrategy=["sqrt", "log2"])
    elif name == "DecisionTree":
        # One unsampled tree of a forest: the plain tree has no feature-subset option.
        est = RandomForestClassifier(
            **common, **weight, numTrees=1, bootstrap=False, subsamplingRate=1.0, seed=seed
        )
        grid = _grid(est, maxDepth=[5, 8], featureSubsetStrategy=["sqrt", "log2"])
    elif name == "NaiveBayes":
        est = NaiveBayes(**common, modelType="gaussian")
        grid = [{}]
    elif name == "SVC":
        est = LinearSVC(**common, **weight, standardization=False, maxIter=iterations or 5000)
        grid = _grid(est, regParam=[strength, 10 * strength])
    elif name == "SGD":
        est = LinearSVC(**common, **weight, standardization=False, maxIter=iterations or 1000)
        grid = _grid(est, regParam=[0.01, 0.001])
    elif name == "LogisticRegression":
        est = LogisticRegression(
            **common, **weight, standardization=False, maxIter=iterations or 5000
        )
        grid = _grid(est, elasticNetParam=[1.0, 0.0], regParam=[strength])
    elif name == "MLP":
        est = MultilayerPerceptronClassifier(
            **common, layers=[n_features, 100, 2], maxIter=iterations or 500, seed=seed
        )
        # Step sizes only matter to gradient descent; L-BFGS, which needs none, is tried first.
        grid = _grid(est, solver=["l-bfgs"]) + _grid(
            est, solver=["gd"], stepSize=[0.001, 0.0001]
        )
    else:
        raise ValueError(f"unknown classifier {name}")
    return Candidate(name, est, grid if full else grid[:1])


def training_rows(
    features: DataFrame, label: str, key: str, folds: int = 5,
    threshold: int | None = 100_000, per_class: int = 50_000, seed: int = 7,
) -> DataFrame:
    """Rows to fit on, with weight and fold columns, written once for all fits. A table of more
    than ``threshold`` rows is cut to ``per_class`` of each class; ``None`` uses all rows."""
    rows = features
    if threshold is not None:
        rows = sample_per_class(features, label, key, per_class, threshold, seed)
    rows = stratified_folds(class_weights(rows, label), label, key, folds, seed)
    return settled(rows.withColumn("label", F.col(label).cast("double")))


def grid_search(cand: Candidate, rows: DataFrame, folds: int = 5, parallelism: int = 4):
    """``(mean F1 of the best candidate, its parameters, model refitted on all rows)``."""
    evaluator = MulticlassClassificationEvaluator(
        metricName="fMeasureByLabel", metricLabel=1.0, labelCol="label"
    )
    search = CrossValidator(
        estimator=cand.estimator,
        estimatorParamMaps=cand.grid,
        evaluator=evaluator,
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
    ).fit(rows)
    best = max(range(len(cand.grid)), key=lambda i: search.avgMetrics[i])
    params = {p.name: str(v) for p, v in cand.grid[best].items()}
    return float(search.avgMetrics[best]), params, search.bestModel


def add_score(model, df: DataFrame, name: str) -> DataFrame:
    """Adds ``y_pred_prob_<name>``: the class-1 probability, or the label of a linear SVM."""
    column = f"y_pred_prob_{name}"
    scored = model.transform(df)
    value = F.col("prediction") if name in HARD_LABEL else vector_to_array("probability")[1]
    return scored.withColumn(column, value).drop("rawPrediction", "probability", "prediction")


def score_all(models: dict, df: DataFrame) -> DataFrame:
    """One score column per model; each row is scored where it lies."""
    for name, model in models.items():
        df = add_score(model, df, name)
    return df


def score_and_label(model, df: DataFrame, name: str = "SGD") -> DataFrame:
    """Scores of one model with the boolean label ``y``."""
    scored = add_score(model, df, name)
    return scored.withColumn("y", label_from_score(F.col(f"y_pred_prob_{name}")))


def held_out_scores(models: dict, df: DataFrame) -> dict[str, dict[str, float]]:
    """F1, precision, recall, ROC-AUC and accuracy of every model on held-out rows.

    All models score a row in one pass; their metrics come from two grouped aggregates.
    """
    for name, model in models.items():
        scored = model.transform(df)
        hard = name in HARD_LABEL
        score = F.col("prediction") if hard else vector_to_array("probability")[1]
        result = F.struct(F.lit(name).alias("clf_name"), "prediction", score.alias("score"))
        df = scored.withColumn(f"__{name}", result).drop(
            "rawPrediction", "probability", "prediction"
        )
    results = F.array(*[F.col(f"__{name}") for name in models])
    rows = settled(unnest(df, results, "r", keep=["label"]).select("label", "r.*"))
    found = confusion_metrics(rows, "label", "prediction", by="clf_name")
    found = found.join(roc_auc(rows, "label", "score", by="clf_name"), "clf_name")
    metrics = {"f1": "f1", "precision": "precision", "recall": "recall", "roc_auc": "auc", "accuracy": "accuracy"}
    return {
        row["clf_name"]: {
            name: float("nan") if row[column] is None else float(row[column])
            for name, column in metrics.items()
        }
        for row in found.collect()
    }


def model_path(folder: str, name: str) -> str:
    return os.path.join(folder, "clfs", name)


def run_classifiers(
    train: DataFrame,
    validation: DataFrame,
    n_features: int,
    names: tuple[str, ...] = NAMES,
    full: bool = True,
    iterations: int | None = None,
    folds: int = 5,
    save_to: str | None = None,
    seed: int = 7,
) -> tuple[dict, DataFrame]:
    """Tune, refit and test each model: ``(models, result rows)``.

    ``train`` comes from :func:`training_rows`; ``validation`` has ``label`` and ``features``.
    The result holds one row per model, so it is built from driver-side summaries. With a
    ``save_to`` folder, models found there are loaded instead of fitted and get no new row.
    """
    spark = train.sparkSession
    n_rows = train.count()
    models, rows = {}, []
    for name in names:
        if save_to is not None and path_exists(spark, model_path(save_to, name)):
            models[name] = PipelineModel.load(model_path(save_to, name)).stages[0]
            continue
        cand = candidate(name, n_features, n_rows, full, iterations, seed)
        score, params, model = grid_search(cand, train, folds)
        if save_to is not None:
            PipelineModel([model]).write().overwrite().save(model_path(save_to, name))
        models[name] = model
        rows.append((name, score, params))
    fresh = {name: models[name] for name, _, _ in rows}
    tested = held_out_scores(fresh, validation) if fresh else {}
    rows = [(name, score, tested.get(name), params) for name, score, params in rows]
    return models, spark.createDataFrame(rows, RESULT_SCHEMA)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on the file system that owns it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def load_or_build(spark: SparkSession, path: str, load, build):
    """Load what lies at ``path``; otherwise build it and save it there."""
    if path_exists(spark, path):
        return load(path)
    model = build()
    model.write().overwrite().save(path)
    return model
