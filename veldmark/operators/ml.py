"""Per-pixel classification with Spark ML: samples of attributes and a class, and three learners."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldmark.session import cut

#: Rows of a task of learners that go over them hundreds of times: every task of every turn reports to the driver.
ROWS = 1 << 14


def training_set(samples: DataFrame, attributes: DataFrame, keys: list[str]) -> DataFrame:
    """Labelled positions with the attributes of their pixels."""
    return attributes.join(samples.select(*keys, "label"), keys)


def _fitted(rows: DataFrame, attributes: list[str], learner) -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=attributes, outputCol="features"), learner]).fit(rows.withColumn("label", F.col("label").cast("double")))


def _gathered(rows: DataFrame) -> DataFrame:
    """rows stored once, in partitions of about ROWS; fewer, if they come in fewer."""
    stored = cut(rows)
    return stored.coalesce(max(1, -(-stored.count() // ROWS)))


def random_forest(rows: DataFrame, attributes: list[str], trees: int = 200, subset: int = 2, seed: int = 42) -> PipelineModel:
    return _fitted(rows, attributes, RandomForestClassifier(numTrees=trees, featureSubsetStrategy=str(subset), seed=seed))


def support_vectors(rows: DataFrame, attributes: list[str]) -> PipelineModel:
    """Linear, one class against the rest."""
    return _fitted(_gathered(rows), attributes, OneVsRest(classifier=LinearSVC(maxIter=50)))


def perceptron(rows: DataFrame, attributes: list[str], classes: int, hidden: tuple[int, ...] = (10, 5), seed: int = 42) -> PipelineModel:
    return _fitted(_gathered(rows), attributes, MultilayerPerceptronClassifier(layers=[len(attributes), *hidden, classes], maxIter=300, seed=seed))


def classify(model: PipelineModel, rows: DataFrame, probability_of: int | None = None) -> DataFrame:
    """The class of each row, or the probability of one class."""
    done = model.transform(rows)
    value = F.col("prediction").cast("int").alias("class") if probability_of is None else vector_to_array("probability")[probability_of].alias("probability")
    return done.select(*rows.columns, value)
