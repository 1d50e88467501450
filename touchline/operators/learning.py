"""Imitation models on tables: training, scoring, temporal features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.evaluation import DIRECTIONS, label_statistics, vector_moments
from touchline.operators.rows import attach
from touchline.operators.sequences import recent_values

HIDDEN = 64
# A kick counts only this close to the ball; order of the one-hot roles.
KICK_DISTANCE = 31.0
ROLE_ORDER = ("gk", "dm", "am", "st")


@dataclass(frozen=True)
class ImitationModels:
    """The direction classifier, the weighted kick classifier, and the mean and deviation per feature that scale both inputs."""

    direction: PipelineModel
    kick: PipelineModel
    mean: list[float]
    std: list[float]


def as_array(features: str | list[str]) -> Column:
    """An array column, or a list of columns as one array."""
    values = F.col(features) if isinstance(features, str) else F.array(*[F.col(f) for f in features])
    return values.cast("array<double>")


def scaled_vector(features: str | list[str], mean: list[float], std: list[float]) -> Column:
    """The features less their mean, in deviations, as a vector."""
    centred = F.zip_with(as_array(features), F.lit(mean), lambda x, m: x - m)
    return array_to_vector(F.zip_with(centred, F.lit(std), lambda x, s: x / s))


def train(samples: DataFrame, features: str | list[str], *, width: int, epochs: int = 40, seed: int = 1337, l2: float = 1e-5) -> ImitationModels:
    """Direction (nine classes) and kick (weighted, rare) models on the training rows (ML-02).

    Both are distributed learners on features scaled by the moments of AGG-18, which are as many as there are
    features; kicks weigh as much as the class rate asks, at most 25.
    """
    stats = label_statistics(samples).select("kick_positive_weight")
    moments = vector_moments(samples.select(as_array(features).alias("_x")), "_x").collect()  # one row per feature
    mean, std = ([r[c] for r in sorted(moments)] for c in ("mean", "std"))
    rows = attach(samples, stats).withColumns(
        {
            "scaled": scaled_vector(features, mean, std),
            "direction_label": F.col("direction").cast("double"),
            "kick_label": F.col("kick").cast("double"),
            "kick_weight": F.when(F.col("kick") > 0.5, F.col("kick_positive_weight")).otherwise(1.0),
        }
    )
    mlp = MultilayerPerceptronClassifier(
        featuresCol="scaled", labelCol="direction_label", layers=[width, HIDDEN, DIRECTIONS], maxIter=epochs, seed=seed,
        predictionCol="direction_out", probabilityCol="direction_probability", rawPredictionCol="direction_raw",
    )
    logistic = LogisticRegression(
        featuresCol="scaled", labelCol="kick_label", weightCol="kick_weight", regParam=l2, maxIter=epochs,
        predictionCol="kick_out", probabilityCol="kick_vector", rawPredictionCol="kick_raw",
    )
    return ImitationModels(Pipeline(stages=[mlp]).fit(rows), Pipeline(stages=[logistic]).fit(rows), mean, std)


def gated_kick(probability: Column, threshold: float, ball_distance: Column | None = None) -> Column:
    """A kick needs the probability and, where known, the ball within reach."""
    likely = probability >= threshold
    return likely if ball_distance is None else likely & (ball_distance <= KICK_DISTANCE)


def score(
    models: ImitationModels, samples: DataFrame, features: str | list[str], *, threshold: float = 0.5, ball_distance: Column | None = None
) -> DataFrame:
    """Predicted direction with its confidence, kick probability and the gated kick (ML-03)."""
    scaled = samples.withColumn("scaled", scaled_vector(features, models.mean, models.std))
    out = models.kick.transform(models.direction.transform(scaled))
    probability = vector_to_array("kick_vector")[1]
    confidence = F.array_max(vector_to_array("direction_probability"))
    return out.select(
        *samples.columns,
        F.col("direction_out").cast("int").alias("direction_predicted"),
        confidence.alias("direction_confidence"),
        probability.alias("kick_probability"),
        gated_kick(probability, threshold, ball_distance).alias("kick_predicted"),
    )


def temporal_features(
    states: DataFrame, columns: list[str], *, window: int, role: Column | None = None, parts: int | None = None
) -> DataFrame:
    """The last ``window`` frames of a player's features in one array (WIN-09).

    Missing history repeats the earliest frame; an optional role is appended as one-hot.
    """
    rows = states.withColumn("_at", F.col("frame").cast("long"))
    current = F.array(*[F.col(c).cast("double") for c in columns])
    seen = recent_values(rows, ["replay", "player"], "_at", current, window, "_recent", parts=parts)
    padded = F.concat(F.array_repeat(F.col("_recent")[0], F.lit(window) - F.size("_recent")), F.col("_recent"))
    stack = F.flatten(padded)
    if role is not None:
        stack = F.concat(stack, F.array(*[F.when(role == r, 1.0).otherwise(0.0) for r in ROLE_ORDER]))
    return seen.select(*states.columns, stack.alias("temporal_features"))


@dataclass(frozen=True)
class Network:
    """Weights of a trained network: hidden layers, then one direction and one kick head on the last of them.

    A layer is (matrix of inputs by outputs, bias). The architecture fixes their size, so every task holds them.
    """

    hidden: tuple[tuple[np.ndarray, np.ndarray], ...]
    direction: tuple[np.ndarray, np.ndarray]
    kick: tuple[np.ndarray, np.ndarray]


def network_outputs(network: Network, features: Column) -> Column:
    """struct(direction, confidence, kick) of an array column: rectified layers, softmax and sigmoid.

    A null array, one of another width and one that holds a null give nulls. Of equally likely directions the
    first counts.
    """
    width = network.hidden[0][0].shape[0]

    @F.pandas_udf("direction int, confidence double, kick double")
    def forward(rows: pd.Series) -> pd.DataFrame:
        vectors = [None if r is None or len(r) != width else np.asarray(r, np.float64) for r in rows]
        good = np.array([v is not None and not np.isnan(v).any() for v in vectors], bool)
        out = pd.DataFrame({"direction": pd.array([None] * len(rows), "Int32"), "confidence": np.nan, "kick": np.nan})
        if good.any():
            layer = np.stack([v for v, g in zip(vectors, good, strict=True) if g])
            for weights, bias in network.hidden:
                layer = np.maximum(layer @ weights + bias, 0.0)
            logits = layer @ network.direction[0] + network.direction[1]
            power = np.exp(logits - logits.max(axis=1, keepdims=True))
            out.loc[good, "direction"] = logits.argmax(axis=1)
            out.loc[good, "confidence"] = power.max(axis=1) / power.sum(axis=1)
            out.loc[good, "kick"] = 1.0 / (1.0 + np.exp(-(layer @ network.kick[0] + network.kick[1]).reshape(-1)))
        return out.astype({"confidence": "Float64", "kick": "Float64"})

    return forward(features)


def score_with(network: Network, samples: DataFrame, features: str, *, threshold: float = 0.5, ball_distance: Column | None = None) -> DataFrame:
    """The same columns as :func:`score` from given weights instead of fitted models (ML-03)."""
    out = samples.withColumn("_n", network_outputs(network, F.col(features)))
    return out.select(
        *samples.columns,
        F.col("_n.direction").alias("direction_predicted"),
        F.col("_n.confidence").alias("direction_confidence"),
        F.col("_n.kick").alias("kick_probability"),
        gated_kick(F.col("_n.kick"), threshold, ball_distance).alias("kick_predicted"),
    )
