"""Feature statistics and model metrics as single aggregations."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.rows import attach

DIRECTIONS = 9
# Threshold grid 0.05 to 0.95 in 37 steps, limits of the kick weight and of the variance.
THRESHOLDS = [0.05 + i * 0.9 / 36 for i in range(37)]
DEFAULT_THRESHOLD = 0.5
KICK_WEIGHT_LIMIT = 25.0
MINIMUM_VARIANCE, MINIMUM_DEVIATION = 1e-8, 1e-4


def vector_moments(samples: DataFrame, vector: str) -> DataFrame:
    """Mean and deviation of every position of an array column (AGG-18): (position, mean, std).

    Variance is at least 1e-8 and tiny deviations become 1. The vectors are summed up as vectors, one partial
    sum a task, so no row is made per element. Null vectors and those that hold a null take no part; the others
    must have one width; an empty table gives no rows.
    """
    whole = samples.filter(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    vectors = whole.select(array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    metrics = Summarizer.metrics("count", "mean", "variance").summary(F.col("_v"))
    sums = vectors.groupBy(F.lit(1).alias("_all")).agg(metrics.alias("_s"))
    each = F.arrays_zip(vector_to_array("_s.mean").alias("mean"), vector_to_array("_s.variance").alias("variance"))
    long = sums.select(F.col("_s.count").alias("_n"), F.posexplode(each).alias("position", "_m"))
    # the summary divides by one less than the number of rows
    variance = F.col("_m.variance") * (F.col("_n") - 1) / F.col("_n")
    deviation = F.sqrt(F.greatest(variance, F.lit(MINIMUM_VARIANCE)))
    return long.select(
        "position", F.col("_m.mean").alias("mean"), F.when(deviation < MINIMUM_DEVIATION, 1.0).otherwise(deviation).alias("std")
    )


def label_statistics(samples: DataFrame) -> DataFrame:
    """Samples, direction counts, kick counts and the weight of a kick (AGG-18). Columns: direction, kick."""
    positive = F.count_if(F.col("kick") > 0.5)
    counts = samples.agg(
        F.count(F.lit(1)).alias("samples"),
        F.array(*[F.count_if(F.col("direction") == d) for d in range(DIRECTIONS)]).alias("direction_counts"),
        positive.alias("kick_positive"),
    )
    negative = F.col("samples") - F.col("kick_positive")
    weight = F.when(
        F.col("kick_positive") > 0, F.least(F.lit(KICK_WEIGHT_LIMIT), F.greatest(F.lit(1.0), negative / F.col("kick_positive")))
    ).otherwise(1.0)
    return counts.select(
        "*",
        negative.alias("kick_negative"),
        (F.col("kick_positive") / F.col("samples")).alias("kick_positive_rate"),
        weight.alias("kick_positive_weight"),
    )


def _confusion(predicted: Column, truth: Column) -> list[Column]:
    return [
        F.count_if(predicted & truth).alias("tp"),
        F.count_if(predicted & ~truth).alias("fp"),
        F.count_if(~predicted & truth).alias("fn"),
        F.count_if(~predicted & ~truth).alias("tn"),
    ]


def _derived() -> dict[str, Column]:
    tp, fp, fn, tn, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "samples"))
    one = F.lit(1)
    precision, recall = tp / F.greatest(one, tp + fp), tp / F.greatest(one, tp + fn)
    return {
        "kick_precision": precision,
        "kick_recall": recall,
        "kick_f1": 2.0 * precision * recall / F.greatest(F.lit(1e-12), precision + recall),
        "kick_true_rate": (tp + fn) / n,
        "kick_predicted_rate": (tp + fp) / n,
        "always_no_kick_accuracy": (tn + fp) / n,
    }


def evaluate(predictions: DataFrame, threshold: float = DEFAULT_THRESHOLD, keys: list[str] | None = None) -> DataFrame:
    """Accuracies, confusion, precision, recall, F1 and baselines in one aggregation (AGG-19).

    Columns: direction, direction_predicted, kick (0/1), kick_probability. ``keys`` gives one row per group.
    """
    predicted = F.col("kick_probability") >= threshold
    truth = F.col("kick") > 0.5
    right = F.col("direction") == F.col("direction_predicted")
    counts = predictions.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(right).alias("_right"),
        F.count_if(right & (predicted == truth)).alias("_joint"),
        *_confusion(predicted, truth),
        F.greatest(*[F.count_if(F.col("direction") == d) for d in range(DIRECTIONS)]).alias("_major"),
    )
    n = F.col("samples")
    return counts.select(
        *(keys or []),
        "samples",
        (F.col("_right") / n).alias("direction_accuracy"),
        (F.col("_joint") / n).alias("joint_accuracy"),
        *[c.alias(name) for name, c in _derived().items()],
        F.lit(float(threshold)).alias("kick_threshold"),
        "tp", "fp", "fn", "tn",
        (F.col("_major") / n).alias("majority_direction_accuracy"),
    )


def threshold_sweep(predictions: DataFrame) -> DataFrame:
    """Confusion and F1 at every candidate threshold.

    A prediction is counted once, at the highest threshold it still reaches; the counts of the 37 steps
    are then added up. The rows are never multiplied by the grid.
    """
    grid = F.array(*[F.lit(t) for t in THRESHOLDS])
    reached = F.size(F.filter(grid, lambda t: t <= F.col("kick_probability")))
    steps = predictions.groupBy(F.when(F.col("kick_probability").isNull(), 0).otherwise(reached).alias("_reached")).agg(
        F.count_if(F.col("kick") > 0.5).alias("_pos"), F.count_if(~(F.col("kick") > 0.5)).alias("_neg")
    )
    # The grid is unfolded over at most 38 count rows.
    unfolded = steps.select("*", F.posexplode(grid).alias("step", "threshold"))
    sums = unfolded.groupBy("step", "threshold").agg(
        *[
            F.sum(F.when(condition, F.col(side)).otherwise(0)).alias(name)
            for name, side, condition in (
                ("tp", "_pos", F.col("_reached") > F.col("step")),
                ("fp", "_neg", F.col("_reached") > F.col("step")),
                ("fn", "_pos", F.col("_reached") <= F.col("step")),
                ("tn", "_neg", F.col("_reached") <= F.col("step")),
            )
        ]
    )
    counted = sums.withColumn("samples", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return counted.select("threshold", "tp", "fp", "fn", "tn", _derived()["kick_f1"].alias("kick_f1"))


def best_threshold(predictions: DataFrame) -> DataFrame:
    """The lowest threshold with the best F1, but 0.5 unless something is strictly better (AGG-20)."""
    sweep = threshold_sweep(predictions)
    base = evaluate(predictions).select(F.col("kick_f1").alias("_base"))
    best = sweep.agg(F.min(F.struct((-F.col("kick_f1")).alias("f"), "threshold")).alias("_b"))
    row = attach(best.select(F.col("_b.threshold").alias("_t"), (-F.col("_b.f")).alias("_f")), base)
    better = F.col("_f") > F.col("_base")
    return row.select(
        F.when(better, F.col("_t")).otherwise(DEFAULT_THRESHOLD).alias("kick_threshold"),
        F.when(better, F.col("_f")).otherwise(F.col("_base")).alias("kick_f1"),
    )
