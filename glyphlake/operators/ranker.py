"""Merging of k-best paths over render states, and training of the local ranker."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import calibrate_monotone, dot, sigmoid


def merge_states(paths: DataFrame, k: int, alpha: float, beta: float, calibration: Sequence[tuple[float, float]] = (), reject: float = 0.5) -> DataFrame:
    """The k best readings of each line over all states: equal readings count once, by their best state.

    ``paths``: line_id, state, text, n, score. Rank is by score / (n + beta) ** alpha, then text. Confidence is the calibrated softmax share among the k; the
    margin to the runner-up is 0 for a lone reading; a rejection is reported, not applied.
    """
    norm = F.round(F.col("score") / F.pow(F.col("n") + beta, F.lit(alpha)), 9)
    own = paths.withColumn("norm", norm).groupBy("line_id", "text").agg(F.max(F.struct("norm", "state", "n", "score")).alias("b"))
    own = own.select("line_id", "text", "b.*")
    order = Window.partitionBy("line_id").orderBy(F.col("norm").desc(), "text")
    own = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    line = Window.partitionBy("line_id")
    share = F.exp(F.col("norm") - F.max("norm").over(line))
    own = own.withColumn("share", share).withColumn("share", F.col("share") / F.sum("share").over(line))
    own = own.withColumns({"confidence": calibrate_monotone(F.col("share"), list(calibration)), "margin": F.coalesce(F.col("norm") - F.lead("norm").over(order), F.lit(0.0))})
    return own.withColumn("rejected", F.col("confidence") < reject)


def pair_differences(rows: DataFrame) -> DataFrame:
    """One row for each wrong option of a candidate: the right option's features less its own. ``rows``: cand_id, right, features."""
    right = rows.where("right").select("cand_id", F.col("features").alias("good"))
    wrong = rows.where("not right").select("cand_id", F.col("features").alias("bad"))
    return right.join(wrong, "cand_id").select(F.zip_with("good", "bad", lambda a, b: a - b).alias("d"))


def train_ranker(differences: DataFrame, size: int, epochs: int = 10, rate: float = 0.5, l2: float = 1e-3) -> np.ndarray:
    """Pairwise logistic weights by full-batch descent; the rate falls by a fifth each epoch.

    A pass sums one gradient of ``size`` numbers over all pairs, added up in the tasks; only these numbers reach the driver.
    """
    weights = np.zeros(size)
    for epoch in range(epochs):
        wrongness = 1 - sigmoid(dot(F.col("d"), F.array(*(F.lit(float(w)) for w in weights))))
        own = differences.select("d", wrongness.alias("p"))
        sums = own.agg(F.count("*").alias("n"), *(F.sum(F.col("p") * F.col("d")[i]).alias(f"g{i}") for i in range(size))).first()
        if not sums.n:
            return weights
        gradient = np.array([sums[f"g{i}"] for i in range(size)]) / sums.n - l2 * weights
        weights = weights + rate * 0.8**epoch * gradient
    return weights
