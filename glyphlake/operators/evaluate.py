"""Evaluation and tuning over tables of decoded lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import clamp
from ..functions.text import sequence_cer


def split_metrics(lines: DataFrame) -> DataFrame:
    """By split: lines, exact matches, CER, mean NLL and the share rejected. ``lines``: split, text, truth, confidence, nll."""
    own = lines.withColumn("hit", (F.col("text") == F.col("truth")).cast("double"))
    return own.groupBy("split").agg(F.count("*").alias("n_lines"), F.avg("hit").alias("exact_match"), F.avg(sequence_cer(F.col("text"), F.col("truth"))).alias("cer"), F.avg("nll").alias("nll"), F.avg((F.col("confidence") < 0.5).cast("double")).alias("reject_rate"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """How two decoders differ over the same lines: (line_id, text, truth) each."""
    both = a.select("line_id", "truth", F.col("text").alias("ta")).join(b.select("line_id", F.col("text").alias("tb")), "line_id")
    ok_a, ok_b = F.col("ta") == F.col("truth"), F.col("tb") == F.col("truth")
    return both.agg(F.count("*").alias("n"), F.count_if(ok_a & ~ok_b).alias("regressed"), F.count_if(~ok_a & ok_b).alias("improved"), F.count_if(~ok_a & ~ok_b).alias("both_failed"), F.count_if(~ok_b & (F.col("tb") != "")).alias("wrong"))


def weight_grid(scores: DataFrame, cnn: list[float], template: list[float], geometry: list[float], most: float = 0.9) -> DataFrame:
    """Accuracy and mean score of the right class for each weighting, best first. ``scores``: sample_id, char_id, cnn, template, geometry, truth.

    The grid is a handful of rows, spread over each score as an array: no cross join.
    """
    grid = [(c, t, g) for c in cnn for t in template for g in geometry if c + t <= most + 1e-9]
    points = F.array(*(F.struct(F.lit(c).alias("w_cnn"), F.lit(t).alias("w_template"), F.lit(g).alias("w_geometry")) for c, t, g in grid))
    own = scores.withColumn("p", F.explode(points)).select("*", "p.*")
    own = own.withColumn("score", F.round(clamp(F.col("w_cnn") * F.col("cnn") + F.col("w_template") * F.col("template") + F.col("w_geometry") * F.col("geometry"), 0.0, 1.0), 9))
    keys = ["w_cnn", "w_template", "w_geometry"]
    best = own.groupBy(*keys, "sample_id").agg(F.max(F.struct("score", (-F.col("char_id")).alias("k"), "truth")).alias("b"))
    hit = (-F.col("b.k") == F.col("b.truth")).cast("double")
    return best.groupBy(*keys).agg(F.round(F.avg(hit), 9).alias("accuracy"), F.round(F.avg(F.when(hit == 1, F.col("b.score"))), 6).alias("mean_score"))


def recall_report(lines: DataFrame) -> DataFrame:
    """Lines, recalled ones and the share, from ``recalled``."""
    return lines.agg(F.count("*").alias("n_lines"), F.count_if("recalled").alias("n_recalled"), F.avg(F.col("recalled").cast("double")).alias("recall"))
