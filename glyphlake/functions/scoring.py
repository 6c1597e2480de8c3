"""Scalar score functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
RANK_TABLE = (1.0, 0.85, 0.70, 0.55, 0.40)
CNN_SCALE = 1.0
NEGATIVE_INFINITY = float("-inf")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def clamp_log_prob(x: Column, low: float = -30.0, high: float = 0.0) -> Column:
    return clamp(x, low, high)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def cnn_char_score(logit: Column, second: Column) -> Column:
    """Sigmoid of the lead over the second logit; none: 0; no second: 1."""
    return F.when(logit.isNull() | (logit == NEGATIVE_INFINITY), 0.0).when(second.isNull() | (second == NEGATIVE_INFINITY), 1.0).otherwise(sigmoid(logit - second))


def unified_visual_score(template: Column, cnn: Column, geometry: Column, w_cnn: float = 0.45, w_template: float = 0.45, w_geometry: float = 0.10) -> Column:
    return clamp(w_cnn * cnn + w_template * template + w_geometry * geometry, 0.0, 1.0)


def temperature_scale(x: Column, temperature: float) -> Column:
    if not (temperature > 0 and temperature != float("inf")):
        raise ValueError("temperature must be positive and finite")
    return x / temperature


def check_points(points: Sequence[tuple[float, float]]) -> None:
    """x strictly ascending, y not descending."""
    if any(b[0] <= a[0] or b[1] < a[1] for a, b in zip(points, points[1:], strict=False)):
        raise ValueError("calibration points must ascend")


def piecewise(x: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Linear interpolation, flat outside; identity without points."""
    check_points(points)
    if not points:
        return x
    out = F.when(x <= points[0][0], F.lit(float(points[0][1])))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(float(points[-1][1])))


def calibrate_monotone(x: Column, points: Sequence[tuple[float, float]]) -> Column:
    return piecewise(clamp(x, 0.0, 1.0), points)


def calibrate_log_monotone(x: Column, points: Sequence[tuple[float, float]]) -> Column:
    return piecewise(x, points)


def rank_weight(rank: Column, confidence: Column) -> Column:
    """Support of a top-k rank, softened by confidence."""
    table = F.array(*(F.lit(w) for w in RANK_TABLE))
    return F.element_at(table, F.least(rank, F.lit(len(RANK_TABLE) - 1)) + 1) * (0.5 + 0.5 * confidence)


def topk_rank_weight(alternatives: Column, decoded: Column, target: Column, k: int) -> Column:
    """1 for the decoded character; else by its place in the list: .85, .70, .60 below k, .35 after; absent 0."""
    at = F.array_position(alternatives, target)
    return F.when(target == decoded, 1.0).when(at == 0, 0.0).when(at == 1, 0.85).when(at == 2, 0.70).when(at <= k, 0.60).otherwise(0.35)


def finite_logit(x: Column) -> Column:
    """Neither NaN nor +infinity."""
    return ~F.isnan(x) & (x != float("inf"))


def all_finite(values: Column) -> Column:
    return F.forall(values, lambda v: ~F.isnan(v) & (F.abs(v) != float("inf")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def linear(features: Column, weights: Sequence[float], intercept: float) -> Column:
    """Dot product with fixed weights and an intercept."""
    return dot(features, F.array(*(F.lit(float(w)) for w in weights))) + intercept


def normalize_features(features: Column, mean: Sequence[float], std: Sequence[float], limit: float = 4.0) -> Column:
    """(f - mean) / std, 0 where std is 0, clipped."""
    both = F.arrays_zip(features.alias("f"), F.array(*(F.lit(float(m)) for m in mean)).alias("m"), F.array(*(F.lit(float(s)) for s in std)).alias("s"))
    return F.transform(both, lambda x: F.when(x["s"] == 0, 0.0).otherwise(clamp((x["f"] - x["m"]) / x["s"], -limit, limit)))


def ncc(a: Column, b: Column) -> Column:
    """Mean-centred cosine of two arrays of one size; 0 where either is flat."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    n = F.size(a)
    norm = F.sqrt((dot(a, a) - total(a) ** 2 / n) * (dot(b, b) - total(b) ** 2 / n))
    return F.when(norm > 0, (dot(a, b) - total(a) * total(b) / n) / norm).otherwise(0.0)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Interval overlap; negative is a gap."""
    return F.least(a1, b1) - F.greatest(a0, b0)
