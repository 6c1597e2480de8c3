"""From fused scores to what a caller sees: best alternatives with margin and confidence, raw evidence, scores of a chosen character."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import CNN_SCALE, NEGATIVE_INFINITY, calibrate_monotone, clamp, sigmoid

#: Alternatives that are kept, and the weight of geometry.
KEPT = 5
GEOMETRY = 0.10

Points = Sequence[tuple[float, float]]


def to_confidence(raw: Column, kind: Column) -> Column:
    """A template's score as it is, a network's lead by the sigmoid, anything else 0."""
    return F.when(kind == "template", clamp(raw, 0.0, 1.0)).when(kind == "cnn", sigmoid(raw / CNN_SCALE)).otherwise(0.0)


def best_alternatives(fused: DataFrame, points: Points = (), key: str = "glyph_id", kept: int = KEPT) -> DataFrame:
    """The ``kept`` best characters of each glyph with their rank; margin of the first over the second (over 0 if it stands alone) and its calibrated confidence.

    ``fused``: key, char_id, visual. Ties by char_id. Margin and confidence stand with the first rank only.
    """
    order = Window.partitionBy(key).orderBy(F.col("visual").desc(), "char_id")
    ranked = fused.withColumns({"rank": F.row_number().over(order), "_next": F.lead("visual", 1, 0.0).over(order)}).where(F.col("rank") <= kept)
    first = F.col("rank") == 1
    return ranked.withColumns({"margin": F.when(first, F.col("visual") - F.col("_next")), "confidence": F.when(first, calibrate_monotone(F.col("visual"), points))}).drop("_next")


def raw_evidence(kept: DataFrame, template: DataFrame, cnn: DataFrame, key: str = "glyph_id") -> DataFrame:
    """Beside each kept character its template score (0 if templates did not rank it) and its logit (-infinity if the network did not)."""
    own = kept.join(template.select(key, "char_id", F.col("score").alias("template_score")), [key, "char_id"], "left")
    own = own.join(cnn.select(key, "char_id", F.col("logit").alias("cnn_logit")), [key, "char_id"], "left")
    return own.withColumns({"template_score": F.coalesce("template_score", F.lit(0.0)), "cnn_logit": F.coalesce("cnn_logit", F.lit(NEGATIVE_INFINITY))})


def finalize(visual: Column, geometry: Column, points: Points = (), weight: float = GEOMETRY) -> dict[str, Column]:
    """Visual score with geometry, and its calibrated confidence."""
    whole = clamp(visual + weight * geometry, 0.0, 1.0)
    return {"visual": whole, "confidence": calibrate_monotone(whole, points), "geometry_contribution": weight * geometry}


def chosen_scores(chosen: DataFrame, kept: DataFrame, points: Points = (), weight: float = GEOMETRY, key: str = "glyph_id") -> DataFrame:
    """The chosen character's own score, never the first one's: 0 if it isn't among the kept. ``chosen``: key, char_id, geometry."""
    own = chosen.join(kept.select(key, "char_id", F.col("visual").alias("classifier_score")), [key, "char_id"], "left").withColumn("classifier_score", F.coalesce("classifier_score", F.lit(0.0)))
    return own.withColumns(finalize(F.col("classifier_score"), F.col("geometry"), points, weight))
