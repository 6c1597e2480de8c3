"""Top-k, margins, masks and fusion over long tables (glyph_id, char_id, logit)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import clamp, cnn_char_score


def order_of(keys: list[str], value: str = "logit", tie: str = "char_id"):
    return Window.partitionBy(*keys).orderBy(F.col(value).desc(), F.col(tie))


def topk(logits: DataFrame, k: int, keys: tuple[str, ...] = ("glyph_id",)) -> DataFrame:
    """The k best by (-logit, char_id); the limit is pushed below the shuffle as a group limit."""
    return logits.withColumn("rank", F.row_number().over(order_of(list(keys)))).where(F.col("rank") <= k)


def top2_margin(logits: DataFrame) -> DataFrame:
    """Best id, second id (-1) and margin (infinite second: margin to -inf is +inf)."""
    best = topk(logits, 2).groupBy("glyph_id").agg(F.max(F.when(F.col("rank") == 1, F.col("char_id"))).alias("top_id"), F.max(F.when(F.col("rank") == 1, F.col("logit"))).alias("top"), F.max(F.when(F.col("rank") == 2, F.col("char_id"))).alias("second"), F.max(F.when(F.col("rank") == 2, F.col("logit"))).alias("next"))
    return best.select("glyph_id", "top_id", "top", F.coalesce("second", F.lit(-1)).alias("second_id"), (F.col("top") - F.coalesce("next", F.lit(float("-inf")))).alias("margin"))


def allowed(logits: DataFrame, ids: DataFrame) -> DataFrame:
    """Only allowed classes, before any ranking."""
    return logits.join(ids, "char_id", "left_semi")


def gather(logits: DataFrame, wanted: DataFrame) -> DataFrame:
    """Logits of given (glyph_id, char_id)."""
    return wanted.join(logits, ["glyph_id", "char_id"])


def pick(logits: DataFrame, charset: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Best character and margin; one class gives margin 1, none gives ``?`` and 0."""
    own = logits if ids is None else allowed(logits, ids)
    best = top2_margin(own).join(charset.select(F.col("char_id").alias("top_id"), "ch"), "top_id", "left")
    out = logits.select("glyph_id").distinct().join(best, "glyph_id", "left")
    return out.select("glyph_id", F.coalesce("ch", F.lit("?")).alias("ch"), F.when(F.col("top_id").isNull(), 0.0).when(F.col("second_id") == -1, 1.0).otherwise(F.col("margin")).alias("margin"))


def fuse(template: DataFrame, cnn: DataFrame, w_cnn: float, w_template: float) -> DataFrame:
    """Full outer join of two top-k lists on the class; a missing side scores 0."""
    second = cnn.where("rank = 2").select("glyph_id", F.col("logit").alias("second"))
    both = template.select("glyph_id", "char_id", F.col("score").alias("template_score")).join(cnn.select("glyph_id", "char_id", "logit"), ["glyph_id", "char_id"], "full")
    both = both.join(second, "glyph_id", "left").withColumn("cnn_score", cnn_char_score(F.col("logit"), F.col("second")))
    both = both.withColumn("template_score", F.coalesce("template_score", F.lit(0.0)))
    both = both.withColumn("combined", clamp(w_cnn * F.col("cnn_score") + w_template * F.col("template_score"), 0.0, 1.0))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("glyph_id").orderBy(F.col("combined").desc(), "char_id")))


def fuse_trusted(fused: DataFrame, trusted: DataFrame) -> DataFrame:
    """Pin the trusted template's class first with the larger of its scores; the others keep their order."""
    own = fused.join(trusted.select("glyph_id", F.col("char_id").alias("pin"), F.col("score").alias("pin_score")), "glyph_id", "left")
    pinned = F.col("char_id") == F.col("pin")
    own = own.withColumn("combined", F.when(pinned, F.greatest("combined", "pin_score")).otherwise(F.col("combined")))
    order = Window.partitionBy("glyph_id").orderBy(F.when(pinned, 0).otherwise(1), F.col("combined").desc(), "char_id")
    return own.withColumn("rank", F.row_number().over(order)).drop("pin", "pin_score")


def estimate(costs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Piecewise-linear cost of a batch size by backend; the end segments go on outside."""
    w = Window.partitionBy("backend").orderBy("batch")
    own = costs.withColumns({"batch1": F.lead("batch").over(w), "cost1": F.lead("cost").over(w), "k": F.row_number().over(w), "last": F.lead("batch", 2).over(w).isNull()})
    own = own.where("batch1 is not null")
    inside = ((F.col("n") >= F.col("batch")) | (F.col("k") == 1)) & ((F.col("n") < F.col("batch1")) | F.col("last"))
    line = F.col("cost") + (F.col("n") - F.col("batch")) * (F.col("cost1") - F.col("cost")) / (F.col("batch1") - F.col("batch"))
    return sizes.join(F.broadcast(own), inside).select("n", "backend", line.alias("estimate"))  # a backend has a handful of measured sizes


def crossover(costs: DataFrame, fast: str, base: str) -> DataFrame:
    """The smallest measured size at which ``fast`` wins."""
    a, b = (costs.where(F.col("backend") == x).select("batch", F.col("cost").alias(x)) for x in (fast, base))
    return a.join(b, "batch").where(F.col(fast) < F.col(base)).agg(F.min("batch").alias("crossover"))
