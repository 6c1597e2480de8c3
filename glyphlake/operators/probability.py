"""Log-domain sums, priors, calibration and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import characters

#: Fixed values.
LEXICON_FLOOR, UNIGRAM_FLOOR, CHAR_PRIOR_BASE = -6.0, -8.0, 0.35
#: Ranges that rows are ranked in, a square; and rows that their bounds are taken from.
RANGES, BOUNDS_FROM = 256, 4096


def log_softmax(logits: DataFrame, key: str = "glyph_id", value: str = "logit") -> DataFrame:
    """log p of each class; a row of only -inf is uniform."""
    w = Window.partitionBy(key)
    top = F.max(value).over(w)
    out = logits.withColumns({"_m": top, "_n": F.count("*").over(w)})
    out = out.withColumn("_s", F.ln(F.sum(F.when(F.col("_m") == float("-inf"), 0.0).otherwise(F.exp(F.col(value) - F.col("_m")))).over(w)))
    return out.withColumn("log_p", F.when(F.col("_m") == float("-inf"), -F.ln("_n")).otherwise(F.col(value) - F.col("_m") - F.col("_s"))).drop("_m", "_n", "_s")


def logsumexp_group(df: DataFrame, key: str, value: str) -> DataFrame:
    """Stable in two passes: the largest by group, then the sum of what is left; both are pre-aggregated."""
    top = df.groupBy(key).agg(F.max(value).alias("_m"))
    return df.join(top, key).groupBy(key).agg(F.max("_m").alias("_m"), F.sum(F.exp(F.col(value) - F.col("_m"))).alias("_s")).select(key, F.when(F.col("_m") == float("-inf"), F.col("_m")).otherwise(F.col("_m") + F.ln("_s")).alias("lse"))


def char_counts(lexicon: DataFrame, distinct_in_term: bool = False) -> DataFrame:
    """Occurrences of each character (or the number of terms that hold it)."""
    chars = characters(F.col("term"))
    return lexicon.select(F.explode(F.array_distinct(chars) if distinct_in_term else chars).alias("ch")).groupBy("ch").agg(F.count("*").alias("n"))


def lexicon_prior(counts: DataFrame, floor: float = LEXICON_FLOOR) -> DataFrame:
    """ln(count / largest count), floored."""
    top = counts.agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(top)).select("ch", "n", F.greatest(F.ln(F.col("n") / F.col("most")), F.lit(floor)).alias("log_p"))  # one row


def unigram_prior(counts: DataFrame, floor: float = UNIGRAM_FLOOR) -> DataFrame:
    """ln(count / total), floored."""
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("ch", "n", F.greatest(F.ln(F.col("n") / F.col("total")), F.lit(floor)).alias("log_p"))  # one row


def gated_char_prior(counts: DataFrame) -> DataFrame:
    """0.35 + 0.65 of the share of the largest count."""
    top = counts.agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(top)).select("ch", (CHAR_PRIOR_BASE + (1 - CHAR_PRIOR_BASE) * F.col("n") / F.col("most")).alias("prior"))  # one row


def open_set_options(logits: DataFrame, temperature: float, background: float, k: int) -> DataFrame:
    """log p over the k best classes and a background class of fixed logit, whose id is -1."""
    from .ranking import topk

    best = topk(logits, k).select("glyph_id", "char_id", (F.col("logit") / temperature).alias("logit"))
    open_ = logits.select("glyph_id").distinct().select("glyph_id", F.lit(-1).alias("char_id"), F.lit(float(background)).alias("logit"))
    return log_softmax(best.unionByName(open_)).select("glyph_id", "char_id", "log_p")


def spread(df: DataFrame, *order: str) -> DataFrame:
    """Add ``_range``: 0 to RANGES - 1 by the order's columns, of about equal size.

    Bounds come from at most BOUNDS_FROM rows of smallest hash; they decide how even the ranges are, never a result. A row finds its range by two short looks.
    """
    rows = sorted(tuple(r) for r in df.select(*order).dropna().distinct().orderBy(F.xxhash64(*order), *order).limit(BOUNDS_FROM).collect())
    bounds = [rows[len(rows) * k // RANGES] for k in range(1, RANGES)] if rows else []
    if not bounds:
        return df.withColumn("_range", F.lit(0))
    step = int(RANGES**0.5)
    literal = lambda b: F.struct(*(F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, b, strict=True)))
    own = F.struct(*order)
    below = lambda some: F.size(F.filter(some, lambda b: b <= own))
    fine = F.array(*(F.array(*map(literal, bounds[at : at + step - 1])) for at in range(0, RANGES, step)))
    coarse = F.array(*map(literal, bounds[step - 1 :: step]))
    return df.withColumn("_c", below(coarse)).withColumn("_range", F.col("_c") * step + below(F.element_at(fine, F.col("_c") + 1))).drop("_c")


def counted_ranges(own: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _range, _before, _n): rows before each range and in all, at most RANGES rows a key."""
    per = own.groupBy(*keys, "_range").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys).orderBy("_range") if keys else Window.orderBy("_range")
    before = F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return per.select(*keys, "_range", before.alias("_before"), whole.alias("_n"))


def equal_mass_bins(df: DataFrame, value: str, tie: str, bins: int) -> DataFrame:
    """Add ``bin`` of equal mass by value: ((i + 1) b - 1) div n of the row's rank i, with b = min(bins, n).

    Ranks are global without one task seeing all rows: rows are ranked within ranges of value and tie, after the rows of the ranges before.
    """
    own = spread(df, value, tie)
    out = own.join(F.broadcast(counted_ranges(own, [])), "_range").withColumn("_i", F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(value, tie)) - 1)  # at most RANGES rows
    b = F.least(F.lit(bins), F.col("_n"))
    return out.withColumn("bin", F.floor(((F.col("_i") + 1) * b - 1) / F.col("_n"))).drop("_before", "_i", "_range")


def calibration_metrics(df: DataFrame, bins: int = 10, confidence: str = "confidence", correct: str = "correct", tie: str = "id") -> DataFrame:
    """n, accuracy, Brier score and expected calibration error over bins of equal mass."""
    own = equal_mass_bins(df.withColumn("_hit", F.col(correct).cast("double")), confidence, tie, bins)
    per = own.groupBy("bin", "_n").agg(F.count("*").alias("c"), F.avg(confidence).alias("conf"), F.avg("_hit").alias("acc"), F.sum((F.col(confidence) - F.col("_hit")) ** 2).alias("sq"), F.sum("_hit").alias("hits"))
    return per.agg(F.max("_n").alias("n"), (F.sum("hits") / F.max("_n")).alias("accuracy"), (F.sum("sq") / F.max("_n")).alias("brier"), F.sum(F.abs(F.col("conf") - F.col("acc")) * F.col("c") / F.col("_n")).alias("ece"))


def fit_calibration(df: DataFrame, bins: int, confidence: str = "confidence", correct: str = "correct", tie: str = "id") -> DataFrame:
    """Points of a monotone calibration: bin means, Laplace-smoothed hits, running maximum; (0,0) before the first bin and (1,1) after the last."""
    own = equal_mass_bins(df.withColumn("_hit", F.col(correct).cast("double")), confidence, tie, bins)
    per = own.groupBy("bin").agg(F.avg(confidence).alias("x"), ((F.sum("_hit") + 1) / (F.count("*") + 2)).alias("raw"))
    ends = per.agg(F.array(F.struct(F.lit(-1).cast("long").alias("bin"), F.lit(0.0).alias("x"), F.lit(0.0).alias("raw")), F.struct((F.coalesce(F.max("bin"), F.lit(-1)) + 1).alias("bin"), F.lit(1.0).alias("x"), F.lit(1.0).alias("raw"))).alias("e"))
    points = per.unionByName(ends.select(F.explode("e").alias("e")).select("e.*"))  # a row for each bin
    return points.withColumn("y", F.max("raw").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).select("bin", "x", "y")


def grouped_split(sessions: DataFrame, key: str, test: float = 0.2, val: float = 0.15) -> DataFrame:
    """train, val or test by whole session, in a fixed pseudo-random order. Sessions are ranked within ranges of the hash, so no task sees all."""
    hashed = sessions.select(key).distinct().withColumn("_h", (F.col(key) * F.lit(2654435761)) % F.lit(4294967296)).withColumn("_r", F.floor(F.col("_h") / F.lit(1 << 22)))
    ranges = hashed.groupBy("_r").agg(F.count("*").alias("_c"))  # at most 1024 rows
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = hashed.agg(F.count("*").alias("_n"))
    own = hashed.join(F.broadcast(ranges), "_r").join(F.broadcast(total)).withColumn("_i", F.col("_before") + F.row_number().over(Window.partitionBy("_r").orderBy("_h", key)))
    n_test, n_val = F.bround(F.col("_n") * test), F.bround(F.col("_n") * val)
    return own.select(key, F.when(F.col("_i") <= n_test, "test").when(F.col("_i") <= n_test + n_val, "val").otherwise("train").alias("split"))


def median_p95(df: DataFrame, key: str, value: str) -> DataFrame:
    """Median, the ceil(.95 n)-th value and the value at index int(.95 n).

    A key may hold most rows: its values are counted, ranges of them are added up, and only the ranges that hold a wanted rank are put in order.
    """
    counts = spread(df.where(F.col(value).isNotNull()), value).groupBy(key, "_range", value).agg(F.count("*").alias("_m"))
    per = counts.groupBy(key, "_range").agg(F.sum("_m").alias("_c"))
    line = Window.partitionBy(key).orderBy("_range")
    per = per.withColumns({"_before": F.sum("_c").over(line) - F.col("_c"), "_n": F.sum("_c").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    n = F.col("_n")
    wanted = {"low": F.floor((n + 1) / 2), "high": F.floor(n / 2) + 1, "p95_ceil": F.ceil(F.lit(0.95) * n), "p95_index": F.floor(F.lit(0.95) * n) + 1}
    inside = lambda r: (r > F.col("_before")) & (r <= F.col("_before") + F.col("_c"))
    ranks = F.filter(F.array(*(F.struct(F.lit(k).alias("name"), r.cast("long").alias("at")) for k, r in wanted.items())), lambda x: inside(x["at"]))
    few = per.withColumn("_w", ranks).where(F.size("_w") > 0).select(key, "_range", "_before", "_w")
    placed = counts.join(few, [key, "_range"]).withColumn("_end", F.col("_before") + F.sum("_m").over(Window.partitionBy(key, "_range").orderBy(value)))
    hit = placed.withColumn("w", F.explode("_w")).where((F.col("w.at") <= F.col("_end")) & (F.col("w.at") > F.col("_end") - F.col("_m")))
    got = lambda k: F.max(F.when(F.col("w.name") == k, F.col(value)))
    return hit.groupBy(key).agg(((got("low") + got("high")) / 2).alias("median"), got("p95_ceil").alias("p95_ceil"), got("p95_index").alias("p95_index"))


def marginalize(scores: DataFrame, keys: list[str], use_max: bool = False) -> DataFrame:
    """logsumexp (or max) over states and the best state; NaN counts as -inf."""
    clean: Column = F.when(F.isnan("score"), float("-inf")).otherwise(F.col("score"))
    own = scores.withColumn("score", clean)
    top = own.groupBy(*keys).agg(F.max("score").alias("_m"), F.max(F.struct("score", F.col("state"))).alias("_b"))
    if use_max:
        return top.select(*keys, F.col("_m").alias("marginal"), F.col("_b.state").alias("state"))
    both = own.join(top, keys).groupBy(*keys).agg(F.max("_m").alias("_m"), F.max("_b").alias("_b"), F.sum(F.exp(F.col("score") - F.col("_m"))).alias("_s"))
    return both.select(*keys, F.when(F.col("_m") == float("-inf"), F.col("_m")).otherwise(F.col("_m") + F.ln("_s")).alias("marginal"), F.col("_b.state").alias("state"))


def select_states(votes: DataFrame, key: str, m: int) -> DataFrame:
    """The m most voted states (ties by name), and ``clean`` always."""
    ranked = votes.groupBy(key, "state").agg(F.sum("votes").alias("votes")).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("votes").desc(), "state"))).where(F.col("rank") <= m)
    clean = votes.select(key).distinct().select(key, F.lit("clean").alias("state"))
    return ranked.select(key, "state").unionByName(clean).distinct()
