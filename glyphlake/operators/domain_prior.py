"""Priors of characters by domain: open text, allowed characters, lexicon; calibrated, floored, and chosen per call.

A prior is a table (char_id, log_p) over a charset (char_id, ch); forbidden characters have -infinity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import NEGATIVE_INFINITY, calibrate_log_monotone
from .probability import LEXICON_FLOOR, UNIGRAM_FLOOR, char_counts

Points = Sequence[tuple[float, float]]


def uniform(charset: DataFrame, allowed: DataFrame | None = None, restrict: bool = True) -> DataFrame:
    """-ln of the number of characters for each that may be, -infinity for the others.

    Without ``restrict`` an empty ``allowed`` means all characters (open text); with it, none.
    """
    if allowed is None:
        own, size = charset.withColumn("_ok", F.lit(True)), charset.agg(F.count("*").alias("_n"))
    else:
        ids = allowed.select("char_id").distinct().withColumn("_ok", F.lit(True))
        own, size = charset.join(ids, "char_id", "left"), ids.agg(F.count("*").alias("_n"))
        if not restrict:
            both = size.crossJoin(charset.agg(F.count("*").alias("_all")))  # one row each
            size = both.select(F.when(F.col("_n") == 0, F.col("_all")).otherwise(F.col("_n")).alias("_n"), (F.col("_n") == 0).alias("_any"))
            own = own.join(F.broadcast(size.select("_any"))).withColumn("_ok", F.col("_ok") | F.col("_any"))  # one row
            size = size.select("_n")
    return own.join(F.broadcast(size)).select("char_id", F.when(F.col("_ok"), -F.ln(F.greatest("_n", F.lit(1)))).otherwise(NEGATIVE_INFINITY).alias("log_p"))  # one row


def open_text(charset: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    return uniform(charset, allowed, restrict=False)


def allowed_chars(charset: DataFrame, allowed: DataFrame) -> DataFrame:
    return uniform(charset, allowed)


def supported(charset: DataFrame, counts: DataFrame, whole: Column, points: Points, floor: float) -> DataFrame:
    """ln(count / whole), calibrated and floored; a character without a count has the floor."""
    size = counts.agg(F.greatest(whole, F.lit(1)).alias("_whole"))
    own = charset.join(counts, "ch", "left").join(F.broadcast(size))  # one row
    raw = F.ln(F.col("n") / F.col("_whole"))
    return own.select("char_id", F.when(F.coalesce("n", F.lit(0)) <= 0, floor).otherwise(F.greatest(calibrate_log_monotone(raw, points), F.lit(floor))).alias("log_p"))


def lexicon_prior(charset: DataFrame, lexicon: DataFrame, points: Points = (), floor: float = LEXICON_FLOOR) -> DataFrame:
    """By the share of the most frequent character of the terms."""
    counts = char_counts(lexicon).join(charset.select("ch"), "ch", "left_semi")
    return supported(charset, counts, F.max("n"), points, floor)


def unigram_prior(charset: DataFrame, counts: DataFrame, points: Points = (), floor: float = UNIGRAM_FLOOR) -> DataFrame:
    return supported(charset, counts, F.sum("n"), points, floor)


def choose(charset: DataFrame, config: dict | None = None, allowed: DataFrame | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """What a call names comes before the configuration: allowed characters with a lexicon, then either alone, then open text.

    An empty set of allowed characters forbids all of them. A lexicon is calibrated if the configuration has points.
    """
    points = [tuple(map(float, p)) for p in (config or {}).get("calibration") or ()]
    floor = float((config or {}).get("floor_log_p", LEXICON_FLOOR)) if points else LEXICON_FLOOR
    if allowed is not None and (lexicon is None or allowed.isEmpty()):
        return allowed_chars(charset, allowed)
    if lexicon is not None:
        return lexicon_prior(charset, lexicon, points, floor)
    return open_text(charset)
