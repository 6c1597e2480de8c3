"""Log-domain sums, priors, calibration and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scoring import calibrate_monotone
from ..functions.text import sequence_cer as cer
from ..operators import probability as pr
from .carriers import LOGITS_SQL, PREDICTIONS_SQL, logits, part_lexicon, predictions, table
from .catalogue import register

LEX_SQL = "lex AS (SELECT DISTINCT replace(p_name, ' ', '') AS term FROM part), chars AS (SELECT unnest(string_split(term, '')) AS ch FROM lex), counts AS (SELECT ch, count(*) AS n FROM chars GROUP BY ch)"


@register(f"WITH {LOGITS_SQL} SELECT glyph_id, char_id, round(logit / 0.7 - ln(sum(exp(logit / 0.7)) OVER (PARTITION BY glyph_id)), 9) AS log_p FROM logits")
def log_softmax(spark, sf_dir):
    scaled = logits(spark, sf_dir).withColumn("logit", F.col("logit") / 0.7)
    return pr.log_softmax(scaled).select("glyph_id", "char_id", F.round("log_p", 9).alias("log_p"))


@register("SELECT user_id, round(max(value) + ln(sum(exp(value - m))), 6) AS lse FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id")
def logsumexp_group(spark, sf_dir):
    return pr.logsumexp_group(table(spark, sf_dir, "events"), "user_id", "value").withColumn("lse", F.round("lse", 6))


@register(f"WITH {LEX_SQL} SELECT ch, n, round(greatest(ln(n / (SELECT max(n) FROM counts)), -6), 9)::DOUBLE AS lexicon_log_p, round(greatest(ln(n / (SELECT sum(n) FROM counts)), -8), 9)::DOUBLE AS unigram_log_p FROM counts")
def lexicon_and_unigram_prior(spark, sf_dir):
    counts = pr.char_counts(part_lexicon(spark, sf_dir))
    both = pr.lexicon_prior(counts).withColumnRenamed("log_p", "lexicon_log_p").join(pr.unigram_prior(counts).select("ch", F.col("log_p").alias("unigram_log_p")), "ch")
    return both.select("ch", "n", F.round("lexicon_log_p", 9).alias("lexicon_log_p"), F.round("unigram_log_p", 9).alias("unigram_log_p"))


@register(f"WITH {LEX_SQL} SELECT ch, round(0.35 + 0.65 * n / (SELECT max(n) FROM counts), 9)::DOUBLE AS prior FROM counts")
def char_prior_gated(spark, sf_dir):
    return pr.gated_char_prior(pr.char_counts(part_lexicon(spark, sf_dir))).withColumn("prior", F.round("prior", 9))


@register(f"""
WITH {LOGITS_SQL}, best AS (SELECT glyph_id, char_id, logit / 0.8 AS l FROM (SELECT *, row_number() OVER (PARTITION BY glyph_id ORDER BY logit DESC, char_id) AS rn FROM logits) WHERE rn <= 5
  UNION ALL SELECT vec_id, -1, 0.25 FROM embeddings)
SELECT glyph_id, char_id, round(l - ln(sum(exp(l)) OVER (PARTITION BY glyph_id)), 9)::DOUBLE AS log_p FROM best""")
def open_set_options(spark, sf_dir):
    return pr.open_set_options(logits(spark, sf_dir), 0.8, 0.25, 5).withColumn("log_p", F.round("log_p", 9))


POINTS = [(0.0, 0.0), (0.5, 0.4), (0.75, 0.9), (1.0, 1.0)]


@register("SELECT event_id, round(CASE WHEN x <= 0.5 THEN x * 0.8 WHEN x <= 0.75 THEN 0.4 + (x - 0.5) * 2 ELSE 0.9 + (x - 0.75) * 0.4 END, 9)::DOUBLE AS calibrated FROM (SELECT event_id, least(1.0, greatest(0.0, value / 100)) AS x FROM events)")
def calibrate_piecewise(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(calibrate_monotone(F.col("value") / 100, POINTS), 9).alias("calibrated"))


BINS_SQL = "binned AS (SELECT *, ((row_number() OVER (ORDER BY confidence, id)) * least({b}, n) - 1) // n AS bin FROM (SELECT *, count(*) OVER () AS n FROM pred))"


@register(f"""
WITH {PREDICTIONS_SQL}, {BINS_SQL.format(b=10)},
per AS (SELECT bin, any_value(n) AS n, count(*) AS c, avg(confidence) AS conf, avg(hit) AS acc, sum((confidence - hit) ** 2) AS sq, sum(hit) AS hits FROM binned GROUP BY bin)
SELECT max(n) AS n, round(sum(hits) / max(n), 9) AS accuracy, round(sum(sq) / max(n), 9) AS brier, round(sum(abs(conf - acc) * c / n), 9) AS ece FROM per""")
def calibration_metrics(spark, sf_dir):
    out = pr.calibration_metrics(predictions(spark, sf_dir), 10)
    return out.select("n", *(F.round(c, 9).alias(c) for c in ("accuracy", "brier", "ece")))


@register(f"""
WITH {PREDICTIONS_SQL}, {BINS_SQL.format(b=6)}, per AS (SELECT bin, avg(confidence) AS x, (sum(hit) + 1) / (count(*) + 2) AS raw FROM binned GROUP BY bin UNION ALL SELECT -1, 0, 0 UNION ALL SELECT max(bin) + 1, 1, 1 FROM binned)
SELECT bin::BIGINT AS bin, round(x, 9) AS x, round(max(raw) OVER (ORDER BY bin), 9) AS y FROM per""")
def fit_monotone_calibration(spark, sf_dir):
    return pr.fit_calibration(predictions(spark, sf_dir), 6).select("bin", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@register("SELECT s_suppkey, round(levenshtein(s_name, n_name) / greatest(length(s_name), length(n_name), 1), 9)::DOUBLE AS cer FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def sequence_cer(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    both = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return both.select("s_suppkey", F.round(cer(F.col("s_name"), F.col("n_name")), 9).alias("cer"))


@register("""
SELECT l_returnflag, median(l_extendedprice) AS median, max(l_extendedprice) FILTER (rn = ceil(0.95 * n)) AS p95_ceil, max(l_extendedprice) FILTER (rn = floor(0.95 * n) + 1) AS p95_index
FROM (SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) GROUP BY 1""")
def median_p95(spark, sf_dir):
    return pr.median_p95(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice")


@register("""
WITH s AS (SELECT DISTINCT conv_id FROM conversations),
o AS (SELECT conv_id, row_number() OVER (ORDER BY (conv_id * 2654435761) % 4294967296, conv_id) AS i, count(*) OVER () AS n FROM s)
SELECT conv_id, CASE WHEN i <= round_even(0.2 * n, 0) THEN 'test' WHEN i <= round_even(0.2 * n, 0) + round_even(0.15 * n, 0) THEN 'val' ELSE 'train' END AS split FROM o""")
def grouped_split(spark, sf_dir):
    return pr.grouped_split(table(spark, sf_dir, "conversations"), "conv_id")
