"""Candidate pruning, geometry and evaluation, over order lines drawn as boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate
from ..operators import segmentation as sg
from .carriers import LOGITS_SQL, logits, table
from .catalogue import register

ORDER = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax"
#: Boxes of an order: 14 apart, wide by quantity, high by part, on a baseline that varies by supplier.
BOX_SQL = f"""
boxes AS (SELECT l_orderkey AS line_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) - 1 AS atom_idx, 2 + l_quantity::INT % 15 AS w, 6 + (l_partkey % 9)::INT AS h, (l_suppkey % 6)::INT AS y, (10 + l_partkey % 60)::INT AS ink FROM lineitem),
atoms AS (SELECT *, 14 * atom_idx AS x FROM boxes)"""
PARTS_SQL = """
parts AS (
  SELECT a.line_id, a.atom_idx AS s, b.atom_idx + 1 AS e, b.atom_idx + 1 - a.atom_idx AS n, min(c.x) AS x, min(c.y) AS y, max(c.x + c.w) - min(c.x) AS w, max(c.y + c.h) - min(c.y) AS h, sum(c.ink) AS ink,
    max(d.x - c.x - c.w) AS gap, min(greatest(c.y, d.y) - least(c.y + c.h, d.y + d.h)) AS gap_y
  FROM atoms a JOIN atoms b ON b.line_id = a.line_id AND b.atom_idx BETWEEN a.atom_idx AND a.atom_idx + 2
    JOIN atoms c ON c.line_id = a.line_id AND c.atom_idx BETWEEN a.atom_idx AND b.atom_idx
    LEFT JOIN atoms d ON d.line_id = a.line_id AND d.atom_idx = c.atom_idx + 1 AND d.atom_idx <= b.atom_idx
  GROUP BY ALL)"""
WIDTH_SQL = """
tall AS (SELECT * FROM (SELECT *, max(h) OVER (PARTITION BY line_id) AS most FROM atoms) WHERE h >= greatest(2, 0.6 * most)),
widths AS (SELECT line_id, greatest(4.0, least(64.0, median(h) * 0.8)) AS expected_width FROM tall GROUP BY line_id)"""


def atoms(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy(*ORDER.split(", "))
    own = table(spark, sf_dir, "lineitem").withColumn("atom_idx", F.row_number().over(w) - 1)
    wide, high = (2 + F.col("l_quantity").cast("int") % 15).alias("w"), (6 + F.col("l_partkey") % 9).cast("int").alias("h")
    return own.select(F.col("l_orderkey").alias("line_id"), "atom_idx", (14 * F.col("atom_idx")).alias("x"), (F.col("l_suppkey") % 6).cast("int").alias("y"), wide, high, (10 + F.col("l_partkey") % 60).cast("int").alias("ink"))


@register(f"WITH {BOX_SQL}, {WIDTH_SQL} SELECT line_id, round(expected_width, 6)::DOUBLE AS expected_width FROM widths")
def expected_width(spark, sf_dir):
    return sg.expected_width(atoms(spark, sf_dir)).withColumn("expected_width", F.round("expected_width", 6))


@register(f"""
WITH {BOX_SQL}, {PARTS_SQL}, {WIDTH_SQL}
SELECT line_id, s::BIGINT AS "start", e::BIGINT AS "end" FROM parts JOIN widths USING (line_id)
WHERE w <= 64 AND h <= 64 AND CASE WHEN n = 1 THEN h < 8 OR ink >= greatest(1, floor(0.02 * w * h))
  ELSE h >= 8 AND w <= greatest(64, expected_width * 1.8) AND gap <= 10 AND gap_y <= 8 AND ink >= greatest(1, floor(0.02 * w * h)) END""")
def candidate_filter(spark, sf_dir):
    own = atoms(spark, sf_dir)
    kept = sg.candidate_parts(own, 3).join(sg.expected_width(own), "line_id").where(sg.passes_filters(F.col("expected_width")))
    return kept.select("line_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


GEOMETRY_SQL = """
mid AS (SELECT line_id, median(y + h / 2) AS center, median(h) AS height FROM atoms GROUP BY line_id),
typ AS (SELECT line_id, median(w) AS width FROM atoms JOIN mid USING (line_id) WHERE h >= greatest(2, 0.5 * height) GROUP BY line_id),
geo AS (
  SELECT p.*, CASE WHEN abs(y + h / 2 - center) > 1.2 THEN -least(0.04, abs(y + h / 2 - center) * 0.004) ELSE 0 END AS aligned, CASE WHEN n > 1 THEN -least(0.04, greatest(0, gap - 1) * 0.01) ELSE 0 END AS apart,
    CASE WHEN n > 1 AND w > coalesce(width, height) * 1.9 THEN -0.05 ELSE 0 END AS width_penalty
  FROM parts p JOIN mid USING (line_id) LEFT JOIN typ USING (line_id))"""


@register(f'WITH {BOX_SQL}, {PARTS_SQL}, {GEOMETRY_SQL} SELECT line_id, s::BIGINT AS "start", e::BIGINT AS "end", round(greatest(-0.10, aligned + apart + width_penalty), 6)::DOUBLE AS geometry FROM geo')
def candidate_geometry(spark, sf_dir):
    own = atoms(spark, sf_dir)
    out = sg.candidate_geometry(sg.candidate_parts(own, 3), own)
    return out.select("line_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.round("geometry", 6).alias("geometry"))


METRICS_SQL = "metrics AS (SELECT i AS char_id, 0.3 + 0.05 * i AS bbox_width, 0.9 - 0.01 * i AS bbox_height, 0.4 + 0.06 * i AS aspect_ratio, 0.4 + 0.05 * i AS advance, 0.2 + 0.02 * i AS ink_ratio, 1 + i % 3 AS component_count FROM range(12) AS t(i))"


@register(f"""
WITH {BOX_SQL}, {PARTS_SQL}, {GEOMETRY_SQL}, {METRICS_SQL},
j AS (SELECT *, greatest(h / bbox_height, w / bbox_width, 1.0) AS em FROM geo LEFT JOIN metrics ON char_id = (line_id + s * 5 + n) % 14),
c AS (SELECT *, least(0.05, abs(w / em - bbox_width) / bbox_width * 0.04) + least(0.04, abs(h / em - bbox_height) / bbox_height * 0.03) + least(0.03, abs(ln(greatest(w / h / aspect_ratio, 1e-3))) * 0.02)
    + least(0.02, abs(w / em - advance) / advance * 0.01) + least(0.03, abs(ink / (w * h) - ink_ratio) / greatest(ink_ratio, 0.05) * 0.01) AS shape FROM j)
SELECT line_id, s::BIGINT AS "start", e::BIGINT AS "end", round(CASE WHEN bbox_width IS NULL THEN 0 ELSE
  CASE WHEN n > 1 AND component_count > 1 THEN -width_penalty ELSE 0 END
  + CASE WHEN n > 1 AND component_count = 1 THEN -least(0.04, (n - 1) * 0.02) WHEN n = 1 AND component_count > 1 THEN -least(0.03, (component_count - 1) * 0.015) WHEN n = component_count AND n > 1 THEN least(0.05, (n - 1) * 0.025) ELSE 0 END
  - shape END + 1e-9, 6)::DOUBLE AS char_geometry FROM c""")
def char_geometry(spark, sf_dir):
    own, i = atoms(spark, sf_dir), F.col("id")
    metrics = spark.range(12).select(i.alias("char_id"), (0.3 + 0.05 * i).alias("bbox_width"), (0.9 - 0.01 * i).alias("bbox_height"), (0.4 + 0.06 * i).alias("aspect_ratio"), (0.4 + 0.05 * i).alias("advance"), (0.2 + 0.02 * i).alias("ink_ratio"), (1 + i % 3).alias("component_count"))
    cand = sg.candidate_geometry(sg.candidate_parts(own, 3), own).withColumn("char_id", (F.col("line_id") + F.col("start") * 5 + F.col("n")) % 14)
    return sg.char_geometry(cand, metrics).select("line_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.round(F.col("char_geometry") + 1e-9, 6).alias("char_geometry"))


@register(f"""
WITH {BOX_SQL}, {PARTS_SQL}, scored AS (SELECT line_id, s, e, n, ((line_id * 31 + s * 17 + n * 7) % 101) / 100.0 AS score FROM parts),
best AS (SELECT m.line_id, m.s, m.e, max(p.score) AS part FROM scored m JOIN scored p ON p.line_id = m.line_id AND p.n = 1 AND p.s >= m.s AND p.s < m.e WHERE m.n > 1 GROUP BY ALL)
SELECT line_id, s::BIGINT AS "start", e::BIGINT AS "end", score::DOUBLE AS score FROM scored LEFT JOIN best USING (line_id, s, e) WHERE n = 1 OR NOT (score < 0.4 OR coalesce(part, 0) > score + 0.02)""")
def weak_merge_filter(spark, sf_dir):
    parts = sg.candidate_parts(atoms(spark, sf_dir), 3)
    scored = parts.select("line_id", "start", "end", (((F.col("line_id") * 31 + F.col("start") * 17 + F.col("n") * 7) % 101) / 100.0).alias("score"))
    return sg.drop_weak_merges(scored, 0.4).select("line_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "score")


@register("""
WITH l AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split, CASE WHEN s_suppkey % 4 = 0 THEN replace(s_name, '#', 'H') ELSE s_name END AS text, s_name AS truth, (s_suppkey % 10) / 10.0 AS confidence, 0.5 + (s_suppkey % 7) AS nll FROM supplier)
SELECT split, count(*) AS n_lines, round(avg((text = truth)::INT), 9) AS exact_match, round(avg(levenshtein(text, truth) / greatest(length(text), length(truth), 1)), 9) AS cer, round(avg(nll), 9)::DOUBLE AS nll, round(avg((confidence < 0.5)::INT), 9) AS reject_rate FROM l GROUP BY split""")
def split_metrics(spark, sf_dir):
    key, name = F.col("s_suppkey"), F.col("s_name")
    lines = table(spark, sf_dir, "supplier").select(F.when(key % 3 == 0, "test").when(key % 3 == 1, "val").otherwise("train").alias("split"), F.when(key % 4 == 0, F.replace(name, F.lit("#"), F.lit("H"))).otherwise(name).alias("text"), name.alias("truth"), ((key % 10) / 10.0).alias("confidence"), (0.5 + key % 7).alias("nll"))
    return evaluate.split_metrics(lines).select("split", "n_lines", *(F.round(c, 9).alias(c) for c in ("exact_match", "cer", "nll", "reject_rate")))


@register("""
WITH t AS (SELECT s_suppkey, s_name AS truth, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS a, CASE WHEN s_suppkey % 5 = 0 THEN 'x' WHEN s_suppkey % 7 = 0 THEN '' ELSE s_name END AS b FROM supplier)
SELECT count(*) AS n, count_if(a = truth AND b <> truth)::BIGINT AS regressed, count_if(a <> truth AND b = truth)::BIGINT AS improved, count_if(a <> truth AND b <> truth)::BIGINT AS both_failed, count_if(b <> truth AND b <> '')::BIGINT AS wrong FROM t""")
def decoder_comparison(spark, sf_dir):
    key, name = F.col("s_suppkey"), F.col("s_name")
    own = table(spark, sf_dir, "supplier")
    a = own.select(key.alias("line_id"), name.alias("truth"), F.when(key % 3 == 0, "").otherwise(name).alias("text"))
    b = own.select(key.alias("line_id"), name.alias("truth"), F.when(key % 5 == 0, "x").when(key % 7 == 0, "").otherwise(name).alias("text"))
    return evaluate.compare(a, b)


@register(f"""
WITH {LOGITS_SQL}, s AS (SELECT glyph_id AS sample_id, char_id, 1 / (1 + exp(-logit * 4)) AS cnn, ((glyph_id * 13 + char_id * 29) % 100) / 100.0 AS template, -0.01 * (char_id % 5) AS geometry, (SELECT label FROM embeddings e WHERE e.vec_id = glyph_id) AS truth FROM logits),
grid AS (SELECT c.v AS w_cnn, t.v AS w_template, g.v AS w_geometry FROM (VALUES (0.30), (0.45), (0.60)) AS c(v), (VALUES (0.60), (0.45), (0.30)) AS t(v), (VALUES (0.05), (0.10), (0.20)) AS g(v) WHERE c.v + t.v <= 0.9),
w AS (SELECT w_cnn, w_template, w_geometry, sample_id, char_id, truth, round(least(1, greatest(0, w_cnn * cnn + w_template * template + w_geometry * geometry)), 9) AS score FROM s, grid),
b AS (SELECT *, row_number() OVER (PARTITION BY w_cnn, w_template, w_geometry, sample_id ORDER BY score DESC, char_id) AS rn FROM w)
SELECT w_cnn::DOUBLE AS w_cnn, w_template::DOUBLE AS w_template, w_geometry::DOUBLE AS w_geometry, round(avg((char_id = truth)::INT), 9) AS accuracy, round(avg(score) FILTER (char_id = truth), 6) AS mean_score FROM b WHERE rn = 1 GROUP BY 1, 2, 3""")
def weight_grid(spark, sf_dir):
    truth = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("label").alias("truth"))
    own = logits(spark, sf_dir).select(F.col("glyph_id").alias("sample_id"), "char_id", (1 / (1 + F.exp(-F.col("logit") * 4))).alias("cnn"), (((F.col("glyph_id") * 13 + F.col("char_id") * 29) % 100) / 100.0).alias("template"), (-0.01 * (F.col("char_id") % 5)).alias("geometry"))
    return evaluate.weight_grid(own.join(truth, "sample_id"), [0.30, 0.45, 0.60], [0.60, 0.45, 0.30], [0.05, 0.10, 0.20])


@register("""
WITH p AS (SELECT s_nationkey AS line_id, CASE s_suppkey % 3 WHEN 0 THEN 'clean' WHEN 1 THEN '12_1' ELSE '14_0' END AS state, 'T' || (s_suppkey % 5) AS text, 3 + s_suppkey % 4 AS n, -((s_suppkey * 37) % 101) / 10.0 AS score FROM supplier),
q AS (SELECT *, round(score / pow(n + 0.5, 0.9), 9) AS norm FROM p),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY line_id, text ORDER BY norm DESC, state DESC, n DESC) AS rn FROM q) WHERE rn = 1),
r AS (SELECT *, row_number() OVER w AS rank, lead(norm) OVER w AS nxt FROM d WINDOW w AS (PARTITION BY line_id ORDER BY norm DESC, text)),
t AS (SELECT *, exp(norm) / sum(exp(norm)) OVER (PARTITION BY line_id) AS share, lead(norm) OVER (PARTITION BY line_id ORDER BY rank) AS after FROM r WHERE rank <= 3)
SELECT line_id, text, state, rank, round(share, 6) AS confidence, round(coalesce(norm - after, 0), 6)::DOUBLE AS margin, share < 0.5 AS rejected FROM t""")
def merge_state_paths(spark, sf_dir):
    from ..operators.ranker import merge_states

    key = F.col("s_suppkey")
    state = F.when(key % 3 == 0, "clean").when(key % 3 == 1, "12_1").otherwise("14_0")
    paths = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("line_id"), state.alias("state"), F.concat(F.lit("T"), (key % 5).cast("string")).alias("text"), (3 + key % 4).alias("n"), (-((key * 37) % 101) / 10.0).alias("score"))
    out = merge_states(paths, 3, 0.9, 0.5)
    return out.select("line_id", "text", "state", F.col("rank").cast("long").alias("rank"), F.round("confidence", 6).alias("confidence"), F.round("margin", 6).alias("margin"), "rejected")
