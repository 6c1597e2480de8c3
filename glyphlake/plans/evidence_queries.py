"""Alternatives, raw evidence, chosen scores, priors by domain, and suspect merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import characters
from ..operators import domain_prior, evidence, merges
from ..operators import segmentation as sg
from ..operators.ranking import topk
from .carriers import LOGITS_SQL, logits, part_lexicon, table
from .catalogue import register
from .segmentation_queries import BOX_SQL, PARTS_SQL, atoms

#: Fixed points of a calibration, for the queries.
POINTS = [(0.0, 0.0), (0.5, 0.4), (1.0, 1.0)]
CALIBRATED = "CASE WHEN {0} <= 0.5 THEN {0} * 0.8 ELSE 0.4 + ({0} - 0.5) * 1.2 END"


def fused(spark, sf_dir):
    return logits(spark, sf_dir).select("glyph_id", "char_id", F.round(1 / (1 + F.exp(-4 * F.col("logit"))), 9).alias("visual"))


FUSED_SQL = f"""
{LOGITS_SQL}, fused AS (SELECT glyph_id, char_id, round(1 / (1 + exp(-4 * logit)), 9) AS visual FROM logits),
kept AS (SELECT * FROM (SELECT *, row_number() OVER w AS rank, lead(visual, 1, 0.0) OVER w AS nxt FROM fused WINDOW w AS (PARTITION BY glyph_id ORDER BY visual DESC, char_id)) WHERE rank <= 5)"""


@register(f"""
WITH {FUSED_SQL} SELECT glyph_id, char_id, visual, rank, CASE WHEN rank = 1 THEN round(visual - nxt, 9) END AS margin, CASE WHEN rank = 1 THEN round({CALIBRATED.format("visual")}, 9) END AS confidence FROM kept""")
def best_alternatives(spark, sf_dir):
    out = evidence.best_alternatives(fused(spark, sf_dir), POINTS)
    return out.select("glyph_id", "char_id", "visual", F.col("rank").cast("long").alias("rank"), F.round("margin", 9).alias("margin"), F.round("confidence", 9).alias("confidence"))


@register(f"""
WITH {FUSED_SQL}, t AS (SELECT * FROM (SELECT glyph_id, char_id, ((glyph_id * 13 + char_id * 29) % 100) / 100.0::DOUBLE AS score, row_number() OVER (PARTITION BY glyph_id ORDER BY (glyph_id * 13 + char_id * 29) % 100 DESC, char_id) AS rn FROM logits) WHERE rn <= 3),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY glyph_id ORDER BY logit DESC, char_id) AS rn FROM logits) WHERE rn <= 3)
SELECT k.glyph_id, k.char_id, coalesce(t.score, 0)::DOUBLE AS template_score, coalesce(round(c.logit, 9), '-inf'::DOUBLE) AS cnn_logit FROM kept k LEFT JOIN t USING (glyph_id, char_id) LEFT JOIN c USING (glyph_id, char_id)""")
def raw_evidence(spark, sf_dir):
    every = logits(spark, sf_dir)
    template = topk(every.select("glyph_id", "char_id", (((F.col("glyph_id") * 13 + F.col("char_id") * 29) % 100) / 100.0).alias("logit")), 3).select("glyph_id", "char_id", F.col("logit").alias("score"))
    kept = evidence.best_alternatives(fused(spark, sf_dir)).select("glyph_id", "char_id")
    return evidence.raw_evidence(kept, template, topk(every, 3)).withColumn("cnn_logit", F.round("cnn_logit", 9))


@register(f"""
WITH {FUSED_SQL}, chosen AS (SELECT vec_id AS glyph_id, (vec_id * 7 % 20)::INT AS char_id, -0.01 * (vec_id % 7) AS geometry FROM embeddings),
o AS (SELECT c.*, coalesce(visual, 0) AS own, least(1, greatest(0, coalesce(visual, 0) + 0.10 * geometry)) AS whole FROM chosen c LEFT JOIN kept USING (glyph_id, char_id))
SELECT glyph_id, char_id, own::DOUBLE AS classifier_score, round(whole, 9)::DOUBLE AS visual, round({CALIBRATED.format("whole")}, 9)::DOUBLE AS confidence,
  round(CASE glyph_id % 3 WHEN 0 THEN least(1, greatest(0, whole * 1.5)) WHEN 1 THEN 1 / (1 + exp(-whole * 1.5)) ELSE 0 END, 9)::DOUBLE AS shown FROM o""")
def chosen_scores(spark, sf_dir):
    i = F.col("vec_id")
    chosen = table(spark, sf_dir, "embeddings").select(i.alias("glyph_id"), (i * 7 % 20).cast("int").alias("char_id"), (-0.01 * (i % 7)).alias("geometry"))
    out = evidence.chosen_scores(chosen, evidence.best_alternatives(fused(spark, sf_dir)), POINTS)
    kind = F.when(F.col("glyph_id") % 3 == 0, "template").when(F.col("glyph_id") % 3 == 1, "cnn").otherwise("none")
    shown = evidence.to_confidence(F.col("visual") * 1.5, kind)
    return out.select("glyph_id", "char_id", "classifier_score", F.round("visual", 9).alias("visual"), F.round("confidence", 9).alias("confidence"), F.round(shown, 9).alias("shown"))


@register("""
WITH lex AS (SELECT DISTINCT replace(p_name, ' ', '') AS term FROM part), chars AS (SELECT unnest(string_split(term, '')) AS ch FROM lex),
known AS (SELECT DISTINCT ch FROM chars UNION SELECT * FROM (VALUES ('#'), ('漢')) AS t(ch)), charset AS (SELECT ch, (row_number() OVER (ORDER BY ch) - 1)::INT AS char_id FROM known),
n AS (SELECT ch, count(*) AS n FROM chars GROUP BY ch), ok AS (SELECT char_id FROM charset WHERE char_id % 3 = 0), whole AS (SELECT max(n) AS most, sum(n) AS total FROM n)
SELECT 'open' AS prior, char_id, round(-ln((SELECT count(*) FROM charset)), 9) AS log_p FROM charset
UNION ALL SELECT 'allowed', char_id, CASE WHEN char_id % 3 = 0 THEN round(-ln((SELECT count(*) FROM ok)), 9) ELSE '-inf'::DOUBLE END FROM charset
UNION ALL SELECT 'lexicon', char_id, CASE WHEN n IS NULL THEN -6 ELSE round(greatest(ln(n / most), -6), 9) END FROM charset LEFT JOIN n USING (ch), whole
UNION ALL SELECT 'unigram', char_id, CASE WHEN n IS NULL THEN -8 ELSE round(greatest(ln(n / total), -8), 9) END FROM charset LEFT JOIN n USING (ch), whole""")
def domain_priors(spark, sf_dir):
    lex = part_lexicon(spark, sf_dir)
    chars = lex.select(F.explode(characters(F.col("term"))).alias("ch"))
    known = chars.distinct().union(spark.createDataFrame([("#",), ("漢",)], "ch string")).distinct()
    every = known.agg(F.array_sort(F.collect_list("ch")).alias("all"))  # a charset
    charset = every.select(F.posexplode("all").alias("char_id", "ch"))
    found = {"open": domain_prior.choose(charset), "allowed": domain_prior.choose(charset, allowed=charset.where("char_id % 3 = 0")), "lexicon": domain_prior.choose(charset, lexicon=lex)}
    found["unigram"] = domain_prior.unigram_prior(charset, chars.groupBy("ch").agg(F.count("*").alias("n")))
    out = None
    for name, prior in found.items():
        one = prior.select(F.lit(name).alias("prior"), "char_id", F.round("log_p", 9).alias("log_p"))
        out = one if out is None else out.unionByName(one)
    return out


SCORED_SQL = """
scored AS (SELECT line_id, s, e, n, x, w, 0.5 + ((line_id * 31 + s * 17 + n * 7) % 50) / 100.0 AS visual, CASE WHEN (line_id + s) % 3 = 0 THEN 0.0 ELSE ((line_id + 2 * s) % 10) / 10.0 END AS template, CASE WHEN (line_id + s + n) % 11 = 0 THEN 'template' ELSE 'cnn' END AS kind FROM parts),
own AS (SELECT line_id, atom_idx, x, w, h, 0.5 + ((line_id * 13 + atom_idx * 29) % 50) / 100.0 AS score FROM atoms)"""


def scored_atoms(spark, sf_dir):
    i = F.col("atom_idx")
    return atoms(spark, sf_dir).withColumn("score", 0.5 + ((F.col("line_id") * 13 + i * 29) % 50) / 100.0)


@register(f"""
WITH {BOX_SQL}, {PARTS_SQL}, {SCORED_SQL},
m AS (SELECT c.line_id, c.s, c.e, any_value(c.w) AS cw, any_value(visual) AS visual, any_value(template) AS template, any_value(kind) AS kind, max(o.w) AS most, median(o.w) AS mid, count(*) AS n_parts FROM scored c JOIN own o ON o.line_id = c.line_id AND o.atom_idx >= c.s AND o.atom_idx < c.e GROUP BY ALL),
g AS (SELECT m.*, count_if(o.score >= 0.7 AND o.w >= 0.7 * mid AND o.h >= 5) AS good, count_if(o.score >= 0.75 AND o.w >= 0.7 * mid AND o.h >= 5) AS better, max(CASE WHEN o.score >= 0.7 AND o.w >= 0.7 * mid AND o.h >= 5 THEN o.score ELSE 0 END) AS best
  FROM m JOIN own o ON o.line_id = m.line_id AND o.atom_idx >= m.s AND o.atom_idx < m.e GROUP BY ALL),
lap AS (SELECT DISTINCT m.line_id, m.s, m.e FROM m JOIN own a ON a.line_id = m.line_id AND a.atom_idx >= m.s AND a.atom_idx < m.e JOIN own b ON b.line_id = m.line_id AND b.atom_idx > a.atom_idx AND b.atom_idx < m.e WHERE b.x < a.x + a.w)
SELECT g.line_id, g.s::BIGINT AS "start", g.e::BIGINT AS "end", round(CASE WHEN kind <> 'template' AND template < 0.9 AND n_parts >= 2 AND cw >= 1.6 * most AND good > 0
  AND ((template <= 1e-6 AND cw >= 1.7 * most AND better >= 2) OR (lap.line_id IS NULL AND best + 0.05 > visual + 1e-9)) THEN least(0.45, greatest(0.12, visual - 0.60)) ELSE 0 END, 6)::DOUBLE AS penalty
FROM g LEFT JOIN lap ON lap.line_id = g.line_id AND lap.s = g.s AND lap.e = g.e""")
def fake_merge_penalty(spark, sf_dir):
    parts = sg.candidate_parts(atoms(spark, sf_dir), 3)
    line, s, n = F.col("line_id"), F.col("start"), F.col("n")
    scored = parts.select("line_id", "start", "end", "w", (0.5 + ((line * 31 + s * 17 + n * 7) % 50) / 100.0 + 1e-9).alias("visual"), F.when((line + s) % 3 == 0, 0.0).otherwise(((line + 2 * s) % 10) / 10.0).alias("template"), F.when((line + s + n) % 11 == 0, "template").otherwise("cnn").alias("kind"), F.lit(10).alias("line_h"))
    out = merges.fake_merge_penalty(scored, scored_atoms(spark, sf_dir))
    return out.select("line_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.round("penalty", 6).alias("penalty"))


@register(f"""
WITH {BOX_SQL}, {PARTS_SQL},
pairs AS (SELECT a.line_id, a.atom_idx AS i, b.atom_idx AS j,
    (greatest(a.x, b.x) - least(a.x + a.w, b.x + b.w) <= 1 AND least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) >= 1) OR (greatest(a.y, b.y) - least(a.y + a.h, b.y + b.h) <= 4 AND least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) >= 1) AS near
  FROM atoms a JOIN atoms b ON b.line_id = a.line_id AND b.atom_idx BETWEEN a.atom_idx + 1 AND a.atom_idx + 2)
SELECT p.line_id, s::BIGINT AS "start", e::BIGINT AS "end", n = 1 OR (SELECT count(*) FROM pairs q WHERE q.near AND q.line_id = p.line_id AND q.i >= s AND q.j < e) >= n - 1 AS connected FROM parts p""")
def merge_clusters(spark, sf_dir):
    own = atoms(spark, sf_dir)
    out = merges.one_cluster(sg.candidate_parts(own, 3), own)
    return out.select("line_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "connected")
