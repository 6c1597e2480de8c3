"""Runs, components, candidates, paths and cover, over events and order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decode, lattice
from .carriers import ATOMS_SQL, atoms, frames, scored_candidates, table
from .catalogue import register


@register("""
WITH m AS (SELECT user_id, event_type, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY i) AS run FROM m)
SELECT user_id, run::BIGINT AS run, any_value(event_type) AS event_type, count(*) AS length FROM r GROUP BY user_id, run""")
def run_lengths(spark, sf_dir):
    return lattice.runs(frames(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type")


@register("""
WITH p AS (SELECT user_id, event_id AS y FROM events),
m AS (SELECT *, sum(CASE WHEN y - prev <= 150 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY y) AS line FROM (SELECT *, lag(y) OVER (PARTITION BY user_id ORDER BY y) AS prev FROM p))
SELECT user_id, line::BIGINT AS line, min(y) AS y0, max(y) AS y1, count(*) AS n FROM m GROUP BY user_id, line HAVING max(y) - min(y) >= 100""")
def line_groups_min_gap(spark, sf_dir):
    return lattice.line_groups(table(spark, sf_dir, "events"), "user_id", "event_id", 150, 100).select("user_id", "line", "y0", "y1", "n")


@register()
def connected_components(spark, sf_dir):
    """All suppliers (even nodes) and parts (odd ones) that order lines link. SQL would have to list all that each node reaches; a test compares with brute force."""
    edges = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 2).cast("long").alias("a"), (F.col("l_partkey") * 2 + 1).cast("long").alias("b"))
    return lattice.connected_components(edges.dropna().distinct())


@register(f'WITH {ATOMS_SQL} SELECT line_id, s::BIGINT AS "start", e::BIGINT AS "end", x::DOUBLE AS x, w::DOUBLE AS w, h::DOUBLE AS h FROM cands')
def candidate_ranges(spark, sf_dir):
    out = lattice.candidate_ranges(atoms(spark, sf_dir), 3)
    return out.select("line_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "x", "w", "h")


def boxes(spark, sf_dir):
    """Truth boxes: each second atom's place, shifted and widened by rule."""
    own = atoms(spark, sf_dir)
    shift = F.col("l_partkey") % 7 - 3
    return own.where("atom_idx % 2 = 0").select("line_id", F.col("atom_idx").cast("long").alias("box_id"), (F.col("x") + shift).alias("b0"), (F.col("x") + shift + F.col("w") + F.col("l_partkey") % 5).alias("b1"))


@register(f"""
WITH {ATOMS_SQL}, boxes AS (SELECT line_id, atom_idx AS box_id, x + l_partkey % 7 - 3 AS b0, x + l_partkey % 7 - 3 + w + l_partkey % 5 AS b1 FROM atoms WHERE atom_idx % 2 = 0),
hits AS (SELECT a.line_id, atom_idx AS seg_id, box_id, (least(x + w, b1) - greatest(x, b0)) / greatest(w, b1 - b0) AS coverage FROM atoms a JOIN boxes b ON a.line_id = b.line_id AND x < b1 AND b0 < x + w)
SELECT line_id, seg_id, box_id, round(coverage, 9)::DOUBLE AS coverage, coverage >= 0.9 AS assigned FROM (SELECT *, row_number() OVER (PARTITION BY line_id, seg_id ORDER BY coverage DESC, box_id) AS rn FROM hits) WHERE rn = 1""")
def interval_overlap_coverage(spark, sf_dir):
    segments = atoms(spark, sf_dir).select("line_id", F.col("atom_idx").cast("long").alias("seg_id"), F.col("x").alias("x0"), (F.col("x") + F.col("w")).alias("x1"))
    return lattice.coverage(segments, boxes(spark, sf_dir), 32.0).withColumn("coverage", F.round("coverage", 9))


@register(f"""
WITH {ATOMS_SQL}, paths AS (SELECT line_id, e - s AS path_id, score AS visual, -0.01 * (s % 5) AS geometry, (s % 2)::DOUBLE AS lexicon, 0.35 + 0.1 * (s % 4) AS prior FROM cands WHERE s % (e - s) = 0)
SELECT line_id, path_id::BIGINT AS path_id, count(*) AS n, round(avg(visual) + avg(geometry) + 0.2 * avg(lexicon) * (1 - avg(visual)) + 0.15 * avg(prior) - 0.005 * (count(*) - 1), 6)::DOUBLE AS score FROM paths GROUP BY 1, 2""")
def path_score(spark, sf_dir):
    cand = scored_candidates(spark, sf_dir)
    size = F.col("end") - F.col("start")
    paths = cand.where(F.col("start") % size == 0).select("line_id", size.cast("long").alias("path_id"), F.col("score").alias("visual"), (-0.01 * (F.col("start") % 5)).alias("geometry"), (F.col("start") % 2).cast("double").alias("lexicon"), (0.35 + 0.1 * (F.col("start") % 4)).alias("prior"))
    return lattice.path_scores(paths).withColumn("score", F.round("score", 6))


@register()
def dp_best_path(spark, sf_dir):
    return decode.best_paths(scored_candidates(spark, sf_dir)).withColumn("mean_score", F.round("mean_score", 6))


@register()
def kbest_viterbi(spark, sf_dir):
    out = decode.kbest(scored_candidates(spark, sf_dir), 3, 0.9, 0.5)
    return out.withColumns({"score": F.round("score", 6), "norm": F.round("norm", 6)})


@register(f"""
WITH RECURSIVE {ATOMS_SQL}, truth AS (SELECT line_id, (atom_idx // 2)::BIGINT AS idx, min(x) + CASE WHEN any_value(line_id) % 5 = 0 THEN 4 ELSE 0 END AS t0, max(x + w) AS t1 FROM atoms GROUP BY line_id, atom_idx // 2),
steps AS (SELECT t.line_id, idx, s, e FROM truth t JOIN cands c ON c.line_id = t.line_id AND abs(x - t0) <= 2 AND abs(x + w - t1) <= 2),
reach AS (SELECT DISTINCT line_id, -1::BIGINT AS idx, 0::BIGINT AS at_atom FROM truth UNION SELECT r.line_id, st.idx, st.e FROM reach r JOIN steps st ON st.line_id = r.line_id AND st.idx = r.idx + 1 AND st.s = r.at_atom),
size AS (SELECT line_id, count(*) AS n_boxes, max(idx) AS top FROM truth GROUP BY 1), ends AS (SELECT line_id, max(e) AS n_atoms FROM cands GROUP BY 1)
SELECT line_id, n_boxes, (SELECT count(*) FROM reach r WHERE r.line_id = size.line_id AND r.idx = top AND at_atom = n_atoms) > 0 AS recalled FROM size JOIN ends USING (line_id)""")
def exact_cover_recall(spark, sf_dir):
    off = F.when(F.col("line_id") % 5 == 0, 4).otherwise(0)
    truth = atoms(spark, sf_dir).groupBy("line_id", F.floor(F.col("atom_idx") / 2).alias("idx")).agg(F.min("x").alias("t0"), F.max(F.col("x") + F.col("w")).alias("t1")).withColumn("t0", F.col("t0") + off)
    return lattice.reachable_cover(lattice.candidate_ranges(atoms(spark, sf_dir), 3), truth, 2)
