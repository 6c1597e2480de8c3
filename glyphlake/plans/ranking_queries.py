"""Top-k, masks, distances and fusion over the embeddings, taken as logits or as glyph bits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distance as ds
from ..operators import ranking as rk
from .carriers import BITS_SQL, LOGITS_SQL, glyph_bits, logits, table
from .catalogue import register

RANKED_SQL = "ranked AS (SELECT *, row_number() OVER (PARTITION BY glyph_id ORDER BY logit DESC, char_id) AS rank FROM {source})"


@register(f"""
WITH {LOGITS_SQL}, {RANKED_SQL.format(source="logits")}
SELECT a.glyph_id, a.char_id AS top_id, round(a.logit, 9) AS top, coalesce(b.char_id, -1) AS second_id, round(a.logit - b.logit, 9) AS margin
FROM ranked a LEFT JOIN ranked b ON b.glyph_id = a.glyph_id AND b.rank = 2 WHERE a.rank = 1""")
def top2_margin(spark, sf_dir):
    return rk.top2_margin(logits(spark, sf_dir)).withColumns({"top": F.round("top", 9), "margin": F.round("margin", 9)})


@register(f"WITH {LOGITS_SQL}, {RANKED_SQL.format(source='logits')} SELECT glyph_id, char_id, round(logit, 9) AS logit, rank FROM ranked WHERE rank <= 5")
def topk_ranked(spark, sf_dir):
    return rk.topk(logits(spark, sf_dir), 5).select("glyph_id", "char_id", F.round("logit", 9).alias("logit"), F.col("rank").cast("long").alias("rank"))


@register(f"WITH {LOGITS_SQL}, {RANKED_SQL.format(source='logits WHERE char_id % 3 = 0')} SELECT glyph_id, char_id, round(logit, 9) AS logit, rank FROM ranked WHERE rank <= 3")
def topk_allowed_mask(spark, sf_dir):
    ids = spark.range(0, 64, 3).select(F.col("id").cast("int").alias("char_id"))
    return rk.topk(rk.allowed(logits(spark, sf_dir), ids), 3).select("glyph_id", "char_id", F.round("logit", 9).alias("logit"), F.col("rank").cast("long").alias("rank"))


@register(f"WITH {LOGITS_SQL} SELECT glyph_id, char_id, round(logit, 9) AS logit FROM logits WHERE char_id = (glyph_id * 7) % 64")
def gather_logits(spark, sf_dir):
    wanted = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("glyph_id"), (F.col("vec_id") * 7 % 64).cast("int").alias("char_id"))
    return rk.gather(logits(spark, sf_dir), wanted).select("glyph_id", "char_id", F.round("logit", 9).alias("logit"))


COSTS = """(SELECT backend, batch, round(m + CASE WHEN backend = 'cpu' THEN 0.05 * batch ELSE 3 END, 6) AS cost
  FROM (SELECT CASE WHEN user_id % 2 = 0 THEN 'cpu' ELSE 'gpu' END AS backend, 1 << (event_id % 8)::INT AS batch, avg(value) AS m FROM events GROUP BY 1, 2))"""


@register(f"""
WITH costs AS {COSTS},
seg AS (SELECT backend, batch, cost, lead(batch) OVER w AS b1, lead(cost) OVER w AS c1, row_number() OVER w AS k, lead(batch, 2) OVER w IS NULL AS last FROM costs WINDOW w AS (PARTITION BY backend ORDER BY batch)),
sizes AS (SELECT DISTINCT 1 + (user_id * 3) % 300 AS n FROM events),
est AS (SELECT n, backend, cost + (n - batch) * (c1 - cost) / (b1 - batch) AS e FROM sizes JOIN seg ON b1 IS NOT NULL AND (n >= batch OR k = 1) AND (n < b1 OR last))
SELECT n, round(max(e) FILTER (backend = 'cpu'), 3) AS cpu, round(max(e) FILTER (backend = 'gpu'), 3) AS gpu, max(e) FILTER (backend = 'gpu') < max(e) FILTER (backend = 'cpu') AS use_gpu FROM est GROUP BY n""")
def crossover_pick(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    batch = F.call_function("shiftleft", F.lit(1), (F.col("event_id") % 8).cast("int"))
    even = F.col("user_id") % 2 == 0
    costs = ev.groupBy(F.when(even, "cpu").otherwise("gpu").alias("backend"), batch.alias("batch")).agg(F.avg("value").alias("m"))
    costs = costs.select("backend", "batch", F.round(F.col("m") + F.when(F.col("backend") == "cpu", 0.05 * F.col("batch")).otherwise(3), 6).alias("cost"))
    est = rk.estimate(costs, ev.select((1 + F.col("user_id") * 3 % 300).alias("n")).distinct())
    both = est.groupBy("n").agg(F.max(F.when(F.col("backend") == "cpu", F.col("estimate"))).alias("cpu"), F.max(F.when(F.col("backend") == "gpu", F.col("estimate"))).alias("gpu"))
    return both.select("n", F.round("cpu", 3).alias("cpu"), F.round("gpu", 3).alias("gpu"), (F.col("gpu") < F.col("cpu")).alias("use_gpu"))


@register(f"WITH {BITS_SQL} SELECT glyph_id, char_id, proto_id, distance::BIGINT AS distance FROM (SELECT *, row_number() OVER (PARTITION BY glyph_id ORDER BY distance, char_id, proto_id) AS rn FROM dist) WHERE rn = 1")
def hamming_nearest(spark, sf_dir):
    return ds.nearest(ds.class_minimum(*glyph_bits(spark, sf_dir)))


@register(f"""
WITH {BITS_SQL}, least AS (SELECT glyph_id, char_id, min(distance) AS distance FROM dist GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER w AS rank, lead(distance) OVER w AS nxt FROM least WINDOW w AS (PARTITION BY glyph_id ORDER BY distance, char_id))
SELECT glyph_id, char_id, distance::BIGINT AS distance, rank, round(1 - distance / 64.0, 9)::DOUBLE AS score, round(CASE WHEN nxt IS NULL THEN 1 - distance / 64.0 ELSE (nxt - distance) / 64.0 END, 9)::DOUBLE AS margin FROM ranked WHERE rank <= 3""")
def per_class_topk(spark, sf_dir):
    best = ds.per_class_topk(ds.class_minimum(*glyph_bits(spark, sf_dir)), 3, 64)
    return best.select("glyph_id", "char_id", F.col("distance").cast("long").alias("distance"), F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"), F.round("margin", 9).alias("margin"))


@register(f"""
WITH {BITS_SQL}, near AS (SELECT glyph_id, count(*) AS n, min(distance) AS d FROM dist WHERE abs(g_ink - p_ink) <= floor(0.2 * g_ink) + 3 GROUP BY 1),
every AS (SELECT glyph_id, min(distance) AS d FROM dist GROUP BY 1)
SELECT glyph_id, coalesce(n, 0) AS n_coarse, (coalesce(near.d, -1) = every.d) AS same_best FROM every LEFT JOIN near USING (glyph_id)""")
def coarse_filter_equivalence(spark, sf_dir):
    glyphs, protos = glyph_bits(spark, sf_dir)
    near = ds.coarse_counts(glyphs, protos).join(ds.coarse_minimum(glyphs, protos).withColumnRenamed("distance", "near"), "glyph_id")
    every = ds.class_minimum(glyphs, protos).groupBy("glyph_id").agg(F.min("distance").alias("d"))
    return every.join(near, "glyph_id", "left").select("glyph_id", F.coalesce("n", F.lit(0)).alias("n_coarse"), (F.coalesce("near", F.lit(-1)) == F.col("d")).alias("same_best"))


@register("""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
c AS (SELECT vec_id, label, list_transform(e, lambda x: x - list_avg(e)) AS c FROM v),
u AS (SELECT vec_id, label, c, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS norm FROM c)
SELECT g.vec_id AS glyph_id, b.label AS char_id, round(greatest(0.0, max(list_dot_product(g.c, b.c) / (g.norm * b.norm))), 6) AS ncc
FROM u g, u b WHERE g.vec_id % 5 = 0 AND b.vec_id % 5 <> 0 GROUP BY 1, 2""")
def ncc_best(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("char_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    glyphs = emb.where("vec_id % 5 = 0").select(F.col("vec_id").alias("glyph_id"), "vec")
    return ds.ncc_best(glyphs, emb.where("vec_id % 5 <> 0")).withColumn("ncc", F.round("ncc", 6))


@register(f"""
WITH {LOGITS_SQL}, {RANKED_SQL.format(source="logits")},
cnn AS (SELECT glyph_id, char_id, logit FROM ranked WHERE rank <= 5),
second AS (SELECT glyph_id, logit AS l2 FROM ranked WHERE rank = 2),
tpl AS (SELECT glyph_id, char_id, score FROM (SELECT glyph_id, (char_id * 5 + 1) % 64 AS char_id, 1 / (1 + exp(-logit)) AS score, rank FROM ranked) WHERE rank <= 5),
fused AS (SELECT glyph_id, char_id, coalesce(score, 0) AS t, CASE WHEN logit IS NULL THEN 0 ELSE 1 / (1 + exp(-(logit - l2))) END AS c FROM cnn FULL JOIN tpl USING (glyph_id, char_id) JOIN second USING (glyph_id))
SELECT glyph_id, char_id, round(c, 6)::DOUBLE AS cnn_score, round(least(1, greatest(0, 0.45 * c + 0.45 * t)), 6)::DOUBLE AS combined, row_number() OVER (PARTITION BY glyph_id ORDER BY least(1, greatest(0, 0.45 * c + 0.45 * t)) DESC, char_id) AS rank FROM fused""")
def fuse_topk(spark, sf_dir):
    cnn = rk.topk(logits(spark, sf_dir), 5)
    template = cnn.select("glyph_id", ((F.col("char_id") * 5 + 1) % 64).alias("char_id"), (1 / (1 + F.exp(-F.col("logit")))).alias("score"))
    out = rk.fuse(template, cnn, 0.45, 0.45)
    return out.select("glyph_id", "char_id", F.round("cnn_score", 6).alias("cnn_score"), F.round("combined", 6).alias("combined"), F.col("rank").cast("long").alias("rank"))


@register(f"""
WITH {BITS_SQL}, wanted AS (SELECT vec_id AS glyph_id, unnest([vec_id % 7, (vec_id + 3) % 11, 1000]) AS char_id FROM embeddings WHERE vec_id % 5 = 0),
own AS (SELECT DISTINCT glyph_id, char_id FROM wanted),
p AS (SELECT o.glyph_id, o.char_id, proto_id, distance, abs(g_ink - p_ink) <= floor(0.2 * g_ink) + 3 AS near, CASE WHEN proto_id % 3 = 2 THEN 'clean' ELSE (12 + proto_id % 4) || '_' || (proto_id % 3) END AS state FROM own o JOIN dist d ON d.glyph_id = o.glyph_id AND d.char_id = o.char_id),
e AS (SELECT glyph_id, char_id, state, min(distance) AS d FROM p GROUP BY ALL), st AS (SELECT glyph_id, char_id, string_agg(state || '=' || (64 - d), ',' ORDER BY state) AS states FROM e GROUP BY ALL),
b AS (SELECT glyph_id, char_id, min(distance) AS distance, arg_min(proto_id, distance * 1000000 + proto_id) AS proto_id, bool_or(near) AS coarse_hit FROM p GROUP BY ALL)
SELECT glyph_id, char_id::BIGINT AS char_id, coalesce(distance, 64)::BIGINT AS distance, round(1 - coalesce(distance, 64) / 64.0, 9)::DOUBLE AS score, coalesce(proto_id, -1)::BIGINT AS proto_id, coalesce(coarse_hit, false) AS coarse_hit, coalesce(states, '') AS states
FROM own LEFT JOIN b USING (glyph_id, char_id) LEFT JOIN st USING (glyph_id, char_id)""")
def template_evidence(spark, sf_dir):
    glyphs, protos = glyph_bits(spark, sf_dir)
    own = protos.withColumns({"render_size": 12 + F.col("proto_id") % 4, "mode": F.col("proto_id") % 3})
    i = F.col("glyph_id")
    wanted = glyphs.select("glyph_id", F.explode(F.array((i % 7).cast("long"), ((i + 3) % 11).cast("long"), F.lit(1000).cast("long"))).alias("char_id")).distinct()
    out = ds.char_evidence(wanted, glyphs, own, 64)
    states = F.array_join(F.transform(F.map_entries("states"), lambda e: F.concat(e["key"], F.lit("="), F.rint(e["value"] * 64).cast("int").cast("string"))), ",")
    return out.select("glyph_id", "char_id", "distance", F.round("score", 9).alias("score"), F.col("proto_id").cast("long").alias("proto_id"), "coarse_hit", F.coalesce(states, F.lit("")).alias("states"))
