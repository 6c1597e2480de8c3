"""Regions, signatures and shown texts of frames: pixels from vectors, readings from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import characters
from ..streaming import frames as fr
from .carriers import frames, table
from .catalogue import register

WIDTH = 8


def pixels(spark, sf_dir):
    """Each vector as a grey frame, eight pixels wide."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), F.posexplode("embedding").alias("at", "v"))
    level = (F.col("at") * 37 + F.col("frame_id") * 11) % 120 + F.when(F.col("v") > 0, 90).otherwise(0)
    return own.select("frame_id", (F.col("at") % WIDTH).alias("x"), F.floor(F.col("at") / WIDTH).cast("int").alias("y"), *(level.alias(c) for c in "rgb"))


BOXES_SQL = f"""
px AS (SELECT vec_id AS frame_id, ((i - 1) % {WIDTH})::BIGINT AS x, ((i - 1) // {WIDTH})::BIGINT AS y, ((i - 1) * 37 + vec_id * 11) % 120 + CASE WHEN v > 0 THEN 90 ELSE 0 END AS l FROM embeddings, unnest(embedding) WITH ORDINALITY AS t(v, i)),
ends AS (SELECT frame_id, max(x) + 1 AS fw, max(y) + 1 AS fh, min(x) FILTER (l >= 128) AS x0, max(x) FILTER (l >= 128) AS x1, min(y) FILTER (l >= 128) AS y0, max(y) FILTER (l >= 128) AS y1 FROM px GROUP BY 1),
pad AS (SELECT *, greatest(1, least(4, (x1 - x0 + 1) // 4, (y1 - y0 + 1) // 4)) AS p FROM ends),
box AS (SELECT frame_id, CASE WHEN x0 IS NULL THEN 0 ELSE greatest(0, x0 - p) END AS x, CASE WHEN x0 IS NULL THEN 0 ELSE greatest(0, y0 - p) END AS y,
  CASE WHEN x0 IS NULL THEN 0 ELSE least(fw, x1 + 1 + p) - greatest(0, x0 - p) END AS w, CASE WHEN x0 IS NULL THEN 0 ELSE least(fh, y1 + 1 + p) - greatest(0, y0 - p) END AS h FROM pad)"""


@register(f"WITH {BOXES_SQL} SELECT frame_id, (x // 2)::BIGINT AS x, (y // 2)::BIGINT AS y, (w // 2)::BIGINT AS w, (h // 2)::BIGINT AS h FROM box")
def frame_boxes(spark, sf_dir):
    return fr.quantize(fr.ink_boxes(pixels(spark, sf_dir)))


@register(f"""
WITH {BOXES_SQL},
rows AS (SELECT frame_id, k, y + least(floor(k * h / 8.0), h - 1) AS a, y + greatest(ceil((k + 1) * h / 8.0), floor(k * h / 8.0) + 1) AS b FROM box, range(8) AS t(k) WHERE h > 0),
cols AS (SELECT frame_id, k, x + least(floor(k * w / 24.0), w - 1) AS a, x + greatest(ceil((k + 1) * w / 24.0), floor(k * w / 24.0) + 1) AS b FROM box, range(24) AS t(k) WHERE w > 0),
cells AS (SELECT r.frame_id, r.k AS r, c.k AS c, floor(avg(l))::INT AS m FROM rows r JOIN cols c USING (frame_id) JOIN px p ON p.frame_id = r.frame_id AND p.y >= r.a AND p.y < r.b AND p.x >= c.a AND p.x < c.b GROUP BY ALL),
sig AS (SELECT frame_id, sha256(unhex(string_agg(printf('%02X%02X%02X', m, m, m), '' ORDER BY r, c))) AS signature FROM cells GROUP BY 1)
SELECT frame_id, coalesce(signature, 'empty') AS signature FROM box LEFT JOIN sig USING (frame_id)""")
def frame_signatures(spark, sf_dir):
    own = pixels(spark, sf_dir)
    return fr.signatures(own, fr.ink_boxes(own))


def readings(spark, sf_dir):
    """Each event as a frame that shows its type, letter by letter, some of them misread."""
    own = frames(spark, sf_dir)
    misread = lambda i: (F.col("event_id") * 7 + i * 3) % 17 == 0
    letters = F.transform(characters(F.col("event_type")), lambda c, i: F.when(misread(i), F.char(F.ascii(c) + 1)).otherwise(c))
    sure = F.col("confidence")
    place = lambda c, i: F.struct((i * 10).cast("double").alias("x"), F.lit(8.0).alias("w"), c.alias("char"), sure.alias("confidence"), F.create_map(c, sure).alias("logits"))
    return own.select("user_id", "ts", "event_id", F.array_join(letters, "").alias("text"), F.transform(letters, place).alias("positions"))


@register()
def shown_texts(spark, sf_dir):
    out = fr.shown_texts(readings(spark, sf_dir), "user_id", ["ts", "event_id"])
    return out.select("user_id", "event_id", "stable", "fused", "shown", "source", F.array_join("alternatives", "|").alias("alternatives"))
