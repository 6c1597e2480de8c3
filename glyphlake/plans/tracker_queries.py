"""Frame histories over events: a stream for each user."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..streaming import tracker
from ..session import shared_dir
from .carriers import frames, table
from .catalogue import register

ORDER = ["ts", "event_id"]


@register("SELECT user_id, event_id, coalesce(event_type || props <> lag(event_type || props) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS changed FROM events")
def change_flag(spark, sf_dir):
    return tracker.change_flags(frames(spark, sf_dir), "user_id", ORDER, "signature").select("user_id", "event_id", "changed")


@register("""
WITH f AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
v AS (SELECT a.user_id, a.event_id, b.event_type, count(*) AS n, min(b.i) AS first FROM f a JOIN f b ON a.user_id = b.user_id AND b.i BETWEEN a.i - 7 AND a.i GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY event_id) AS total, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, first) AS rn FROM v)
SELECT user_id, event_id, CASE WHEN total >= 3 AND n / total >= 0.6 THEN event_type END AS stable FROM r WHERE rn = 1""")
def stable_vote_window8(spark, sf_dir):
    return tracker.stable_votes(frames(spark, sf_dir), "user_id", ORDER, "event_type").select("user_id", "event_id", "stable")


@register("""
WITH f AS (SELECT user_id, event_id, event_type || '/' || (value::BIGINT % 60) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
p AS (SELECT *, lag(i) OVER (PARTITION BY user_id, k ORDER BY i) AS before FROM f)
SELECT user_id, event_id, before IS NOT NULL AND (SELECT count(DISTINCT k) FROM f WHERE f.user_id = p.user_id AND f.i > p.before AND f.i < p.i) < 32 AS hit FROM p""")
def lru_cache_hits(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    own = ev.select("user_id", "event_id", "ts", F.concat("event_type", F.lit("/"), (F.rint("value").cast("long") % 60).cast("string")).alias("k"))
    return tracker.cache_hits(own, ORDER, "k", "user_id").select("user_id", "event_id", "hit")


@register("""
WITH e AS (SELECT user_id, event_id % 4 AS position, event_type, sum(round(least(value, 100) * 100)::BIGINT) AS evidence, count(*) AS votes, max(event_id) AS latest FROM events GROUP BY 1, 2, 3)
SELECT user_id, position, event_type, evidence::BIGINT AS evidence, votes FROM (SELECT *, row_number() OVER (PARTITION BY user_id, position ORDER BY evidence DESC, votes DESC, latest DESC) AS rn FROM e) WHERE rn = 1""")
def fused_evidence(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 4).alias("position"), "event_type", F.round(F.least("value", F.lit(100.0)) * 100).cast("long").alias("logit"), "event_id")
    return tracker.fused_evidence(ev, "user_id", "position", "event_type", "logit", "event_id")


@register("""
WITH f AS (SELECT user_id::VARCHAR AS key, event_id AS seq, event_type AS text, event_type || props AS signature, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
c AS (SELECT *, coalesce(signature <> lag(signature) OVER (PARTITION BY key ORDER BY i), false) AS changed FROM f),
v AS (SELECT a.seq, b.text, count(*) AS n, min(b.i) AS first FROM f a JOIN f b ON a.key = b.key AND b.i BETWEEN a.i - 7 AND a.i GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY seq) AS total, row_number() OVER (PARTITION BY seq ORDER BY n DESC, first) AS rn FROM v)
SELECT key, c.seq, changed, c.text, CASE WHEN total >= 3 AND n / total >= 0.6 THEN r.text END AS stable FROM c JOIN r ON r.seq = c.seq AND rn = 1""")
def tracker_stream(spark, sf_dir):
    """The events as a stream, in one available-now run; the result is read back from its sink."""
    schema = table(spark, sf_dir, "events").schema
    base = shared_dir(spark)
    place = f"{base}/tracker-{uuid.uuid4().hex}"
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    own = source.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.concat("event_type", "props").alias("signature"), F.col("event_type").alias("text"))
    query = tracker.track_stream(own).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{place}/out")
