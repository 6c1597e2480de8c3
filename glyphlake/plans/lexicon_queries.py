"""Lexicons, matching and resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import HAN, characters, strip_color_codes
from ..operators import lexicon as lx
from ..operators import resolve
from .carriers import MATCH_SQL, crops, crops_sql, nation_lexicon, part_lexicon, table
from .catalogue import register

PART_SQL = crops_sql("part", "p_name", "p_partkey")
MISREAD_SQL = crops_sql("part", "p_name", "p_partkey", misread=True)
NATION_SQL = crops_sql("nation", "n_name", "n_nationkey")


@register("SELECT 'part' AS domain, min(p_partkey) AS ord, replace(p_name, ' ', '') AS term FROM part GROUP BY 3")
def lexicon_normalize_dedup(spark, sf_dir):
    return part_lexicon(spark, sf_dir)


@register("""
WITH every AS (SELECT 0 AS part, r_regionkey::BIGINT AS ord, replace(r_name, ' ', '') AS term FROM region
  UNION ALL SELECT 1, n_nationkey::BIGINT, replace(n_name, ' ', '') FROM nation
  UNION ALL SELECT 2, p_partkey, replace(p_name, ' ', '') FROM part)
SELECT 'all' AS domain, part, ord, term FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY part, ord) AS rn FROM every WHERE term <> '') WHERE rn = 1""")
def lexicon_union_first_seen(spark, sf_dir):
    region = lx.build_lexicon(table(spark, sf_dir, "region"), "r_name", "r_regionkey", "region")
    return lx.union_lexicons([region, nation_lexicon(spark, sf_dir), part_lexicon(spark, sf_dir)], "all")


@register("""
SELECT lang, string_agg(ch, '' ORDER BY ch) AS charset, count(*) AS n FROM (
  SELECT DISTINCT lang, unnest(string_split(regexp_replace(coalesce(text, ''), '[\\x09-\\x0D\\x1C-\\x20\\x85\\x{A0}]', '', 'g'), '')) AS ch FROM documents)
WHERE ch <> '' GROUP BY lang""")
def charset_of_terms(spark, sf_dir):
    return lx.charset(table(spark, sf_dir, "documents"), "text", ["lang"])


@register("""
WITH texts AS (SELECT text FROM documents UNION ALL SELECT '漢字仮名㐀' UNION ALL SELECT '約克城abc'),
chars AS (SELECT unnest(string_split(coalesce(text, ''), '')) AS ch FROM texts)
SELECT CASE WHEN ch BETWEEN '㐀' AND '䶿' OR ch BETWEEN '一' AND '鿿' OR ch BETWEEN '豈' AND chr(64255) THEN 'han' WHEN unicode(ch) < 128 THEN 'ascii' WHEN unicode(ch) < 256 THEN 'latin1' ELSE 'other' END AS script, count(*) AS n
FROM chars WHERE ch <> '' GROUP BY 1""")
def script_class_counts(spark, sf_dir):
    extra = spark.range(2).select(F.when(F.col("id") == 0, "漢字仮名㐀").otherwise("約克城abc").alias("text"))
    chars = table(spark, sf_dir, "documents").select("text").unionByName(extra).select(F.explode(characters(F.col("text"))).alias("ch"))
    script = F.when(F.col("ch").rlike(HAN), "han").when(F.ascii("ch") < 128, "ascii").when(F.ascii("ch") < 256, "latin1").otherwise("other")
    return chars.groupBy(script.alias("script")).agg(F.count("*").alias("n"))


@register("SELECT event_id, regexp_replace('^C0a1B2c3D ' || event_type || '^CffffffffFFFFFFFF' || props || '^C12', '\\^C[0-9A-Fa-f]{8}([0-9A-Fa-f]{8})?', '', 'g') AS plain FROM events")
def strip_color_codes_query(spark, sf_dir):
    coded = F.concat(F.lit("^C0a1B2c3D "), F.col("event_type"), F.lit("^CffffffffFFFFFFFF"), F.col("props"), F.lit("^C12"))
    return table(spark, sf_dir, "events").select("event_id", strip_color_codes(coded).alias("plain"))


def shown(matches):
    return matches.select("text_id", "text", "term", "kind", F.round("score", 6).alias("score"), F.col("span_start").cast("long").alias("span_start"), F.col("span_end").cast("long").alias("span_end"))


SHOWN_SQL = "SELECT text_id, text, term, kind, round(score, 6) AS score, span_start, span_end FROM"


@register(f"WITH RECURSIVE {NATION_SQL}, {MATCH_SQL} {SHOWN_SQL} matches")
def lexicon_match_all(spark, sf_dir):
    lex = nation_lexicon(spark, sf_dir)
    return shown(lx.match_all(crops(lex), lex))


@register(f"WITH RECURSIVE {PART_SQL}, {MATCH_SQL} {SHOWN_SQL} ordered WHERE rank = 1")
def lexicon_best_match(spark, sf_dir):
    lex = part_lexicon(spark, sf_dir)
    return shown(lx.best_match(lx.match_all(crops(lex), lex)))


@register(f"WITH RECURSIVE {PART_SQL}, {MATCH_SQL} {SHOWN_SQL} ordered WHERE rank = 1 AND (next_score IS NULL OR abs(next_score - score) >= 1e-9)")
def lexicon_best_unique(spark, sf_dir):
    lex = part_lexicon(spark, sf_dir)
    return shown(lx.best_match(lx.match_all(crops(lex), lex), unique=True))


@register(f"WITH RECURSIVE {NATION_SQL}, {MATCH_SQL} {SHOWN_SQL} matches WHERE kind = 'gap_crop'")
def gap_crop_subsequence(spark, sf_dir):
    lex = nation_lexicon(spark, sf_dir)
    return shown(lx.match_all(crops(lex), lex).where("kind = 'gap_crop'"))


#: Each text's alternatives: the character itself and its two successors; a confidence that varies by place.
READ_SQL = """
pos AS (SELECT text_id, text, i - 1 AS i, c, ((text_id * 7 + (i - 1) * 13) % 100) / 100.0 AS conf FROM (SELECT text_id, text, unnest(string_split(text, '')) AS c, unnest(range(1, length(text) + 1)) AS i FROM texts)),
pair AS (SELECT p.*, l.term, substr(l.term, (i + 1)::INT, 1) AS t FROM pos p JOIN lex l ON length(l.term) = length(p.text)),
weighed AS (SELECT *, CASE WHEN t = c THEN 1.0 WHEN t = chr(unicode(c) + 1) THEN 0.70 WHEN t = chr(unicode(c) + 2) THEN 0.60 ELSE 0.0 END AS weight FROM pair)"""


@register(f"""
WITH {MISREAD_SQL}, {READ_SQL},
cand AS (SELECT text_id, text, term, round(avg(weight), 9) AS score, sum((t <> c)::INT) AS changes FROM weighed GROUP BY ALL HAVING min(weight) > 0 AND sum((t <> c)::INT) > 0 AND avg(weight) >= 0.6),
ranked AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS nxt FROM cand WHERE text NOT IN (SELECT term FROM lex) WINDOW w AS (PARTITION BY text_id ORDER BY score DESC, changes, term))
SELECT text_id, text, term, round(score, 6) AS score FROM ranked WHERE rank = 1 AND (nxt IS NULL OR score - nxt >= 0.02)""")
def topk_guess(spark, sf_dir):
    lex = part_lexicon(spark, sf_dir)
    return resolve.topk_guess(resolve.shifted_reading(spark, lex), lex).select("text_id", "text", "term", F.round("score", 6).alias("score"))


@register(f"""
WITH RECURSIVE {MISREAD_SQL}, {MATCH_SQL}, {READ_SQL},
cand AS (SELECT text_id, term, round(1 - least(0.6, 0.5 * sum(CASE WHEN t <> c THEN greatest(0.0, (0.9 - conf) / 0.9) ELSE 0 END)), 9) AS score FROM weighed GROUP BY text_id, term
  HAVING min(CASE WHEN t = c OR (conf < 0.9 AND weight > 0) THEN 1 ELSE 0 END) = 1 AND sum((t <> c)::INT) > 0),
fixes AS (SELECT * FROM (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS nxt FROM cand WHERE score >= 0.5 WINDOW w AS (PARTITION BY text_id ORDER BY score DESC, term)) WHERE rn = 1 AND (nxt IS NULL OR score - nxt >= 0.02)),
best AS (SELECT text_id, term, kind FROM ordered WHERE rank = 1),
modes AS (SELECT unnest(['none', 'prefer', 'strict']) AS mode),
every AS (SELECT mode, t.text_id, t.text, b.term AS annotated, b.kind, f.term AS fix FROM texts t CROSS JOIN modes LEFT JOIN best b USING (text_id) LEFT JOIN fixes f USING (text_id))
SELECT text_id, mode,
  CASE WHEN mode = 'none' OR kind = 'exact' THEN text WHEN mode = 'prefer' THEN coalesce(fix, text) ELSE coalesce(fix, '') END AS resolved,
  CASE WHEN mode = 'none' THEN NULL WHEN kind = 'exact' THEN annotated WHEN fix IS NOT NULL THEN fix WHEN mode = 'prefer' THEN annotated END AS matched_term
FROM every""")
def lexicon_mode_dispatch(spark, sf_dir):
    lex = part_lexicon(spark, sf_dir)
    return resolve.dispatch(resolve.shifted_reading(spark, lex), lex, ["none", "prefer", "strict"])


@register()
def dict_assoc_match(spark, sf_dir):
    lex = part_lexicon(spark, sf_dir)
    return resolve.assoc_match(resolve.shifted_reading(spark, lex), lex)
