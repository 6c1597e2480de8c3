"""Input tables of the queries, derived from the driver's tables; each has a twin in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.distance import with_bits
from ..operators.lexicon import build_lexicon


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_lexicon(table(spark, sf_dir, "part"), "p_name", "p_partkey", "part")


def nation_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_lexicon(table(spark, sf_dir, "nation"), "n_name", "n_nationkey", "nation")


def crops(lexicon: DataFrame, misread: bool = False) -> DataFrame:
    """Six visible texts of each term: cropped at either side or both, longer, whole, and without its third character.

    ``misread`` takes the third character of the whole term for its predecessor.
    """
    t, n = F.col("term"), F.length("term")
    whole = F.concat(F.substring(t, 1, 2), F.char(F.ascii(F.substring(t, 3, 1)) - 1), F.substring(t, F.lit(4), n)) if misread else t
    forms = [F.substring(t, F.lit(1), n - 2), F.substring(t, F.lit(3), n), F.substring(t, F.lit(2), n - 2), F.concat(t, F.lit("x")), whole, F.concat(F.substring(t, 1, 2), F.substring(t, F.lit(4), n))]
    return lexicon.select("ord", F.posexplode(F.array(*forms)).alias("variant", "text")).select((F.col("ord") * 6 + F.col("variant")).alias("text_id"), "text").where("text <> ''")


def crops_sql(source: str, name: str, key: str, misread: bool = False) -> str:
    whole = "substr(term, 1, 2) || chr(unicode(substr(term, 3, 1)) - 1) || substr(term, 4)" if misread else "term"
    return f"""
lex AS (SELECT min({key})::BIGINT AS ord, replace({name}, ' ', '') AS term FROM {source} GROUP BY 2),
texts AS (
  SELECT ord * 6 + variant AS text_id, text FROM (
    SELECT ord, unnest([0, 1, 2, 3, 4, 5]) AS variant,
      unnest([substr(term, 1, length(term) - 2), substr(term, 3), substr(term, 2, length(term) - 2), term || 'x', {whole}, substr(term, 1, 2) || substr(term, 4)]) AS text FROM lex)
  WHERE text <> '')"""


#: Matches of texts with terms by nested loop, with the greedy subsequence as a recursion over the text.
MATCH_SQL = """
pairs AS (SELECT text_id, text, term, length(text) AS n, length(term) AS m, strpos(term, text) AS inside, strpos(text, term) AS back FROM texts, lex WHERE text <> '' AND term <> ''),
walk AS (
  SELECT text_id, text, term, n, m, 0 AS i, 0 AS first, 0 AS last, true AS ok FROM pairs WHERE n <= m AND inside = 0 AND back = 0
  UNION ALL
  SELECT text_id, text, term, n, m, i + 1, CASE WHEN first = 0 AND p > 0 THEN last + p ELSE first END, last + p, p > 0
  FROM (SELECT *, strpos(substr(term, last + 1), substr(text, i + 1, 1)) AS p FROM walk WHERE ok AND i < n)),
gaps AS (SELECT text_id, term, first, last, last - first + 1 - n AS missing FROM walk WHERE i = n AND ok),
kinds AS (
  SELECT p.*, g.first, g.last, g.missing,
    CASE WHEN text = p.term THEN 'exact' WHEN inside = 1 THEN 'prefix_crop' WHEN inside > 0 AND inside + n - 1 = m THEN 'suffix_crop' WHEN inside > 0 THEN 'inner_crop'
      WHEN back > 0 THEN 'term_in_text' WHEN g.first IS NOT NULL THEN 'gap_crop' END AS kind
  FROM pairs p LEFT JOIN gaps g ON g.text_id = p.text_id AND g.term = p.term),
matches AS (
  SELECT text_id, text, term, kind,
    CASE kind WHEN 'exact' THEN 1.0 WHEN 'prefix_crop' THEN 0.92 WHEN 'suffix_crop' THEN 0.92 WHEN 'inner_crop' THEN 0.80 WHEN 'term_in_text' THEN 0.97
      ELSE CASE WHEN first > 1 AND last < m THEN greatest(0.15, greatest(0.20, 0.70 - 0.12 * missing) - 0.05) ELSE greatest(0.20, 0.70 - 0.12 * missing) END END::DOUBLE AS score,
    CASE WHEN kind IN ('exact', 'term_in_text') THEN 0 WHEN kind = 'gap_crop' THEN first - 1 ELSE inside - 1 END::BIGINT AS span_start,
    CASE WHEN kind IN ('exact', 'term_in_text') THEN m WHEN kind = 'gap_crop' THEN last ELSE inside - 1 + n END::BIGINT AS span_end
  FROM kinds WHERE kind IS NOT NULL),
ordered AS (
  SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS next_score FROM matches
  WINDOW w AS (PARTITION BY text_id ORDER BY round(score, 9) DESC,
    CASE kind WHEN 'exact' THEN 0 WHEN 'term_in_text' THEN 1 WHEN 'prefix_crop' THEN 2 WHEN 'suffix_crop' THEN 3 WHEN 'inner_crop' THEN 4 ELSE 5 END,
    CASE WHEN kind = 'term_in_text' THEN -length(term) ELSE length(term) END, span_start, term))"""


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").alias("glyph_id"), F.posexplode("embedding").alias("char_id", "logit")).withColumn("logit", F.col("logit").cast("double"))


LOGITS_SQL = "logits AS (SELECT vec_id AS glyph_id, (i - 1)::INT AS char_id, v::DOUBLE AS logit FROM embeddings, unnest(embedding) WITH ORDINALITY AS t(v, i))"


def glyph_bits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Glyphs (every fifth vector) and prototypes (the others), as sign bits."""
    emb = with_bits(table(spark, sf_dir, "embeddings"), "embedding")
    glyphs = emb.where("vec_id % 5 = 0").select(F.col("vec_id").alias("glyph_id"), "bits", "ink")
    return glyphs, emb.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("proto_id"), F.col("label").alias("char_id"), "bits", "ink")


BITS_SQL = """
signs AS (SELECT vec_id, label, list_transform(embedding, lambda v: CASE WHEN v > 0 THEN 1 ELSE 0 END) AS s FROM embeddings),
glyphs AS (SELECT vec_id AS glyph_id, s, list_sum(s) AS ink FROM signs WHERE vec_id % 5 = 0),
protos AS (SELECT vec_id AS proto_id, label AS char_id, s, list_sum(s) AS ink FROM signs WHERE vec_id % 5 <> 0),
dist AS (SELECT glyph_id, proto_id, char_id, g.ink AS g_ink, p.ink AS p_ink, list_sum(list_transform(list_zip(g.s, p.s), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS distance FROM glyphs g, protos p)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return both.select(F.col("doc_id").alias("id"), ((F.col("n_chars") % 101) / 100.0).alias("confidence"), (F.col("quality") == 1).alias("correct"))


PREDICTIONS_SQL = "pred AS (SELECT doc_id AS id, (n_chars % 101) / 100.0::DOUBLE AS confidence, CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END AS hit FROM labels JOIN documents USING (doc_id))"

ATOM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.lattice import ordered_atoms

    items = table(spark, sf_dir, "lineitem").select("l_orderkey", *ATOM_ORDER)
    own = ordered_atoms(items, "l_orderkey", ATOM_ORDER)
    return own.select(F.col("l_orderkey").alias("line_id"), "atom_idx", (F.col("atom_idx") * 10).cast("double").alias("x"), F.col("l_quantity").alias("w"), (1 + F.col("l_linenumber")).cast("double").alias("h"), "l_partkey")


ATOMS_SQL = """
atoms AS (
  SELECT l_orderkey AS line_id, atom_idx, 10.0 * atom_idx AS x, l_quantity AS w, 1.0 + l_linenumber AS h, l_partkey FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS atom_idx FROM lineitem)),
cands AS (
  SELECT a.line_id, a.atom_idx AS s, b.atom_idx + 1 AS e, min(c.x) AS x, max(c.x + c.w) - min(c.x) AS w, max(c.h) AS h,
    round(0.5 + 0.5 * ((any_value(a.l_partkey) * 7 + b.atom_idx + 1 - a.atom_idx) % 97) / 97, 9) AS score
  FROM atoms a JOIN atoms b ON b.line_id = a.line_id AND b.atom_idx BETWEEN a.atom_idx AND a.atom_idx + 2
    JOIN atoms c ON c.line_id = a.line_id AND c.atom_idx BETWEEN a.atom_idx AND b.atom_idx
  GROUP BY a.line_id, a.atom_idx, b.atom_idx)"""


def scored_candidates(spark: SparkSession, sf_dir: str, longest: int = 3) -> DataFrame:
    from ..operators.lattice import candidate_ranges

    cand = candidate_ranges(atoms(spark, sf_dir), longest, ["l_partkey"])
    score = F.round(0.5 + 0.5 * ((F.col("l_partkey") * 7 + F.col("end") - F.col("start")) % 97) / 97, 9)
    return cand.withColumn("score", score).drop("l_partkey")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select("user_id", "ts", "event_id", "event_type", F.concat("event_type", "props").alias("signature"), "value", (F.least("value", F.lit(100.0)) / 100).alias("confidence"))
