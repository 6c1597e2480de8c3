"""Lexicons as tables (domain, ord, term), and matching of visible texts against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import characters, normalize_text, subsequence_span

#: The order of kinds on equal scores, and their scores.
KINDS = ("exact", "term_in_text", "prefix_crop", "suffix_crop", "inner_crop", "gap_crop")
SCORES = {"exact": 1.0, "term_in_text": 0.97, "prefix_crop": 0.92, "suffix_crop": 0.92, "inner_crop": 0.80}
#: Lexicons up to this many terms may be sent to every task; larger ones are joined by shuffle on shared characters.
BROADCAST_TERMS = 100_000
LONGEST_TERM = 256


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: a pre-aggregated minimum, not a window."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("first"))
    return best.select(*keys, *(F.col("first")[c].alias(c) for c in [*order, *rest]))


def build_lexicon(df: DataFrame, term_col: str, order_col: str, domain: str) -> DataFrame:
    """(domain, ord, term): normalised, empties dropped, first seen kept."""
    terms = df.select(F.lit(domain).alias("domain"), F.col(order_col).cast("long").alias("ord"), normalize_text(F.col(term_col)).alias("term"))
    return first_seen(terms.where("term <> ''"), ["term"], ["ord"]).select("domain", "ord", "term")


def union_lexicons(parts: list[DataFrame], domain: str) -> DataFrame:
    """Lexicons one after another, first seen kept; ``part`` tells which one a term came from."""
    marked = [p.select(F.lit(i).alias("part"), "ord", "term") for i, p in enumerate(parts)]
    out = marked[0]
    for m in marked[1:]:
        out = out.unionByName(m)
    return first_seen(out, ["term"], ["part", "ord"]).select(F.lit(domain).alias("domain"), "part", "ord", "term")


def charset(df: DataFrame, text_col: str, by: list[str] | None = None) -> DataFrame:
    """Distinct non-space characters in code-point order, as one string for each group."""
    by = by or []
    chars = df.select(*by, F.explode(F.array_distinct(characters(normalize_text(F.col(text_col))))).alias("ch")).distinct()
    return chars.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("ch")), "").alias("charset"), F.count("*").alias("n"))


def char_index(lexicon: DataFrame) -> DataFrame:
    """(ch, term): the inverted index of a lexicon."""
    return lexicon.select(F.explode(F.array_distinct(characters(F.col("term")))).alias("ch"), "term")


def small_enough(lexicon: DataFrame) -> bool:
    """Whether a lexicon has a checked size that may be broadcast."""
    found = lexicon.limit(BROADCAST_TERMS + 1).agg(F.count("*").alias("n"), F.max(F.length("term")).alias("most")).first()
    return found.n <= BROADCAST_TERMS and (found.most or 0) <= LONGEST_TERM


def rarest(df: DataFrame, text_col: str, frequency: DataFrame) -> DataFrame:
    """Add ``ch``, the character of the text that the fewest terms hold; null if one of them is in no term. ``frequency`` (ch, n) is bounded by the charset."""
    known = frequency.agg(F.map_from_entries(F.collect_list(F.struct("ch", "n"))).alias("_df"))
    own = df.join(F.broadcast(known))  # one row
    each = F.transform(F.array_distinct(characters(F.col(text_col))), lambda c: F.struct(F.coalesce(F.col("_df")[c], F.lit(0).cast("long")).alias("n"), c.alias("c")))
    least = F.array_min(each)
    return own.withColumn("ch", F.when(least["n"] > 0, least["c"])).drop("_df")


def candidate_pairs(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Text-term pairs that may match, by an equi-join on the rarest character.

    All characters of a text inside or spread over a term are in the term, its rarest too; a longer text holds the rarest character of a term inside it.
    A small lexicon is broadcast; else the join is a shuffle on characters.
    """
    index = char_index(lexicon)
    frequency = index.groupBy("ch").agg(F.count("*").alias("n"))
    send = F.broadcast if small_enough(lexicon) else (lambda x: x)
    inside = rarest(texts, "text", frequency).where("ch is not null").join(send(index), "ch").drop("ch")
    rare = rarest(lexicon.select("term"), "term", frequency)
    around = texts.withColumn("ch", F.explode(F.array_distinct(characters(F.col("text"))))).join(send(rare), "ch").drop("ch")
    around = around.where(F.length("text") > F.length("term"))
    return inside.where(F.length("text") <= F.length("term")).unionByName(around)


def match_columns(text: Column, term: Column) -> dict[str, Column]:
    """kind, score and spans of one pair; kind is null where they don't match."""
    at, back = F.instr(term, text), F.instr(text, term)
    n, m = F.length(text), F.length(term)
    gap = F.when((n <= m) & (at == 0) & (back == 0), subsequence_span(text, term))
    gap_ok = gap["ok"] & (gap["first"] > 0)
    kind = F.when((text == "") | (term == ""), None).when(text == term, "exact").when(at == 1, "prefix_crop").when((at > 0) & (at + n - 1 == m), "suffix_crop").when(at > 0, "inner_crop").when(back > 0, "term_in_text").when(gap_ok, "gap_crop")
    missing = gap["last"] - gap["first"] + 1 - n
    loose = F.greatest(F.lit(0.20), 0.70 - 0.12 * missing)
    loose = F.when((gap["first"] > 1) & (gap["last"] < m), F.greatest(F.lit(0.15), loose - 0.05)).otherwise(loose)
    fixed = F.create_map(*(F.lit(x) for kv in SCORES.items() for x in kv))
    return {
        "kind": kind,
        "score": F.when(kind == "gap_crop", loose).otherwise(fixed[kind]),
        "span_start": F.when(kind.isin("exact", "term_in_text"), 0).when(kind == "gap_crop", gap["first"] - 1).otherwise(at - 1),
        "span_end": F.when(kind.isin("exact", "term_in_text"), m).when(kind == "gap_crop", gap["last"]).otherwise(at - 1 + n),
        "text_start": F.when(kind == "term_in_text", back - 1).otherwise(0),
        "text_end": F.when(kind == "term_in_text", back - 1 + m).otherwise(n),
    }


def match_all(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Every match of (text_id, text) with a term."""
    pairs = candidate_pairs(texts.withColumn("text", normalize_text(F.col("text"))), lexicon)
    return pairs.withColumns(match_columns(F.col("text"), F.col("term"))).where("kind is not null")


def match_order() -> list[Column]:
    rank = F.element_at(F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i))), F.col("kind"))
    length = F.when(F.col("kind") == "term_in_text", -F.length("term")).otherwise(F.length("term"))
    return [F.col("score").desc(), rank, length, F.col("span_start"), F.col("term")]


def ranked(matches: DataFrame, limit: int | None = None) -> DataFrame:
    """Matches of a text in order; ``limit`` is pushed into the window."""
    out = matches.withColumn("rank", F.row_number().over(Window.partitionBy("text_id").orderBy(*match_order())))
    return out if limit is None else out.where(F.col("rank") <= limit)


def best_match(matches: DataFrame, unique: bool = False) -> DataFrame:
    """The first match; ``unique`` gives none where the next, different term has the same score."""
    top = ranked(matches, 2)
    if unique:
        w = Window.partitionBy("text_id").orderBy("rank")
        top = top.withColumns({"next_score": F.lead("score").over(w), "next_term": F.lead("term").over(w)})
        top = top.where(F.col("next_score").isNull() | (F.col("next_term") == F.col("term")) | (F.abs(F.col("next_score") - F.col("score")) >= 1e-9)).drop("next_score", "next_term")
    return top.where("rank = 1").drop("rank")
