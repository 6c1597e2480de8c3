"""Lexicon-aware decoding of misread terms, and atoms of wide components. Neither can be written as SQL; tests compare with brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import characters
from .. import lines
from ..engine import glyph_bits
from ..operators import domain_prior, glyphs, lexicon_decode, merges, prob_decoder, vision
from ..operators.segmentation import Bounds
from .carriers import crops, part_lexicon
from .catalogue import register
from .vision_queries import images


def options(spark, sf_dir):
    """Two characters for each place of a cropped term (itself and its successor, by rule the wrong one first), and a wide candidate for every second pair of places."""
    texts = crops(part_lexicon(spark, sf_dir), misread=True)
    placed = texts.select(F.col("text_id").alias("line_id"), F.posexplode(characters(F.col("text"))).alias("start", "ch"))
    wrong = (F.col("line_id") * 5 + F.col("start") * 11) % 7 < 2
    visual = 0.5 + ((F.col("line_id") * 7 + F.col("start") * 13) % 40) / 100.0
    after = F.char(F.ascii("ch") + 1)
    both = F.array(F.struct(F.when(wrong, after).otherwise(F.col("ch")).alias("char"), visual.alias("visual")), F.struct(F.when(wrong, F.col("ch")).otherwise(after).alias("char"), (visual - 0.05).alias("visual")))
    single = placed.withColumn("o", F.explode(both)).select("line_id", "start", (F.col("start") + 1).alias("end"), F.when(F.col("o.visual") == visual, 0).otherwise(1).alias("rank"), F.col("o.char").alias("char"), F.col("o.visual").alias("visual"), (-0.01 * (F.col("start") % 3)).alias("geometry"))
    last = placed.groupBy("line_id").agg(F.max("start").alias("last"))
    wide = placed.join(last, "line_id").where((F.col("start") % 2 == 0) & (F.col("start") < F.col("last"))).select("line_id", "start", (F.col("start") + 2).alias("end"), F.lit(0).alias("rank"), F.lit("w").alias("char"), (visual - 0.1).alias("visual"), F.lit(-0.02).alias("geometry"))
    return single.unionByName(wide)


@register()
def lexicon_decode_dp(spark, sf_dir):
    out = lexicon_decode.decode_lattice(options(spark, sf_dir), part_lexicon(spark, sf_dir), beam=False)
    return out.select("line_id", "text", "path", "n", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"))


@register()
def lexicon_decode_beam(spark, sf_dir):
    out = lexicon_decode.decode_lattice(options(spark, sf_dir), part_lexicon(spark, sf_dir))
    return out.select("line_id", "text", "path", "n", F.round("score", 6).alias("score"), F.array_join("alternatives", "|").alias("alternatives"))


@register()
def expand_atoms(spark, sf_dir):
    """Each order's bars side by side as one component, cut at the blank columns between them."""
    whole = vision.masks_of_lines(images(spark, sf_dir))
    return merges.expand_atoms(whole).select("line_id", "atom_idx", "component", "x", "y", "w", "h", "ink", "pieces")


@register()
def character_glyphs(spark, sf_dir):
    """Each bar of an order as a character: components, fragments put together, normalised."""
    out = glyphs.character_glyphs(images(spark, sf_dir), bounds=Bounds(height_least=2, width_least=2))
    return out.select("image_id", "line", "idx", "x", "y", "w", "h", F.sha2("glyph", 256).alias("glyph_sha256"))


@register()
def line_readings(spark, sf_dir):
    """Bars read as the letter of their height: whole lines through the lattice, with the first image of each height as the prototypes."""
    drawn = images(spark, sf_dir)
    single = glyphs.character_glyphs(drawn, bounds=Bounds(height_least=2, width_least=2)).groupBy("w", "h").agg(F.min("glyph").alias("glyph"))
    named = single.select((F.col("w") * 100 + F.col("h")).cast("long").alias("char_id"), F.lit(0).alias("proto_id"), "glyph")
    charset = named.select("char_id", F.char(F.col("char_id") % 26 + 65).alias("ch"))
    reading = lines.Reading(bounds=Bounds(height_least=2, width_least=2), longest=2)
    return lines.read_lines(drawn, glyph_bits(named).drop("glyph"), charset, reading=reading).select("image_id", "line", "text", F.round("score", 6).alias("score"))


@register()
def prob_decode_lattice(spark, sf_dir):
    """The misread terms again, under two render states, with features by rule and random weights of a fixed seed."""
    own = options(spark, sf_dir)
    char_id = F.ascii("char").cast("long")
    states = F.explode(F.array(F.lit("clean"), F.lit("12_1"))).alias("state")
    wave = lambda n, k: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.sin(i * F.col("visual") * 7 + F.col("start") + char_id * k + F.length("state")))
    features = own.select("*", states, char_id.alias("char_id")).select("line_id", "state", "start", "end", "rank", "char_id", wave(26, 3).alias("f_visual"), wave(9, 5).alias("f_geometry"))
    spans = own.groupBy("line_id", "start", "end").agg(F.max("visual").alias("visual"))
    edge = F.transform(F.sequence(F.lit(1), F.lit(14)), lambda i: F.cos(i * F.col("visual") + F.col("start")))
    boundaries = spans.select("line_id", "start", "end", edge.alias("f_boundary"), (F.col("end") - F.col("start") > 1).alias("anomalous"))
    charset = own.select(char_id.alias("char_id"), F.col("char").alias("ch")).distinct()
    config = prob_decoder.random_config(7, alpha=0.9, beta=0.5, k=4)
    scored = prob_decoder.option_scores(features, boundaries, domain_prior.lexicon_prior(charset, part_lexicon(spark, sf_dir)), config)
    out = prob_decoder.decode_lattice(scored, charset, config)
    return out.select("line_id", "text", "path", F.round("normalised", 6).alias("normalised"), F.round("confidence", 6).alias("confidence"), "state", "searched")
