"""The engine's front: images in, texts out, as one plan over tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import distance, resolve, vision
from .sources.models import words_of

TOP_K = 5
MODES = ("none", "prefer", "topk", "strict", "dict")


def glyph_bits(glyphs: DataFrame) -> DataFrame:
    """Replace each normalised glyph by its packed bits, as an array of 64-bit words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [words_of(np.packbits(np.frombuffer(g, np.uint8) > 0)[None])[0] for g in batch["glyph"]]
            yield batch.drop(columns="glyph").assign(bits=rows)

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in glyphs.schema if f.name != "glyph"]
    return glyphs.mapInPandas(run, ", ".join([*kept, "bits array<bigint>"]))


class Engine:
    """Recognition against a table of prototypes (char_id, proto_id, bits) and a charset (char_id, ch).

    A lexicon (domain, ord, term) is optional; its mode is ``prefer`` where one is given, else ``none``.
    """

    def __init__(self, spark: SparkSession, prototypes: DataFrame, charset: DataFrame, lexicon: DataFrame | None = None, threshold: float = 128):
        self.spark, self.prototypes, self.charset, self.lexicon, self.threshold = spark, prototypes, charset, lexicon, threshold

    def read(self, images: DataFrame, allowed: str | None = None) -> DataFrame:
        """(text_id, text, chars) of each image: components from left to right, each with its nearest classes."""
        charset = self.charset if allowed is None else self.charset.where(F.instr(F.lit(allowed), F.col("ch")) > 0)
        glyphs = glyph_bits(vision.glyphs_of_images(images, self.threshold)).withColumn("glyph_id", F.struct("image_id", "comp"))
        pairs = distance.class_minimum(glyphs, self.prototypes.join(charset, "char_id", "left_semi"))
        ranked = distance.per_class_topk(pairs, TOP_K, vision.TARGET**2).join(charset, "char_id")
        each = ranked.groupBy("glyph_id").agg(F.sort_array(F.collect_list(F.struct("rank", "ch", "score"))).alias("best"))
        char = F.struct(F.col("best")[0]["ch"].alias("ch"), F.col("best")[0]["score"].alias("conf"), F.transform("best", lambda b: b["ch"]).alias("alts"))
        lines = glyphs.join(each, "glyph_id").groupBy(F.col("image_id").alias("text_id")).agg(F.sort_array(F.collect_list(F.struct("x", "comp", char.alias("c")))).alias("row"))
        chars = F.transform("row", lambda r: r["c"])
        return lines.select("text_id", F.array_join(F.transform(chars, lambda c: c["ch"]), "").alias("text"), chars.alias("chars"))

    def recognize(self, images: DataFrame, mode: str | None = None, allowed: str | None = None) -> DataFrame:
        """(text_id, text, resolved, matched_term) of each image with any ink."""
        mode = mode or ("prefer" if self.lexicon is not None else "none")
        if mode not in MODES or (mode != "none" and self.lexicon is None):
            raise ValueError(f"mode must be one of {MODES}, and all but none need a lexicon")
        own = self.read(images, allowed)
        if mode == "none":
            return own.select("text_id", "text", F.col("text").alias("resolved"), F.lit(None).cast("string").alias("matched_term"))
        if mode == "dict":
            found = resolve.assoc_match(own, self.lexicon).select("text_id", "term")
            return own.join(found, "text_id", "left").select("text_id", "text", F.when(F.col("term").isNotNull(), F.col("text")).otherwise("").alias("resolved"), F.col("term").alias("matched_term"))
        out = resolve.dispatch(own, self.lexicon, [mode])
        return own.select("text_id", "text").join(out.drop("mode"), "text_id")


def prototypes_of(images: DataFrame, names: DataFrame, threshold: float = 128) -> DataFrame:
    """Prototypes from images of single characters; ``names``: image_id, char_id. Of several components the first counts."""
    glyphs = glyph_bits(vision.glyphs_of_images(images, threshold).where("comp = 0")).join(names, "image_id")
    order = Window.partitionBy("char_id").orderBy("image_id")
    return glyphs.select("char_id", (F.row_number().over(order) - 1).alias("proto_id"), "bits")
