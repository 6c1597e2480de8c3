"""Frames of a screen: regions of interest, signatures, evidence of the last frames, and the text to show."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tracker import fuse_histories, stable_votes

#: Weights of the lightness, in thousandths, so that sums of whole levels are exact.
LUMA = (299, 587, 114)


@dataclass(frozen=True)
class Settings:
    """Widths of the histories, shares, the grid of a signature."""

    window: int = 8
    min_frames: int = 3
    vote_ratio: float = 0.6
    fusion_min_frames: int = 2
    cache_size: int = 32
    fusion: bool = True
    voting: bool = True
    bright_text: bool = True
    threshold: int = 128
    quantum: int = 2
    grid_width: int = 24
    grid_height: int = 8
    align: float = 8.0
    alternatives: int = 8

    def __post_init__(self):
        if min(self.window, self.min_frames, self.fusion_min_frames, self.cache_size, self.grid_width, self.grid_height) < 1 or not 0 < self.vote_ratio <= 1:
            raise ValueError("counts are at least 1, the ratio is in (0, 1]")


def ink_boxes(pixels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(frame_id, x, y, w, h): the box of a frame's ink with a margin of a quarter of it, 1 to 4 pixels, within the frame; all 0 without ink.

    ``pixels``: frame_id, x, y, r, g, b. Ends are minima and maxima that each task finds for itself first.
    """
    light, least = sum(F.col(c) * w for c, w in zip("rgb", LUMA, strict=True)), sum(LUMA) * settings.threshold
    ink = light >= least if settings.bright_text else light <= least
    ends = lambda f, c: f(F.when(ink, F.col(c)))
    box = pixels.groupBy("frame_id").agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"), *(ends(f, c).alias(f"_{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))))
    span = lambda c: F.floor((F.col(f"_{c}1") - F.col(f"_{c}0") + 1) / 4)
    pad = F.greatest(F.lit(1), F.least(F.lit(4), span("x"), span("y")))
    low = lambda c: F.greatest(F.lit(0), F.col(f"_{c}0") - pad)
    size = lambda c, most: F.least(F.col(most), F.col(f"_{c}1") + 1 + pad) - low(c)
    found = {"x": low("x"), "y": low("y"), "w": size("x", "_w"), "h": size("y", "_h")}
    return box.select("frame_id", *(F.when(F.col("_x0").isNull(), 0).otherwise(v).cast("long").alias(c) for c, v in found.items()))


def given_box(box: Sequence[int], width: int, height: int) -> tuple[int, int, int, int]:
    """A box that the caller names, if it lies within the frame."""
    x, y, w, h = map(int, box)
    if min(x, y, w, h) < 0 or x + w > width or y + h > height:
        raise ValueError("the box lies outside the frame")
    return x, y, w, h


def quantize(box: DataFrame, quantum: int = 2) -> DataFrame:
    """Boxes on a coarse grid, so that a box that shakes by a pixel stays in one history."""
    q = max(1, quantum)
    return box.select("frame_id", *(F.floor(F.col(c) / q).cast("long").alias(c) for c in ("x", "y", "w", "h")))


def cells_of(at: Column, size: Column, count: int) -> Column:
    """The cells of a grid of ``count`` over ``size`` pixels that hold the pixel. Ends are rounded outwards, so a pixel may lie in several."""
    first = lambda k: F.floor(k * size / count)
    every = F.sequence(F.lit(0), F.lit(count - 1))
    return F.filter(every, lambda k: (at >= F.least(first(k), size - 1)) & (at < F.greatest(F.ceil((k + 1) * size / count), first(k) + 1)))


def signatures(pixels: DataFrame, boxes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(frame_id, signature): SHA-256 of the mean colours of a grid over the box; ``empty`` for a box without area."""
    own = pixels.join(boxes.select("frame_id", *(F.col(c).alias(f"_{c}") for c in "xywh")), "frame_id")
    inside = own.where(F.col("x").between(F.col("_x"), F.col("_x") + F.col("_w") - 1) & F.col("y").between(F.col("_y"), F.col("_y") + F.col("_h") - 1))
    placed = inside.withColumn("_row", F.explode(cells_of(F.col("y") - F.col("_y"), F.col("_h"), settings.grid_height)))
    placed = placed.withColumn("_column", F.explode(cells_of(F.col("x") - F.col("_x"), F.col("_w"), settings.grid_width)))
    mean = placed.groupBy("frame_id", "_row", "_column").agg(*(F.floor(F.avg(c)).cast("int").alias(c) for c in "rgb"))
    cell = F.concat(*(F.lpad(F.hex(c), 2, "0") for c in "rgb"))
    each = mean.groupBy("frame_id").agg(F.sort_array(F.collect_list(F.struct("_row", "_column", cell.alias("cell")))).alias("cells"))
    digest = F.sha2(F.unhex(F.array_join(F.transform("cells", lambda c: c["cell"]), "")), 256)
    return boxes.select("frame_id").join(each.select("frame_id", digest.alias("signature")), "frame_id", "left").withColumn("signature", F.coalesce("signature", F.lit("empty")))


def call_key(options: Column) -> Column:
    """One key for a map of options, whatever their order."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(options)))), 256)


def evidence(chars: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Add ``logits`` to each character of a result: its alternatives with their scores, or itself with its confidence.

    ``chars``: frame_id, position, char, confidence, ...; ``alternatives``: frame_id, position, char, logit.
    """
    each = alternatives.groupBy("frame_id", "position").agg(F.map_from_entries(F.collect_list(F.struct("char", F.col("logit").cast("double")))).alias("logits"))
    return chars.join(each, ["frame_id", "position"], "left").withColumn("logits", F.coalesce("logits", F.create_map("char", F.col("confidence").cast("double"))))


FUSED = "fused string, fused_confidence double"
#: Rows that the kernel fuses at a time.
AT_ONCE = 2000


def fuse_window(frames: DataFrame, window: int, align: float) -> DataFrame:
    """Replace ``positions`` by the fused text of each row and the ``window`` - 1 before it in its stream.

    Rows come in the order of their streams, ``_n`` is a row's number there. A task keeps the last rows of a batch for the next one.
    """
    kept = [c for c in frames.columns if c != "positions"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema if f.name in kept] + [FUSED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                positions, seen = batch.column("positions"), np.minimum(batch.column("_n").to_numpy(), window)
                first = len(before) if before is not None else 0
                held = pa.concat_arrays([before, positions]) if first else pa.concat_arrays([positions])
                texts, sure = fuse_histories(held, np.concatenate((np.zeros(first, seen.dtype), seen)), first, align)
                before = held[max(0, len(held) - window + 1) :] if window > 1 else None
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), texts, sure], names=[*kept, "fused", "fused_confidence"])

    return frames.mapInArrow(run, schema)


def shown_texts(frames: DataFrame, key: str, order: list[str], settings: Settings = Settings()) -> DataFrame:
    """Add ``stable``, ``fused``, ``shown`` and its ``source``: the voted text, else the fused one where it differs from the frame's own, else that one.

    ``frames``: key, order, text, positions (array of x, w, char, confidence, logits). ``alternatives`` are the last different texts, latest first.
    A row's history is a frame of ``window`` rows, so a stream of any length never gathers in one place. Positions are sent to the kernel once, in the
    order of their streams, which the windows before it have already made.
    """
    stream = Window.partitionBy(key).orderBy(*order)
    w = stream.rowsBetween(1 - settings.window, 0)
    own = stable_votes(frames, key, order, "text", settings.window, settings.min_frames, settings.vote_ratio) if settings.voting else frames.withColumn("stable", F.lit(None).cast("string"))
    own = own.withColumn("_last", F.collect_list("text").over(w)).withColumn("_n", F.row_number().over(stream))
    own = fuse_window(own.sortWithinPartitions(key, *order), settings.window, settings.align)
    fused = F.col("fused").isNotNull() & (F.least("_n", F.lit(settings.window)) >= settings.fusion_min_frames) & (F.col("fused") != F.col("text")) & F.lit(settings.fusion)
    recent = F.array_distinct(F.filter(F.reverse("_last"), lambda t: t != ""))
    source = F.when(F.col("stable").isNotNull(), "stable").when(fused, "fused").otherwise("latest")
    out = own.withColumns({"source": source, "shown": F.when(F.col("stable").isNotNull(), F.col("stable")).when(fused, F.col("fused")).otherwise(F.col("text")), "alternatives": F.when(fused & F.col("stable").isNull(), F.slice(recent, 1, settings.alternatives))})
    return out.drop("_last", "_n")


def annotate(shown: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Add ``term``, the best match of each shown text; a text without one stays as it is. Equal texts are matched once."""
    from ..operators.lexicon import best_match, match_all

    texts = shown.select(F.col("shown").alias("text")).distinct().where("text <> ''").withColumn("text_id", F.xxhash64("text"))
    best = best_match(match_all(texts, lexicon)).select(F.col("text").alias("shown"), "term")
    return shown.join(best, "shown", "left")


def lexicon_of_call(args: Sequence, options: Mapping, is_reference: Callable[[object], bool]) -> tuple[object, str | None]:
    """The lexicon a call names and its mode: by name, else as the first or second argument with the mode after it; ``prefer`` without one."""
    lexicon, mode = options.get("lexicon"), options.get("lexicon_mode")
    if lexicon is None:
        at = next((i for i, a in enumerate(args[:2]) if is_reference(a)), None)
        if at is not None:
            lexicon = args[at]
            mode = args[at + 1] if len(args) > at + 1 else mode
    return lexicon, mode or ("prefer" if lexicon is not None else None)
