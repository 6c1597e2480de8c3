"""Image kernels: foreground, components, glyph normalisation and the small network, on Arrow batches of images."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

TARGET = 24
LUMA = (0.299, 0.587, 0.114)


@dataclass(frozen=True)
class Ink:
    """What counts as text: a range of lightness at little saturation, closeness to a colour, or a range of luma.

    All three are one measure: a level that grows with lightness, or with closeness, up to ``full``, and how much colour spoils it.
    """

    threshold: float = 128
    bright: bool = True
    saturation: float | None = None
    color: tuple[int, int, int] | None = None
    tolerance: int = 40

    def measure(self, image: np.ndarray) -> tuple[np.ndarray, float, np.ndarray | float]:
        """(level, its largest value, share of the allowed saturation)."""
        if self.saturation is not None:
            ends = np.stack([image.max(-1), image.min(-1)]).astype(np.float32) / 255
            both, chroma = ends.sum(0), ends[0] - ends[1]
            return both / 2, 1.0, chroma / np.maximum(1 - np.abs(both - 1), 1e-6) / max(self.saturation, 1e-6)
        if self.color is not None:
            return 255 - np.abs(np.subtract(image, self.color, dtype=np.int16)).max(-1), 255.0, 0.0
        return image @ np.array(LUMA, np.float32), 255.0, 0.0

    def hard(self, image: np.ndarray) -> np.ndarray:
        level, _, spoilt = self.measure(image)
        if self.color is not None:
            return level >= 255 - self.tolerance
        return (level >= self.threshold if self.bright else level <= self.threshold) & (np.asarray(spoilt) <= 1)

    def soft(self, image: np.ndarray) -> np.ndarray:
        """Strength 0..255, truncated."""
        level, full, spoilt = self.measure(image)
        shown = level if self.bright or self.color is not None else full - level
        return (np.clip(shown * np.clip(1 - np.asarray(spoilt), 0, 1), 0, full) * (255 / full)).astype(np.uint8)


def foreground(image: np.ndarray, threshold: float = 128, bright: bool = True, hsl: tuple[float, float] | None = None, color: tuple[int, int, int] | None = None, tolerance: int = 40) -> np.ndarray:
    """Hard ink mask."""
    return Ink(hsl[0] if hsl else threshold, bright, hsl[1] if hsl else None, color, tolerance).hard(image)


def soft_foreground(image: np.ndarray, bright: bool = True, hsl: tuple[float, float] | None = None, color: tuple[int, int, int] | None = None) -> np.ndarray:
    return Ink(hsl[0] if hsl else 128, bright, hsl[1] if hsl else None, color).soft(image)


def find_lines(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Row spans (inclusive) of text lines: blank gaps over a third of the least height part them; a span reaches to the row before the next."""
    rows = np.flatnonzero(mask.any(1))
    if not len(rows):
        return []
    breaks = np.flatnonzero(np.diff(rows) > max(1, least // 3)) + 1
    starts = rows[np.concatenate(([0], breaks))]
    ends = np.concatenate((starts[1:] - 1, [mask.shape[0] - 1]))
    out = []
    for a, b in zip(starts, ends, strict=True):
        ink = np.flatnonzero(mask[a : b + 1].any(1))
        if b - a >= least and ink[-1] - ink[0] + 1 >= max(2, least // 2):
            out.append((int(a), int(b)))
    return out


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x, y, w, h, ink) of 4-connected components, in order of x and y: runs of ink, joined where they touch in the next row."""
    root: list[int] = []
    boxes: list[list[int]] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    before: list[tuple[int, int, int]] = []
    for y, row in enumerate(mask):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], row.astype(np.int8), [0]))))
        now = []
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            k = len(root)
            root.append(k)
            boxes.append([int(a), y, int(b), y + 1, int(b - a)])
            now.append((int(a), int(b), k))
            for c, d, other in before:
                if c < b and a < d:
                    root[max(find(k), find(other))] = min(find(k), find(other))
        before = now
    merged: dict[int, list[int]] = {}
    for k, box in enumerate(boxes):
        m = merged.setdefault(find(k), [*box[:4], 0])
        m[0], m[1], m[2], m[3], m[4] = min(m[0], box[0]), min(m[1], box[1]), max(m[2], box[2]), max(m[3], box[3]), m[4] + box[4]
    return sorted((x0, y0, x1 - x0, y1 - y0, ink) for x0, y0, x1, y1, ink in merged.values())


def sources(target: int, old: int, new: int, first: int) -> np.ndarray:
    """For each place of one axis of the target, the source's index that stands there; ``old``, one past the end, where there is none."""
    at = np.arange(target) - first
    return np.where((at >= 0) & (at < new), at * old // new, old)


def fitted(size: int, scale: float) -> int:
    return max(1, round(size * scale))


def resample(glyph: np.ndarray, height: int, width: int) -> np.ndarray:
    """Nearest neighbour."""
    return glyph[np.ix_(sources(height, glyph.shape[0], height, 0), sources(width, glyph.shape[1], width, 0))]


def normalize_glyph(glyph: np.ndarray, target: int = TARGET, baseline: float | None = None, scale: float | None = None, row: float = 18.0) -> np.ndarray:
    """Ink fitted into the target with its aspect kept, centred or put on a baseline; a mask gives 0 or 255, a soft glyph keeps its strengths.

    Each axis of the target is mapped to the source once, and the glyph, with a blank row and column behind it, is looked up through both maps.
    """
    high, wide = glyph.shape
    if not high or not wide:
        return np.zeros((target, target), np.uint8)
    room = target * (0.8 if scale is None else 1.0) / max(high, wide)
    scale = room if scale is None else min(scale, room)
    size = fitted(high, scale), fitted(wide, scale)
    top, left = ((target - n) // 2 for n in size)
    if baseline is not None:
        top = int(np.clip(round(row - baseline * scale), 0, target - size[0]))
    ink = glyph.astype(np.uint8) * 255 if glyph.dtype == bool else glyph
    return np.pad(ink, ((0, 1), (0, 1)))[np.ix_(sources(target, high, size[0], top), sources(target, wide, size[1], left))]


@dataclass(frozen=True)
class Script:
    """Heights, widths and baseline of a font's full-width characters, over the em."""

    height: float = 1.0
    width: float = 1.0
    baseline: float = 0.0


def glyph_frame(w: int, h: int, script: Script, target: int = TARGET) -> tuple[float, float]:
    """(distance of the baseline from the box's top, scale). Only a square and wide box hangs below the baseline."""
    em = max(h / script.height, w / script.width, 1.0)
    hangs = 4 * w >= 3 * h and w >= 0.83 * em
    return h - (script.baseline * em if hangs else 0.0), target * 0.8 / max(w, h, 1)


def conv3x3(x: np.ndarray, w: np.ndarray, b: np.ndarray, stride: int = 1, depthwise: bool = False) -> np.ndarray:
    """Same-padded 3x3 convolution of [N, C, H, W]; w is [O, C, 3, 3], or [C, 3, 3] depthwise."""
    padded = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
    tiles = np.lib.stride_tricks.sliding_window_view(padded, (3, 3), axis=(2, 3))[:, :, ::stride, ::stride]
    out = np.einsum("nchwij,cij->nchw", tiles, w, optimize=True) if depthwise else np.einsum("nchwij,ocij->nohw", tiles, w, optimize=True)
    return out + b[None, :, None, None]


def pointwise(x: np.ndarray, w: np.ndarray, b: np.ndarray, stride: int = 1) -> np.ndarray:
    return np.einsum("nchw,oc->nohw", x[:, :, ::stride, ::stride], w, optimize=True) + b[None, :, None, None]


def forward(x: np.ndarray, weights: dict[str, np.ndarray]) -> np.ndarray:
    """Logits of [N, 24, 24] glyphs: convolution, two depthwise-separable blocks, average pool, linear."""
    y = np.maximum(conv3x3(x[:, None].astype(np.float32) / 255, weights["conv1_w"], weights["conv1_b"], 2), 0)
    for k in ("1", "2"):
        y = np.maximum(conv3x3(y, weights[f"dw{k}_w"], weights[f"dw{k}_b"], depthwise=True), 0)
        y = np.maximum(pointwise(y, weights[f"pw{k}_w"], weights[f"pw{k}_b"], 2), 0)
    return y.mean((2, 3)) @ weights["fc_w"].T + weights["fc_b"]


GLYPHS = "image_id long, comp int, x int, y int, w int, h int, ink int, glyph binary"
GLYPHS_ARROW = pa.schema([("image_id", pa.int64()), *((c, pa.int32()) for c in ("comp", "x", "y", "w", "h", "ink")), ("glyph", pa.binary())])


def glyphs_of_images(images: DataFrame, threshold: float = 128) -> DataFrame:
    """(image_id, comp, x, y, w, h, ink, glyph) of raw RGB images (image_id, width, height, pixels)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import sheets

        for batch in sheets.slices(batches):
            sheet = sheets.Sheet(batch)
            mask = foreground(sheet.pixels, threshold)
            found = sheet.components(mask)
            found.ordered("image", "x", "y", "w", "h", "ink")
            ink = mask.astype(np.uint8) * 255
            glyph = sheets.normalised(sheet, found.image, found.x, found.y, found.w, found.h, lambda _, at, ink=ink: ink[at])
            yield sheets.record(GLYPHS_ARROW, sheet.ids.take(pa.array(found.image)), found.rank(), found.x, found.y, found.w, found.h, found.ink, sheets.binaries(glyph))

    return images.select("image_id", "width", "height", "pixels").mapInArrow(run, GLYPHS)


def soft_glyphs_of_images(images: DataFrame, ink: Ink = Ink(), script: Script | None = None, target: int = TARGET) -> DataFrame:
    """(image_id, comp, x, y, w, h, glyph): components of the hard mask with the strengths of the soft one, on a baseline if a script is given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                image = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 3)
                soft = ink.soft(image)
                for k, (x, y, w, h, _) in enumerate(components(ink.hard(image))):
                    baseline, scale = glyph_frame(w, h, script, target) if script else (None, None)
                    rows.append((r.image_id, k, x, y, w, h, normalize_glyph(soft[y : y + h, x : x + w], target, baseline, scale).tobytes()))
            yield pd.DataFrame(rows, columns=["image_id", "comp", "x", "y", "w", "h", "glyph"])

    return images.mapInPandas(run, "image_id long, comp int, x int, y int, w int, h int, glyph binary")


LINES = "line_id long, component int, x int, y int, w int, h int, mask binary"
LINES_ARROW = pa.schema([("line_id", pa.int64()), *((c, pa.int32()) for c in ("component", "x", "y", "w", "h")), ("mask", pa.binary())])


def masks_of_lines(images: DataFrame, ink: Ink = Ink()) -> DataFrame:
    """(line_id, component, x, y, w, h, mask): all ink of an image as one component, for ``merges.expand_atoms``; images without ink are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import sheets

        for batch in sheets.slices(batches):
            sheet = sheets.Sheet(batch)
            mask = ink.hard(sheet.pixels)
            image, x, y, w, h = sheet.boxes(mask)
            own = np.repeat(sheet.start[image] + y * sheet.width[image] + x, w * h) + sheets.ranges(w * h) // np.repeat(w, w * h) * np.repeat(sheet.width[image], w * h) + sheets.ranges(w * h) % np.repeat(w, w * h)
            yield sheets.record(LINES_ARROW, sheet.ids.take(pa.array(image)), np.zeros(len(image), np.int32), x, y, w, h, sheets.cut_out(mask.astype(np.uint8), own, w * h))

    return images.select("image_id", "width", "height", "pixels").mapInArrow(run, LINES)


SUMS_ARROW = pa.schema([("image_id", pa.int64()), ("ink", pa.int64()), ("soft_sum", pa.int64())])


def masks_of_images(images: DataFrame, threshold: float = 128) -> DataFrame:
    """(image_id, ink, soft_sum) of each image's hard and soft foreground."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import sheets

        for batch in sheets.slices(batches):
            sheet = sheets.Sheet(batch)
            yield sheets.record(SUMS_ARROW, sheet.ids, sheet.sums(foreground(sheet.pixels, threshold)), sheet.sums(soft_foreground(sheet.pixels)))

    return images.select("image_id", "width", "height", "pixels").mapInArrow(run, "image_id long, ink long, soft_sum long")
