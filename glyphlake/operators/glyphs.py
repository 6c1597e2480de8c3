"""From masks to characters: components with their own ink, fragments put together, wide ones cut, soft resizing, and a script's measures."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import asdict, dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sheets
from .segmentation import Bounds
from .vision import Ink, Script, find_lines, normalize_glyph

Part = tuple[int, int, np.ndarray]


def tight(x: int, y: int, mask: np.ndarray) -> Part:
    """A mask cut to its ink, with its place."""
    rows, columns = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    return x + int(columns[0]), y + int(rows[0]), mask[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1]


def component_parts(mask: np.ndarray) -> list[Part]:
    """4-connected components with their own ink, by x and y.

    Labels spread along rows and columns at once: each pixel takes the least label of its run, in turn by row and by column, until nothing changes.
    """
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    breaks = {axis: np.cumsum(np.diff(mask.astype(np.int8), axis=axis, prepend=0) != 0, axis=axis) for axis in (0, 1)}
    groups = {}
    for axis in (0, 1):
        line = np.arange(mask.shape[1 - axis])
        lines = line[None, :] if axis == 0 else line[:, None]
        groups[axis] = (lines * (mask.shape[axis] + 2) + breaks[axis])[mask]
    own = label[mask]
    while True:
        before = own
        for axis in (1, 0):
            least = np.full(int(groups[axis].max(initial=0)) + 1, mask.size + 1)
            np.minimum.at(least, groups[axis], own)
            own = least[groups[axis]]
        if np.array_equal(before, own):
            break
    label[mask] = own
    parts = [tight(0, 0, label == k) for k in np.unique(own)]
    return sorted(parts, key=lambda p: (p[0], p[1]))


def united(parts: list[Part]) -> Part:
    """One mask of several."""
    x, y = min(p[0] for p in parts), min(p[1] for p in parts)
    out = np.zeros((max(p[1] + p[2].shape[0] for p in parts) - y, max(p[0] + p[2].shape[1] for p in parts) - x), bool)
    for px, py, m in parts:
        out[py - y : py - y + m.shape[0], px - x : px - x + m.shape[1]] |= m
    return x, y, out


def merge_fragments(parts: list[Part], bounds: Bounds = Bounds(), stroke: int = 1) -> list[Part]:
    """Components of one glyph together: side by side with a gap of a stroke, or above one another with a small one, and so on from one to the next."""
    if not parts:
        return []
    x0, y0 = (np.array([p[i] for p in parts]) for i in (0, 1))
    x1, y1 = x0 + [p[2].shape[1] for p in parts], y0 + [p[2].shape[0] for p in parts]
    over = lambda a, b: np.minimum.outer(b, b) - np.maximum.outer(a, a)
    wide, high = over(x0, x1), over(y0, y1)
    near = ((-wide <= max(1, stroke)) & (high >= 1)) | ((-high <= max(3, bounds.height_least // 2)) & (wide >= 1))
    reach = near | np.eye(len(parts), dtype=bool)
    while not np.array_equal(reach, further := (reach.astype(np.int32) @ reach) > 0):
        reach = further
    groups = {int(np.flatnonzero(row)[0]): np.flatnonzero(row) for row in reach}
    return sorted((united([parts[i] for i in g]) for g in groups.values()), key=lambda p: (p[0], p[1]))


def split_wide(parts: list[Part], bounds: Bounds = Bounds(), stroke: int = 1) -> list[Part]:
    """Characters wider than any can be, cut at columns without ink; the pieces stay as wide as a character is high."""
    least = max(bounds.width_least, bounds.height_least)
    out = []
    for x, y, mask in parts:
        w, cuts = mask.shape[1], []
        if w > max(bounds.width_most, bounds.width_least + 2):
            inked = np.concatenate(([0], np.cumsum(mask.any(0))))
            places = np.arange(least, max(least, w - least))
            blank = places[inked[np.minimum(places + stroke + 1, w)] == inked[np.maximum(places - stroke, 0)]]
            for at in blank.tolist():
                if not cuts or at - cuts[-1] >= least:
                    cuts.append(at)
        ends = [0, *cuts, w]
        out += [tight(x + a, y, mask[:, a:b]) if cuts else (x, y, mask) for a, b in zip(ends, ends[1:], strict=False) if mask[:, a:b].any()]
    return out


def characters_of(mask: np.ndarray, bounds: Bounds = Bounds(), stroke: int = 1) -> list[tuple[int, Part]]:
    """(line, character) of a whole mask, from left to right within a line."""
    out = []
    for k, (a, b) in enumerate(find_lines(mask, bounds.height_least)):
        parts = split_wide(merge_fragments(component_parts(mask[a : b + 1]), bounds, stroke), bounds, stroke)
        out += [(k, (x, y + a, m)) for x, y, m in sorted(parts, key=lambda p: (p[0], p[1]))]
    return out


GLYPHS = "image_id long, line int, idx int, x int, y int, w int, h int, glyph binary"
GLYPHS_ARROW = pa.schema([("image_id", pa.int64()), *((c, pa.int32()) for c in ("line", "idx", "x", "y", "w", "h")), ("glyph", pa.binary())])


def fragments_together(found: sheets.Components, bounds: Bounds, stroke: int = 1) -> None:
    """``merge_fragments`` in each group of components."""
    count = np.bincount(found.group)[found.group] if len(found.group) else found.group
    i, j = np.repeat(np.arange(len(count)), count), np.repeat(np.searchsorted(found.group, found.group), count) + sheets.ranges(count)
    over = lambda a, size: np.minimum(a[i] + size[i], a[j] + size[j]) - np.maximum(a[i], a[j])
    wide, high = over(found.x, found.w), over(found.y, found.h)
    near = ((-wide <= max(1, stroke)) & (high >= 1)) | ((-high <= max(3, bounds.height_least // 2)) & (wide >= 1))
    found.united(sheets.joined(len(count), i[near], j[near]))


def character_glyphs(images: DataFrame, ink: Ink = Ink(), bounds: Bounds = Bounds(), soft: bool = False) -> DataFrame:
    """(image_id, line, idx, x, y, w, h, glyph): every character of an image, normalised from its mask or from its strengths.

    A batch of images is taken at once; those with a character to be cut are taken one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sheets.slices(batches):
            sheet = sheets.Sheet(batch)
            mask, strength = ink.hard(sheet.pixels), ink.soft(sheet.pixels) if soft else None
            rows, _, line, _ = sheets.text_lines(sheet, mask, bounds.height_least)
            found = sheet.components(mask, rows)
            found.ordered("group", "x", "y")
            fragments_together(found, bounds)
            found.ordered("group", "x", "y", "label")
            wide = np.unique(found.image[found.w > max(bounds.width_most, bounds.width_least + 2)])
            own, part = np.flatnonzero(~np.isin(found.image, wide)), found.painted()
            value = (lambda _, at, strength=strength: strength[at]) if soft else (lambda k, at, part=part, own=own: (part[at] == own[k]) * np.uint8(255))
            x, y, w, h, image = (v[own] for v in (found.x, found.y, found.w, found.h, found.image))
            idx = np.arange(len(own)) - np.searchsorted(image, image)
            yield sheets.record(GLYPHS_ARROW, sheet.ids.take(pa.array(image)), line[found.group[own]], idx, x, y, w, h, sheets.binaries(sheets.normalised(sheet, image, x, y, w, h, value)))
            for one in wide.tolist():
                at, shape = slice(sheet.start[one], sheet.start[one] + sheet.width[one] * sheet.height[one]), (sheet.height[one], sheet.width[one])
                chars = characters_of(mask[at].reshape(shape), bounds)
                pick = lambda x, y, m, at=at, shape=shape: strength[at].reshape(shape)[y : y + m.shape[0], x : x + m.shape[1]] if soft else m
                every = [(sheet.ids[one].as_py(), k, i, x, y, m.shape[1], m.shape[0], normalize_glyph(pick(x, y, m)).tobytes()) for i, (k, (x, y, m)) in enumerate(chars)]
                yield sheets.record(GLYPHS_ARROW, *zip(*every, strict=True))

    return images.select("image_id", "width", "height", "pixels").mapInArrow(run, GLYPHS)


def resize_smooth(patch: np.ndarray, size: int = 24) -> np.ndarray:
    """Bilinear, corners on corners: two small matrices of weights, one for each axis."""
    if patch.shape == (size, size):
        return patch.astype(np.float32)

    def weights(old: int) -> np.ndarray:
        at = np.linspace(0, old - 1, size)
        return np.maximum(0, 1 - np.abs(at[:, None] - np.arange(old)))

    return (weights(patch.shape[0]) @ patch.astype(np.float64) @ weights(patch.shape[1]).T).astype(np.float32)


@dataclass(frozen=True)
class NormalSpec:
    """How a font's glyphs stand in the frame; ratios are over the em."""

    baseline_row: float = 18.0
    scale_units: float = 0.0192
    cjk_height_ratio: float = 0.933
    cjk_width_ratio: float = 0.933
    cjk_baseline_offset_ratio: float = 0.087
    latin_tall_ratio: float = 0.768
    render_size: float | None = None

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, data: Mapping | None) -> NormalSpec | None:
        """Unknown keys are left out; nothing gives none."""
        return cls(**{f.name: data[f.name] for f in fields(cls) if f.name in data}) if data else None

    def script(self) -> Script:
        return Script(self.cjk_height_ratio, self.cjk_width_ratio, self.cjk_baseline_offset_ratio)


def spec_of_outlines(outlines: DataFrame, target: int = 24, render_size: int | None = None, em: float = 1000.0) -> NormalSpec:
    """Medians over a font's outlines (x0, y0, x1, y1, in units with the baseline at 0): square ones give the full-width ratios, tall narrow ones the Latin ratio."""
    own = outlines.select((F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"), "y0").where("w > 0 and h > 0")
    square = (F.col("w") / F.col("h")).between(0.85, 1.15) & (F.col("h") / em >= 0.8)
    tall = (F.col("w") / F.col("h") < 0.8) & (F.col("h") / em).between(0.6, 0.9)
    of = lambda where, value: F.median(F.when(where, value / em))
    found = own.agg(of(square, F.col("h")).alias("cjk_height_ratio"), of(square, F.col("w")).alias("cjk_width_ratio"), of(square, -F.col("y0")).alias("cjk_baseline_offset_ratio"), of(tall & ~square, F.col("h")).alias("latin_tall_ratio")).first()
    return NormalSpec(baseline_row=0.75 * target, scale_units=0.8 * target / 1000, render_size=float(render_size) if render_size else None, **{k: v for k, v in found.asDict().items() if v is not None})
