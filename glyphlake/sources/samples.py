"""Labelled samples: archives, changes of size and place, boxes of a line's characters, bands of a screenshot, folded normalisation."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..operators.vision import fitted, resample

SAMPLE = "label string, char_id int, font_sha256 string, input_mode string, glyph binary"


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Rows of one or many archives with the arrays ``x`` (glyphs), ``y`` (classes), ``chars``, and maybe ``font_sha256`` and ``input_mode``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["content"]:
                with np.load(io.BytesIO(bytes(raw)), allow_pickle=False) as data:
                    one = lambda k, none, data=data: str(np.ravel(data[k])[0]) if k in data.files else none
                    y = data["y"].astype(np.int32)
                    yield pd.DataFrame({"label": data["chars"].astype(str)[y], "char_id": y, "font_sha256": one("font_sha256", None), "input_mode": one("input_mode", "binary"), "glyph": [g.tobytes() for g in data["x"].astype(np.uint8)]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SAMPLE)


def scaled(mask: np.ndarray, factor: float) -> np.ndarray:
    """A mask by nearest neighbour."""
    return resample(mask, fitted(mask.shape[0], factor), fitted(mask.shape[1], factor))


def scaled_soft(glyph: np.ndarray, factor: float) -> np.ndarray:
    """A soft glyph by triangles of weight over pixel centres, widened when it shrinks."""

    def weights(old: int, new: int) -> np.ndarray:
        step = old / new
        centre = (np.arange(new) + 0.5) * step - 0.5
        w = np.maximum(0, 1 - np.abs(centre[:, None] - np.arange(old)) / max(step, 1.0))
        return w / w.sum(1, keepdims=True)

    h, w = glyph.shape
    return np.clip(np.rint(weights(h, fitted(h, factor)) @ glyph @ weights(w, fitted(w, factor)).T), 0, 255).astype(np.uint8)


def shifted(glyph: np.ndarray, dx: int, dy: int) -> np.ndarray:
    """Moved within its frame; what leaves is lost, what enters is blank."""
    h, w = glyph.shape
    pad = max(abs(dx), abs(dy))
    return np.pad(glyph, pad)[pad - dy : pad - dy + h, pad - dx : pad - dx + w]


def character_boxes(mask: np.ndarray, k: int, starts: list[int] | None = None) -> list[tuple[int, int]]:
    """k spans of columns: cut in the middle of the widest blank runs, of equal ones the leftmost, or else where ``starts`` says that its k components begin."""
    blank = np.flatnonzero(np.diff(np.concatenate(([0], (~mask.any(0)).astype(np.int8), [0]))))
    runs = list(zip(blank[::2].tolist(), blank[1::2].tolist(), strict=True))
    if len(runs) >= k - 1:
        cuts = sorted((a + b) // 2 for a, b in sorted(runs, key=lambda r: (r[0] - r[1], r[0]))[: k - 1])
    elif starts is not None and len(starts) == k:
        cuts = sorted(starts)[1:]
    else:
        raise ValueError(f"{len(runs)} blank runs are too few for {k} characters")
    ends = [0, *cuts, mask.shape[1]]
    return list(zip(ends, ends[1:], strict=False))


def inked_crop(screen: np.ndarray, box: tuple[int, int, int, int], threshold: float, margin: int) -> np.ndarray:
    """The part of an RGB screen about the bright ink of a box (x0, y0, x1, y1), with a margin."""
    x0, y0, x1, y1 = box
    ink = screen[y0:y1, x0:x1].mean(2) > threshold
    if not ink.any():
        raise ValueError("the box has no ink")
    rows, columns = np.flatnonzero(ink.any(1)), np.flatnonzero(ink.any(0))
    low = lambda at, first: max(0, at + int(first) - margin)
    return screen[low(y0, rows[0]) : y0 + int(rows[-1]) + 1 + margin, low(x0, columns[0]) : x0 + int(columns[-1]) + 1 + margin]


def folded(weight: np.ndarray, gamma: np.ndarray, beta: np.ndarray, mean: np.ndarray, variance: np.ndarray, eps: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """A convolution and the normalisation after it as one convolution: (weight, bias)."""
    scale = gamma / np.sqrt(variance + eps)
    return weight * scale.reshape(-1, *[1] * (weight.ndim - 1)), beta - mean * scale
