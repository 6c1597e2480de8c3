"""Many images at once: the pixels of a batch as one row, with runs, components and normalised glyphs as arrays over all of them.

The kernels for single masks in ``vision``, ``glyphs`` and ``merges`` define the results; here they are found for a whole batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

from .vision import TARGET, find_lines, fitted, sources

#: Pixels that a kernel takes at a time.
PIXELS = 1_000_000


def slices(batches: Iterator[pa.RecordBatch], most: int = PIXELS) -> Iterator[pa.RecordBatch]:
    """Parts of batches of (image_id, width, height, pixels) with about ``most`` pixels; a larger image is a part of its own."""
    for batch in batches:
        ends = np.cumsum(batch.column("width").to_numpy().astype(np.int64) * batch.column("height").to_numpy())
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")) - at)
            yield batch.slice(at, n)
            at += n


def ranges(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of 0 .. n - 1 that each one reaches by the links a - b."""
    label = np.arange(n)
    while True:
        u, v = label[a], label[b]
        apart = u != v
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(u, v)[apart], np.minimum(u, v)[apart])
        while not np.array_equal(label, further := label[label]):
            label = further


class Sheet:
    """Images of a batch, row by row: ``pixels`` [n, 3], the first pixel of each row, its image and its place there."""

    def __init__(self, batch: pa.RecordBatch):
        column = batch.column("pixels")
        if column.null_count:
            raise ValueError("an image without pixels")
        raw = b"".join(column.to_pylist())
        self.ids = batch.column("image_id")
        self.width, self.height = (batch.column(c).to_numpy().astype(np.int64) for c in ("width", "height"))
        self.pixels = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        self.row_image, self.row_y = np.repeat(np.arange(len(self.width)), self.height), ranges(self.height)
        self.row_width = self.width[self.row_image]
        self.row_start = np.cumsum(self.row_width) - self.row_width
        self.start = np.cumsum(self.width * self.height) - self.width * self.height
        if len(self.pixels) != int((self.width * self.height).sum()):
            raise ValueError("pixels do not fill the images")

    def rows_with(self, mask: np.ndarray) -> np.ndarray:
        """Whether each row has ink."""
        before = np.concatenate(([0], np.cumsum(mask)))
        return before[self.row_start + self.row_width] > before[self.row_start]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of each image."""
        before = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return before[self.start + self.width * self.height] - before[self.start]

    def boxes(self, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        """(image, x, y, w, h) of all ink of each image with any."""
        at = np.flatnonzero(mask)
        row = np.searchsorted(self.row_start, at, side="right") - 1
        image, x, y = self.row_image[row], at - self.row_start[row], self.row_y[row]
        own, first = np.unique(image, return_index=True)
        if not len(own):
            return (own,) * 5
        low, high = (f.reduceat(x, first) for f in (np.minimum, np.maximum))
        top, bottom = y[first], np.maximum.reduceat(y, first)
        return own, low, top, high - low + 1, bottom - top + 1

    def components(self, mask: np.ndarray, row_group: np.ndarray | None = None) -> Components:
        """4-connected components of the mask. Rows of different groups don't touch; those of group -1 are left out."""
        group = self.row_image if row_group is None else row_group
        edge = np.zeros(len(mask) + 1, bool)
        edge[self.row_start] = True
        edge[-1] = True
        ink = np.concatenate(([False], mask, [False]))
        a = np.flatnonzero(ink[1:-1] & (~ink[:-2] | edge[:-1]))
        b = np.flatnonzero(ink[1:-1] & (~ink[2:] | edge[1:])) + 1
        row = np.searchsorted(self.row_start, a, side="right") - 1
        if row_group is not None:
            kept = group[row] >= 0
            a, b, row = a[kept], b[kept], row[kept]
        step = self.row_width[row]
        above = (self.row_y[row] > 0) & (group[row] == group[np.maximum(row - 1, 0)])
        low = np.searchsorted(b, a - step, side="right")
        count = np.where(above, np.maximum(np.searchsorted(a, b - step, side="left") - low, 0), 0)
        label = joined(len(a), np.repeat(np.arange(len(a)), count), np.repeat(low, count) + ranges(count))
        return Components(self, a, b, row, group[row], label)


class Components:
    """Groups of runs of ink: ``of`` tells each run's one; box, ink, group and first run of each are arrays in the order of their first pixels."""

    def __init__(self, sheet: Sheet, a: np.ndarray, b: np.ndarray, row: np.ndarray, group: np.ndarray, label: np.ndarray):
        self.sheet, self.a, self.b, self.row, self.run_group = sheet, a, b, row, group
        self.first, self.of = np.unique(label, return_inverse=True)
        self.label = self.first
        self.measure()

    def measure(self) -> None:
        n, s = len(self.first), self.sheet
        x0, x1, y = self.a - s.row_start[self.row], self.b - s.row_start[self.row], s.row_y[self.row]
        least = lambda v: (out := np.full(n, np.iinfo(np.int64).max), np.minimum.at(out, self.of, v))[0]
        most = lambda v: (out := np.zeros(n, np.int64), np.maximum.at(out, self.of, v))[0]
        self.x, self.y = least(x0), least(y)
        self.w, self.h = most(x1) - self.x, most(y) + 1 - self.y
        self.ink = np.bincount(self.of, self.b - self.a, n).astype(np.int64)
        self.image, self.group = s.row_image[self.row[self.first]], self.run_group[self.first]

    def ordered(self, *keys: str) -> None:
        """Sort by the arrays of the names, then by first pixels, and number them anew."""
        order = np.lexsort([self.first, *(getattr(self, k) for k in reversed(keys))])
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.of = place[self.of]
        for k in ("first", "label", "x", "y", "w", "h", "ink", "image", "group"):
            setattr(self, k, getattr(self, k)[order])

    def united(self, label: np.ndarray) -> None:
        """Put the components of one label together."""
        own, of = np.unique(label, return_inverse=True)
        first = np.full(len(own), len(self.a))
        np.minimum.at(first, of, self.first)
        self.first, self.of, self.label = first, of[self.of], own
        self.measure()

    def rank(self) -> np.ndarray:
        """The number of each within its group, once in order of the groups."""
        return np.arange(len(self.group)) - np.searchsorted(self.group, self.group)

    def painted(self) -> np.ndarray:
        """The component of each pixel, -1 where there is none."""
        out = np.full(len(self.sheet.pixels), -1, np.int64)
        length = self.b - self.a
        out[np.repeat(self.a, length) + ranges(length)] = np.repeat(self.of, length)
        return out


def text_lines(sheet: Sheet, mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group of each row or -1, and for each group its image, line and first row), as ``vision.find_lines`` finds them. Equal patterns of rows are looked at once."""
    inked, known, found = sheet.rows_with(mask), {}, []
    group, at = np.full(len(inked), -1), 0
    for image, high in enumerate(sheet.height.tolist()):
        rows = inked[at : at + high]
        if (key := rows.tobytes()) not in known:
            known[key] = find_lines(rows[:, None], least)
        for line, (a, b) in enumerate(known[key]):
            group[at + a : at + b + 1] = len(found)
            found.append((image, line, a))
        at += high
    return group, *np.array(found, np.int64).reshape(-1, 3).T


Frame = Callable[[int, int], tuple[float | None, float | None]]


def normalised(sheet: Sheet, image: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, value: Callable[[np.ndarray, np.ndarray], np.ndarray], frame: Frame | None = None, row: float = 18.0, target: int = TARGET) -> np.ndarray:
    """[n, target²] glyphs of the boxes, fitted as ``vision.normalize_glyph`` does. ``value`` gives strengths of (box, pixel); those of one size share their maps."""
    out = np.zeros((len(x), target * target), np.uint8)
    if not len(x):
        return out
    sizes, of = np.unique(w * (int(h.max()) + 1) + h, return_inverse=True)
    order = np.argsort(of, kind="stable")
    ends = np.cumsum(np.bincount(of, minlength=len(sizes)))
    base, stride = sheet.start[image] + y * sheet.width[image] + x, sheet.width[image]
    for some in np.split(order, ends[:-1]):
        wide, high = int(w[some[0]]), int(h[some[0]])
        baseline, scale = frame(wide, high) if frame else (None, None)
        room = target * (0.8 if scale is None else 1.0) / max(high, wide)
        scale = room if scale is None else min(scale, room)
        size = fitted(high, scale), fitted(wide, scale)
        top, left = ((target - n) // 2 for n in size)
        if baseline is not None:
            top = int(np.clip(round(row - baseline * scale), 0, target - size[0]))
        down, right = sources(target, high, size[0], top), sources(target, wide, size[1], left)
        rows, columns = np.flatnonzero(down < high), np.flatnonzero(right < wide)
        # Each pixel of the source is looked up once, and copied to its places.
        at = base[some, None] + (np.arange(high)[None, :, None] * stride[some, None, None] + np.arange(wide)[None, None, :]).reshape(len(some), -1)
        found = value(np.repeat(some, high * wide), at.ravel()).reshape(len(some), -1)
        places = (rows[:, None] * target + columns[None, :]).ravel()
        out[some[:, None], places[None, :]] = found[:, (down[rows][:, None] * wide + right[columns][None, :]).ravel()]
    return out


def binaries(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a column of binaries."""
    n, size = rows.shape
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * size, size, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def cut_out(values: np.ndarray, at: np.ndarray, lengths: Sequence[int]) -> pa.Array:
    """Bytes at the places, as binaries of the lengths."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values[at]))])


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
