"""Ground truth: ink inside boxes, lines glued from single characters, and the path through a lattice that spells a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .glyphs import tight

#: Columns of a bucket in the join of pixels and boxes; and what a candidate loses that doesn't list the wanted character.
BUCKET = 32
UNLISTED = -2.0


def ink_coverage(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """(line_id, seg_id, box_id, inside, coverage, atom_coverage) of segments with ink in a box.

    ``pixels``: line_id, seg_id, x, y, one row for each pixel of ink; ``boxes``: line_id, box_id, x0, y0, x1, y1, ends exclusive. Coverage is the lesser
    of the shares of the segment's and of the box's ink; atom coverage the first alone. Pixels and boxes meet in buckets of columns.
    """
    reach = F.sequence(F.floor(F.col("x0") / BUCKET), F.floor((F.greatest("x1", F.col("x0") + 1) - 1) / BUCKET))
    own = pixels.withColumn("bucket", F.floor(F.col("x") / BUCKET))
    both = own.join(boxes.withColumn("bucket", F.explode(reach)), ["line_id", "bucket"])
    both = both.where((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")))
    inside = both.groupBy("line_id", "seg_id", "box_id").agg(F.count("*").alias("inside"))
    segments = pixels.groupBy("line_id", "seg_id").agg(F.count("*").alias("ink"))
    box_ink = both.select("line_id", "box_id", "x", "y").distinct().groupBy("line_id", "box_id").agg(F.count("*").alias("box_ink"))
    out = inside.join(segments, ["line_id", "seg_id"]).join(box_ink, ["line_id", "box_id"])
    return out.select("line_id", "seg_id", "box_id", "inside", F.least(F.col("inside") / F.col("ink"), F.col("inside") / F.col("box_ink")).alias("coverage"), (F.col("inside") / F.col("ink")).alias("atom_coverage"))


def glue(left: np.ndarray, right: np.ndarray, bridge: str = "full") -> tuple[np.ndarray, tuple[int, int, int, int], tuple[int, int, int, int]]:
    """Two characters on one baseline as a mask, and their boxes (x0, y0, x1, y1).

    ``full``: side by side; ``none``: a blank column between them; ``row``: the column has a thin bridge where the ink of both ends is closest, at most 18 % of the height.
    """
    if bridge not in ("full", "row", "none"):
        raise ValueError("the bridge is full, row or none")
    a, b = tight(0, 0, left)[2], tight(0, 0, right)[2]
    h, gap = max(len(a), len(b)), 0 if bridge == "full" else 1
    stand = lambda m: np.pad(m, ((h - len(m), 0), (0, 0)))
    out = np.concatenate([stand(a), np.zeros((h, gap), bool), stand(b)], 1)
    at = a.shape[1]
    if bridge == "row":
        ends = np.flatnonzero(out[:, at - 1]), np.flatnonzero(out[:, at + 1])
        i, j = np.unravel_index(np.abs(np.subtract.outer(*ends)).argmin(), (len(ends[0]), len(ends[1])))
        low, high = sorted((int(ends[0][i]), int(ends[1][j])))
        if high - low + 1 > max(1, int(h * 0.18)):
            raise ValueError("the ends are too far apart for a thin bridge")
        out[low : high + 1, at] = True
    return out, (0, h - len(a), at, h), (at + gap, h - len(b), out.shape[1], h)


def spelled_path(options: list[tuple[int, int, dict[str, float]]], text: str) -> list[int] | None:
    """The tiling whose characters are the text, of largest sum of their scores; numbers of the candidates, or none.

    ``options``: (start, end, score by character). A candidate that doesn't list a character may still stand for it at a loss.
    """
    last = max((o[1] for o in options), default=0)
    best: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for ch in text:
        after: dict[int, tuple[float, tuple | None]] = {}
        for i, (start, end, scores) in enumerate(options):
            if start in best and end > start:
                total = best[start][0] + scores.get(ch, UNLISTED)
                if end not in after or total > after[end][0]:
                    after[end] = (total, (best[start][1], i))
        best = after
    path, node = [], best[last][1] if last in best and text else None
    while node:
        node, i = node
        path.append(i)
    return path[::-1] or None


SPELLED = "line_id long, path string, recalled boolean"


def spelled_paths(options: DataFrame, truth: DataFrame) -> DataFrame:
    """(line_id, path, recalled) for ``options`` (line_id, start, end, char, visual) and ``truth`` (line_id, text)."""
    each = options.groupBy("line_id", "start", "end").agg(F.map_from_entries(F.collect_list(F.struct("char", F.col("visual").cast("double")))).alias("scores"))
    lines = each.groupBy("line_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", F.map_entries("scores").alias("scores")))).alias("options")).join(truth.select("line_id", "text"), "line_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for own, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = spelled_path([(o["start"], o["end"], {e["key"]: e["value"] for e in o["scores"]}) for o in own], text)
                paths.append(",".join(f"{own[i]['start']}-{own[i]['end']}" for i in found) if found else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string()), pa.array([p is not None for p in paths])], names=["line_id", "path", "recalled"])

    return lines.select("line_id", "options", "text").mapInArrow(run, SPELLED)


def report_text(recall: float, n: int, samples: list[dict]) -> str:
    """A recall report as text: the share, how often each status stands, and a line for each sample (text, recalled, status, reason)."""
    counts: dict[str, int] = {}
    for s in samples:
        counts[s["status"]] = counts.get(s["status"], 0) + 1
    rows = [f"{s['text']:<12} {'yes' if s['recalled'] else 'no':<7} {s['status']:<13} {s.get('reason', '')}".rstrip() for s in samples]
    return "\n".join([f"lattice recall {recall:.1%} of {n}", "status " + ", ".join(f"{k} {v}" for k, v in sorted(counts.items())), *rows])
