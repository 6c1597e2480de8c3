"""Best paths through candidate lattices. Order-dependent recurrences run as kernels over one line at a time; a line is bounded by its screen width."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-9


def mean_path(candidates: list[tuple[int, int, float]]) -> tuple[list[int], float]:
    """Path of best mean score, keeping one state for each end; ties take fewer candidates. Returns numbers of candidates and the mean."""
    if not candidates:
        return [], 0.0
    last = max(c[1] for c in candidates)
    ending: dict[int, list[int]] = {}
    for k, c in enumerate(candidates):
        ending.setdefault(c[1], []).append(k)
    state: dict[int, tuple[float, int, int, int]] = {0: (0.0, 0, -1, -1)}
    for end in range(1, last + 1):
        best = None
        for k in ending.get(end, ()):
            before = state.get(candidates[k][0])
            if before is None:
                continue
            total, count = before[0] + candidates[k][2], before[1] + 1
            lead = 1.0 if best is None else total / count - best[0] / best[1]
            if lead > EPSILON or (abs(lead) <= EPSILON and count < best[1]):
                best = (total, count, candidates[k][0], k)
        if best is not None:
            state[end] = best
    if last not in state:
        return [], 0.0
    path, at = [], last
    while at > 0:
        path.append(state[at][3])
        at = state[at][2]
    return path[::-1], state[last][0] / state[last][1]


def kbest_paths(candidates: list[tuple[int, int, float, str]], k: int, alpha: float, beta: float) -> list[tuple[float, tuple[int, ...], str]]:
    """The k best paths by score over (n + beta) ** alpha; ties by covered atoms and text; equal paths count once."""
    if not candidates:
        return []
    last = max(c[1] for c in candidates)
    ending: dict[int, list[int]] = {}
    for i, c in enumerate(candidates):
        ending.setdefault(c[1], []).append(i)
    kept: dict[int, list[tuple[float, tuple[int, ...], str]]] = {0: [(0.0, (), "")]}
    norm = [1.0, *((n + beta) ** alpha for n in range(1, len(candidates) + 1))]  # of each number of candidates
    key = lambda p: (-p[0] / norm[len(p[1])], p[2], p[1])
    for end in range(1, last + 1):
        found = {}
        for i in ending.get(end, ()):
            start, _, score, text = candidates[i]
            for total, path, so_far in kept.get(start, ()):
                found.setdefault((*path, i), (total + score, (*path, i), so_far + text))
        if found:
            kept[end] = sorted(found.values(), key=key)[:k]
    return kept.get(last, [])


def lines_of(candidates: DataFrame) -> DataFrame:
    """One row per line with its candidates in order of end and start; a kernel then takes many lines at a time."""
    spans = F.sort_array(F.collect_list(F.struct("end", "start", "score")))
    return candidates.groupBy("line_id").agg(spans.alias("spans"))


def spans_of(column: pa.Array) -> Iterator[tuple[list[int], list[int], list[float]]]:
    """(starts, ends, scores) of each line. The batch becomes three plain lists at once, without an object for each candidate."""
    offsets = column.offsets.to_pylist()
    end, start, score = (column.values.field(c).to_pylist() for c in ("end", "start", "score"))
    for a, b in zip(offsets, offsets[1:], strict=False):
        yield start[a:b], end[a:b], score[a:b]


def best_paths(candidates: DataFrame) -> DataFrame:
    """One row per line: spans of the best-mean path and its mean. ``candidates``: line_id, start, end, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for spans in spans_of(batch.column(1)):
                rows = list(zip(*spans, strict=True))
                path, mean = mean_path(rows)
                for column, value in zip(out, (",".join(f"{rows[i][0]}-{rows[i][1]}" for i in path), len(path), mean), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.float64())], names=["line_id", "path", "n", "mean_score"])

    return lines_of(candidates).mapInArrow(run, "line_id long, path string, n int, mean_score double")


def kbest(candidates: DataFrame, k: int = 3, alpha: float = 1.0, beta: float = 0.0) -> DataFrame:
    """k rows per line: rank, spans, score and normalised score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[int, int], str] = {}
        for batch in batches:
            rows = []
            for line, spans in zip(batch.column(0).to_pylist(), spans_of(batch.column(1)), strict=True):
                found = kbest_paths([(a, b, score, names.setdefault((a, b), f"{a}-{b};")) for a, b, score in zip(*spans, strict=True)], k, alpha, beta)
                rows += [(line, i, text, total, total / (len(path) + beta) ** alpha) for i, (total, path, text) in enumerate(found, 1)]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=["line_id", "rank", "path", "score", "norm"])

    return lines_of(candidates).mapInArrow(run, "line_id long, rank int, path string, score double, norm double")
