"""Pruning and geometry of candidates, as column expressions, and cuts of wide components, as kernels.

Atoms are (line_id, atom_idx, x, y, w, h, ink). Lines are bounded by their screen width, so windows over a line are small.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bounds:
    """Sizes of characters and the usual space between them, in pixels."""

    height_least: int = 8
    height_most: int = 64
    width_least: int = 4
    width_most: int = 64
    spacing: int = 1


@dataclass(frozen=True)
class Envelope:
    """Widths and heights over the em, of narrow and full characters."""

    narrow_height: float
    narrow_width: float
    narrow_width_least: float
    narrow_width_most: float
    full_height: float
    full_width: float
    full_width_least: float
    full_width_most: float


NARROW_BELOW = 0.8


def ahead(atoms: DataFrame, fields: list[str], longest: int) -> DataFrame:
    """Each atom with the fields of the next ones in columns ``_<k>_<field>`` and ``_left``, how many atoms its line has from there on, ``longest`` at most.

    Plain offsets over one sort by line: no arrays are gathered, and all that follows is compiled.
    """
    w = Window.partitionBy("line_id").orderBy("atom_idx")
    later = {f"_{k}_{f}": F.lead(f, k).over(w) for k in range(1, longest) for f in fields}
    left = sum((F.lead(F.lit(1), k, 0).over(w) for k in range(1, longest)), F.lit(1))
    return atoms.withColumns(later | {"_left": left}).withColumnsRenamed({f: f"_0_{f}" for f in fields})


def ranges_of(own: DataFrame, longest: int, one: Callable[[int], Column], keep: list[str]) -> DataFrame:
    """A row for each range of up to ``longest`` atoms: the columns ``keep`` and the fields of the struct ``one(n)``."""
    each = F.filter(F.array(*(F.when(F.col("_left") >= n, one(n)) for n in range(1, longest + 1))), lambda r: r.isNotNull())
    return own.select(*keep, F.inline(each))


def candidate_parts(atoms: DataFrame, longest: int) -> DataFrame:
    """Ranges of up to ``longest`` atoms with box, ink, widest gap inside and whether two neighbours are near each other in height."""
    at = lambda k, f: F.col(f"_{k}_{f}")
    own = ahead(atoms.select("line_id", F.col("atom_idx"), "x", "y", "w", "h", F.col("ink").cast("long").alias("ink")), ["x", "y", "w", "h", "ink"], longest)
    low = lambda values: F.least(*values) if len(values) > 1 else values[0]
    high = lambda values: F.greatest(*values) if len(values) > 1 else values[0]
    gap_x = lambda k: at(k + 1, "x") - at(k, "x") - at(k, "w")
    gap_y = lambda k: F.greatest(at(k, "y"), at(k + 1, "y")) - F.least(at(k, "y") + at(k, "h"), at(k + 1, "y") + at(k + 1, "h"))

    def one(n: int) -> Column:
        x, y, every, pairs = low([at(k, "x") for k in range(n)]), low([at(k, "y") for k in range(n)]), range(n), range(n - 1)
        gap, near = (high([gap_x(k) for k in pairs]), low([gap_y(k) for k in pairs])) if n > 1 else (F.when(F.lit(False), at(0, "x")), F.when(F.lit(False), at(0, "y")))
        return F.struct(
            F.col("atom_idx").alias("start"), (F.col("atom_idx") + n).alias("end"), F.lit(n).alias("n"), x.alias("x"), y.alias("y"), sum((at(k, "ink") for k in every), F.lit(0).cast("long")).alias("ink"), gap.alias("gap"), near.alias("gap_y"),
            (high([at(k, "x") + at(k, "w") for k in every]) - x).alias("w"), (high([at(k, "y") + at(k, "h") for k in every]) - y).alias("h"),
        )

    return ranges_of(own, longest, one, ["line_id"])


def middle(values: Column) -> Column:
    """Median of a short array."""
    s, n = F.array_sort(values), F.size(values)
    at = lambda i: F.get(s, i.cast("int"))
    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2


def envelope_ok(w: Column, h: Column, e: Envelope, most: Column) -> Column:
    """Whether the width over the em lies within the widest and the narrowest of its class, with room."""
    narrow = w / F.greatest(h, F.lit(1)) < NARROW_BELOW
    em = F.greatest(h / F.when(narrow, e.narrow_height).otherwise(e.full_height), F.lit(1.0))
    least = F.when(narrow, e.narrow_width_least).otherwise(e.full_width_least) * 0.35
    limit = F.when(narrow, e.narrow_width_most).otherwise(e.full_width_most) * most
    return (h < 2) | (w < 1) | (w / em).between(least, limit)


def passes_filters(expected_width: Column, bounds: Bounds = Bounds(), envelope: Envelope | None = None) -> Column:
    """Whether a candidate of ``candidate_parts`` is worth scoring."""
    w, h, least = F.col("w"), F.col("h"), max(2, bounds.height_least)
    fits = (w <= bounds.width_most) & (h <= bounds.height_most)
    shape = lambda most: envelope_ok(w, h, envelope, most) if envelope else F.lit(True)
    inked = F.col("ink") >= F.greatest(F.lit(1), F.floor(0.02 * w * h))
    one = fits & shape(F.when(h < least, 3.0).otherwise(1.35)) & ((h < least) | inked)
    many = fits & shape(F.lit(1.35)) & (h >= least) & (w <= F.greatest(F.lit(bounds.width_most), expected_width * 1.8)) & (F.col("gap") <= least + 2)
    # Two neighbours overlap by a pixel or lie within the height of a character.
    near = (F.col("gap_y") <= -1) | (F.col("gap_y") <= max(4, bounds.height_least))
    return F.when(F.col("n") == 1, one).otherwise(many & near & inked)


def usual_width(heights: Column, bounds: Bounds = Bounds()) -> Column:
    """0.8 of the median of the tall ones among a line's heights, within the bounds; null without any."""
    tall = F.filter(heights, lambda h: h >= F.greatest(F.lit(2), 0.6 * F.array_max(heights)))
    return F.when(F.size(tall) > 0, F.greatest(F.lit(float(bounds.width_least)), F.least(F.lit(float(bounds.width_most)), middle(tall).cast("double") * 0.8)))


def expected_width(atoms: DataFrame, bounds: Bounds = Bounds(), envelope: Envelope | None = None) -> DataFrame:
    """(line_id, expected_width): median width of a line's tall components by their class, else 0.8 of their median height."""
    if envelope is None:
        return atoms.groupBy("line_id").agg(F.collect_list("h").alias("_heights")).select("line_id", usual_width(F.col("_heights"), bounds).alias("expected_width")).where("expected_width IS NOT NULL")
    own = atoms.withColumn("_most", F.max("h").over(Window.partitionBy("line_id")))
    own = own.where(F.col("h") >= F.greatest(F.lit(2), 0.6 * F.col("_most")))
    heights = own.groupBy("line_id").agg(F.max("_most").alias("most"))
    limit = lambda x: F.greatest(F.lit(float(bounds.width_least)), F.least(F.lit(float(bounds.width_most)), x))
    aspect = F.col("w") / F.greatest(F.col("h"), F.lit(1))
    width = F.when(aspect < NARROW_BELOW, F.greatest(F.col("h") / envelope.narrow_height, F.lit(1.0)) * envelope.narrow_width).otherwise(F.greatest(F.col("h") / envelope.full_height, F.lit(1.0)) * envelope.full_width)
    found = own.where(aspect <= 1.1).groupBy("line_id").agg(F.median(width).alias("width"))
    return heights.join(found, "line_id", "left").select("line_id", limit(F.coalesce("width", F.col("most") * 0.8)).alias("expected_width"))


def candidate_geometry(candidates: DataFrame, atoms: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """Add ``geometry``, the penalty that doesn't depend on the character, and its part for width."""
    line = atoms.groupBy("line_id").agg(F.collect_list(F.struct("y", "h", "w")).alias("_all"))
    of = lambda f: middle(F.filter(F.transform("_all", f), lambda v: v.isNotNull())).cast("double")
    line = line.select("line_id", "_all", of(lambda a: a["y"] + a["h"] / 2).alias("_center"), of(lambda a: a["h"]).alias("_height"))
    tall = F.filter("_all", lambda a: (a["h"] >= F.greatest(F.lit(2), 0.5 * F.col("_height"))) & a["w"].isNotNull())
    own = candidates.join(line.select("line_id", "_center", "_height", middle(F.transform(tall, lambda a: a["w"])).cast("double").alias("_width")), "line_id")
    offset = F.abs(F.col("y") + F.col("h") / 2 - F.col("_center"))
    aligned = F.when(offset > max(1.0, bounds.height_least * 0.15), -F.least(F.lit(0.04), offset * 0.004)).otherwise(0.0)
    excess = F.greatest(F.lit(0), F.col("gap") - max(1, bounds.spacing))
    gap = F.when(F.col("n") > 1, -F.least(F.lit(0.04), excess * 0.01)).otherwise(0.0)
    wide = F.when((F.col("n") > 1) & (F.col("w") > F.coalesce("_width", "_height") * 1.9), -0.05).otherwise(0.0)
    return own.withColumns({"width_penalty": wide, "geometry": F.greatest(F.lit(-0.10), aligned + gap + wide)}).drop("_center", "_height", "_width")


def char_geometry(candidates: DataFrame, metrics: DataFrame) -> DataFrame:
    """Add ``char_geometry``: how far a candidate's shape is from its character's, by a join on char_id; 0 for unknown characters.

    ``metrics``: char_id, bbox_width, bbox_height, aspect_ratio, advance, ink_ratio, component_count. A charset bounds it.
    """
    own = candidates.join(metrics, "char_id", "left")
    w, h = F.col("w"), F.col("h")
    em = F.greatest(h / F.greatest("bbox_height", F.lit(1e-6)), w / F.greatest("bbox_width", F.lit(1e-6)), F.lit(1.0))
    off = lambda x, c, floor=1e-3: F.abs(x - F.col(c)) / F.greatest(F.col(c), F.lit(floor))
    capped = lambda x, rate, most: F.least(F.lit(most), x * rate)
    aspect = F.when(F.col("aspect_ratio") > 0, F.abs(F.ln(F.greatest(w / h / F.greatest("aspect_ratio", F.lit(1e-3)), F.lit(1e-3))))).otherwise(0.0)
    shape = capped(off(w / em, "bbox_width"), 0.04, 0.05) + capped(off(h / em, "bbox_height"), 0.03, 0.04) + capped(aspect, 0.02, 0.03) + capped(off(w / em, "advance"), 0.01, 0.02) + capped(off(F.col("ink") / (w * h), "ink_ratio", 0.05), 0.01, 0.03)
    wanted, has = F.greatest(F.lit(1), F.col("component_count")), F.greatest(F.lit(1), F.col("n"))
    restored = F.when((has > 1) & (wanted > 1), -F.col("width_penalty")).otherwise(0.0)
    count = F.when((has > 1) & (wanted == 1), -F.least(F.lit(0.04), (has - 1) * 0.02)).when((has == 1) & (wanted > 1), -F.least(F.lit(0.03), (wanted - 1) * 0.015)).when((has == wanted) & (has > 1), F.least(F.lit(0.05), (has - 1) * 0.025)).otherwise(0.0)
    return own.withColumn("char_geometry", F.when(F.col("bbox_width").isNull() | (w < 1) | (h < 1), 0.0).otherwise(restored + count - shape))


def weak_merges(candidates: DataFrame, threshold: float, lead: float = 0.02) -> DataFrame:
    """Merges that score under the threshold, or that one of their own parts beats by ``lead``. ``candidates``: line_id, start, end, score."""
    single = candidates.where("end - start = 1").select("line_id", F.col("start").alias("part"), F.col("score").alias("part_score"))
    many = candidates.where("end - start > 1").withColumn("part", F.explode(F.sequence("start", F.col("end") - 1)))
    best = many.join(single, ["line_id", "part"], "left").groupBy("line_id", "start", "end").agg(F.max("score").alias("score"), F.max("part_score").alias("best_part"))
    return best.where((F.col("score") < threshold) | (F.coalesce("best_part", F.lit(0.0)) > F.col("score") + lead))


def drop_weak_merges(candidates: DataFrame, threshold: float, lead: float = 0.02) -> DataFrame:
    return candidates.join(weak_merges(candidates, threshold, lead), ["line_id", "start", "end"], "left_anti")


def valley_cuts(mask: np.ndarray, width: float, bounds: Bounds = Bounds(), most: int = 3) -> list[int]:
    """Middles of inner valleys: runs of columns with ink up to 18 % of the height, pieces staying wide enough."""
    h, w = mask.shape
    thin = mask.sum(0) <= max(1, int(h * 0.18))
    edge = np.flatnonzero(np.diff(np.concatenate(([0], thin.astype(np.int8), [0]))))
    least, cuts = max(bounds.width_least, int(width * 0.4)), []
    for a, b in zip(edge[::2], edge[1::2] - 1, strict=True):
        middle = int(a + b + 1) // 2
        if a >= least and w - 1 - b >= least and (not cuts or middle - cuts[-1] >= least):
            cuts.append(middle)
    return cuts[:most]


def seam_cut(mask: np.ndarray, x: float, reach: int = 2, weight: float = 0.2) -> tuple[np.ndarray, float] | None:
    """Cheapest path down through ink near column x, moving a column a row at most: (column of each row, cost)."""
    h, w = mask.shape
    low, high = max(1, int(np.floor(x)) - reach), min(w - 2, int(np.ceil(x)) + reach)
    if high <= low or h < 2:
        return None
    columns = np.arange(low, high + 1)
    cost = mask[:, low : high + 1].astype(float) + weight * np.abs(columns - x)
    total, came = cost[0], []
    for row in cost[1:]:
        sides = np.stack([np.concatenate(([np.inf], total[:-1])), total, np.concatenate((total[1:], [np.inf]))])
        pick = sides.argmin(0)
        came.append(pick - 1)
        total = sides.min(0) + row
    at = int(total.argmin())
    path, best = [at], float(total[at])
    for step in reversed(came):
        at += int(step[at])
        path.append(at)
    return low + np.array(path[::-1]), best
