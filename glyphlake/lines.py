"""Text lines of images through candidate lattices: atoms, candidates, templates and network, suspect merges, decoding. One plan over tables.

A kernel turns each image into its candidates; everything after it is a table: pruning, distances, fusion, geometry, penalties. Lines are numbered
image_id * 4096 + line, so an image has at most 4096 lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import decode, distance, evidence, lexicon_decode, merges, ranking, sheets, vision
from .operators import segmentation as sg
from .operators.glyphs import NormalSpec, Part, united
from .session import written
from .sources.models import words_of

#: Alternatives of a candidate, and a template's score that can't be doubted.
KEPT, EXACT, TRUSTED = 5, 1.0 - 1e-9, 0.9
LINES = 4096

CANDIDATES = "image_id long, line_id long, start int, end int, n int, parts int, x int, y int, w int, h int, ink int, gap int, gap_y int, line_h int, expected_width double, bits array<long>, soft binary"
KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
ARROW = pa.schema([(c, KINDS[k]) for c, k in (x.split(" ") for x in CANDIDATES.split(", "))])


@dataclass(frozen=True)
class Reading:
    """How lines are read: what is ink, sizes of characters, atoms of a candidate, a font's frame, weights of network and templates."""

    ink: vision.Ink = vision.Ink()
    bounds: sg.Bounds = sg.Bounds()
    longest: int = 4
    spec: NormalSpec | None = None
    w_cnn: float = 0.45
    w_template: float = 0.45


def usual_width(parts: list[Part], bounds: sg.Bounds) -> float:
    """0.8 of the median height of the tall components, within the bounds."""
    heights = np.array([m.shape[0] for _, _, m in parts])
    tall = heights[heights >= max(2, 0.6 * heights.max())]
    return float(np.clip(np.median(tall) * 0.8, bounds.width_least, bounds.width_most))


def line_atoms(parts: list[Part], width: float, reading: Reading) -> list[tuple[int, int, Part]]:
    """(component, pieces of it, atom) in reading order."""
    out = []
    for k, (x, y, mask) in enumerate(parts):
        found = merges.pieces(mask, width, reading.longest - 1, reading.bounds)
        out += [(k, len(found), (x + dx, y + dy, m)) for dx, dy, m in found]
    return sorted(out, key=lambda a: (a[2][0], a[2][1], a[0]))


def candidates_of_line(parts: list[Part], reading: Reading, soft: np.ndarray) -> Iterator[tuple]:
    """Rows of all ranges of up to ``longest`` atoms of a line, without its ids."""
    width = usual_width(parts, reading.bounds)
    atoms = line_atoms(parts, width, reading)
    line_h = max(m.shape[0] for _, _, m in parts)
    for start in range(len(atoms)):
        for end in range(start + 1, min(len(atoms), start + reading.longest) + 1):
            some = [a[2] for a in atoms[start:end]]
            x, y, mask = united(some)
            h, w = mask.shape
            pairs = list(zip(some, some[1:], strict=False))
            gap = max((b[0] - a[0] - a[2].shape[1] for a, b in pairs), default=None)
            gap_y = min((max(a[1], b[1]) - min(a[1] + a[2].shape[0], b[1] + b[2].shape[0]) for a, b in pairs), default=None)
            frame = vision.glyph_frame(w, h, reading.spec.script()) if reading.spec else (None, None)
            row = reading.spec.baseline_row if reading.spec else 18.0
            glyph = vision.normalize_glyph(mask, baseline=frame[0], scale=frame[1], row=row)
            strong = vision.normalize_glyph(np.where(mask, soft[y : y + h, x : x + w], 0).astype(np.uint8), baseline=frame[0], scale=frame[1], row=row)
            yield start, end, end - start, len({a[0] for a in atoms[start:end]}), x, y, w, h, int(mask.sum()), gap, gap_y, line_h, width, words_of(np.packbits(glyph > 0)[None])[0], strong.tobytes()


def usual_widths(found: sheets.Components, bounds: sg.Bounds) -> tuple[np.ndarray, np.ndarray]:
    """(``usual_width``, largest height) of each component's line; components are in order of their lines."""
    group, first, of = np.unique(found.group, return_index=True, return_inverse=True)
    if not len(group):
        return np.zeros(0), found.h
    most = np.maximum.reduceat(found.h, first)
    tall = found.h >= np.maximum(2, 0.6 * most)[of]
    heights, lines = found.h[tall], of[tall]
    heights = heights[np.lexsort((heights, lines))]
    n = np.bincount(lines, minlength=len(group))
    at, last = np.cumsum(n) - n, len(heights) - 1
    middle = (heights[np.clip(at + (n - 1) // 2, 0, last)] + heights[np.minimum(at + n // 2, last)]) / 2 if len(heights) else np.zeros(len(n))
    middle = np.where(n > 0, middle, np.nan)  # only specks
    return np.clip(middle * 0.8, bounds.width_least, bounds.width_most)[of], most[of]


def atoms_of_sheet(found: sheets.Components, width: np.ndarray, reading: Reading) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(atom of each pixel, arrays of the atoms in reading order), as ``line_atoms`` of each line. Only components that may be cut are taken one by one, equal ones once."""
    sheet, part, known = found.sheet, found.painted(), {}
    most, bounds = reading.longest - 1, reading.bounds
    wide = np.flatnonzero((found.h >= max(2, bounds.height_least)) & (found.w > np.maximum(width * 1.5, found.h * 1.25))) if most >= 1 else []
    cut, more, where = [], [], []
    for k in wide:
        x, y, w, h, image = (int(v[k]) for v in (found.x, found.y, found.w, found.h, found.image))
        at = sheet.start[image] + (y + np.arange(h))[:, None] * sheet.width[image] + x + np.arange(w)
        mask = part[at] == k
        if (key := (h, w, mask.tobytes(), float(width[k]))) not in known:
            known[key] = merges.pieces(mask, float(width[k]), most, bounds)
        if len(known[key]) > 1:
            cut.append(k)
            for px, py, m in known[key]:
                more.append((k, x + px, y + py, m.shape[1], m.shape[0], int(m.sum())))
                where.append(at[py : py + m.shape[0], px : px + m.shape[1]][m])
    whole = np.setdiff1d(np.arange(len(found.x)), cut)
    extra = np.array(more, np.int64).reshape(-1, 6).T
    component = np.concatenate((whole, extra[0]))
    atoms = {"component": component, "group": found.group[component], "image": found.image[component], "width": width[component]}
    atoms |= {c: np.concatenate((getattr(found, c)[whole], extra[i])) for i, c in enumerate(("x", "y", "w", "h", "ink"), 1)}
    order = np.lexsort((atoms["component"], atoms["y"], atoms["x"], atoms["group"]))
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    named = np.full(len(found.x) + 1, -1)
    named[whole] = place[: len(whole)]
    painted = named[part]
    for i, pixels in enumerate(where):
        painted[pixels] = place[len(whole) + i]
    return painted, {c: v[order] for c, v in atoms.items()}


def candidates_of_images(images: DataFrame, reading: Reading = Reading(), strong: bool = True) -> DataFrame:
    """Candidates of every line of the images (image_id, width, height, pixels), with packed and, if ``strong``, soft glyphs: ``candidates_of_line`` for a batch at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        script = reading.spec.script() if reading.spec else None
        frame, row = (lambda w, h: vision.glyph_frame(w, h, script)) if reading.spec else None, reading.spec.baseline_row if reading.spec else 18.0
        for batch in sheets.slices(batches):
            sheet = sheets.Sheet(batch)
            hard = reading.ink.hard(sheet.pixels)
            rows, _, line, top = sheets.text_lines(sheet, hard, reading.bounds.height_least)
            found = sheet.components(hard, rows)
            found.ordered("group", "x", "y")
            if not len(found.x):
                continue
            width, line_h = usual_widths(found, reading.bounds)
            painted, a = atoms_of_sheet(found, width, reading)
            line_h = line_h[a["component"]]
            first = np.searchsorted(a["group"], a["group"])
            rank, left = np.arange(len(first)) - first, np.searchsorted(a["group"], a["group"], side="right") - np.arange(len(first))
            box = [a["x"], a["y"], a["x"] + a["w"], a["y"] + a["h"], a["ink"], np.zeros_like(a["x"]), np.zeros_like(a["x"]), np.ones_like(a["x"])]
            out, at = [], np.arange(len(first))
            for n in range(1, reading.longest + 1):
                if n > 1:
                    kept = left[at] >= n
                    at, box = at[kept], [v[kept] for v in box]
                    b, c = at + n - 1, at + n - 2
                    gap = a["x"][b] - a["x"][c] - a["w"][c]
                    gap_y = np.maximum(a["y"][c], a["y"][b]) - np.minimum(a["y"][c] + a["h"][c], a["y"][b] + a["h"][b])
                    fresh = np.all([a["component"][b] != a["component"][at + k] for k in range(n - 1)], axis=0)
                    box = [np.minimum(box[0], a["x"][b]), np.minimum(box[1], a["y"][b]), np.maximum(box[2], (a["x"] + a["w"])[b]), np.maximum(box[3], (a["y"] + a["h"])[b]), box[4] + a["ink"][b], np.maximum(box[5], gap) if n > 2 else gap, np.minimum(box[6], gap_y) if n > 2 else gap_y, box[7] + fresh]
                out.append((at, np.full(len(at), n), *box))
            at, n, x, y, x1, y1, ink, gap, gap_y, parts = (np.concatenate(c) for c in zip(*out, strict=True))
            w, h, image, group = x1 - x, y1 - y, a["image"][at], a["group"][at]
            inside = lambda k, p, at=at, n=n, painted=painted: (painted[p] >= at[k]) & (painted[p] < at[k] + n[k])
            glyph = sheets.normalised(sheet, image, x, y, w, h, inside, frame, row)
            bits = words_of(np.packbits(glyph > 0, axis=1))
            soft = pa.nulls(len(at), pa.binary())
            if strong:
                level = reading.ink.soft(sheet.pixels)
                soft = sheets.binaries(sheets.normalised(sheet, image, x, y, w, h, lambda k, p, inside=inside, level=level: np.where(inside(k, p), level[p], 0), frame, row))
            ids, alone = sheet.ids.take(pa.array(image)), n == 1
            words = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * bits.shape[1]), pa.array(bits.ravel()))
            line_id = np.asarray(ids) * LINES + line[group]
            yield sheets.record(ARROW, ids, line_id, rank[at], rank[at] + n, n, parts, x, y - top[group], w, h, ink, pa.array(gap, pa.int32(), mask=alone), pa.array(gap_y, pa.int32(), mask=alone), line_h[at], a["width"][at], words, soft)

    return images.select("image_id", "width", "height", "pixels").mapInArrow(run, CANDIDATES)


def network_logits(candidates: DataFrame, weights: dict[str, np.ndarray], kept: int = KEPT) -> DataFrame:
    """(glyph_id, char_id, logit, rank): the network's best classes of each soft glyph."""
    shared = candidates.sparkSession.sparkContext.broadcast(weights)  # a small network
    kind = candidates.schema["glyph_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            glyphs = np.stack([np.frombuffer(x, np.uint8).reshape(vision.TARGET, vision.TARGET) for x in batch.column(1).to_pylist()])
            logits = vision.forward(glyphs, shared.value)
            order = np.argsort(-logits, axis=1, kind="stable")[:, :kept]
            n = order.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), n))), pa.array(order.ravel(), pa.int64()), pa.array(np.take_along_axis(logits, order, 1).ravel(), pa.float64()), pa.array(np.tile(np.arange(1, n + 1), batch.num_rows), pa.int32())], names=["glyph_id", "char_id", "logit", "rank"])

    return candidates.select("glyph_id", "soft").mapInArrow(run, f"glyph_id {kind}, char_id long, logit double, rank int")


def scored(candidates: DataFrame, prototypes: DataFrame, reading: Reading, weights: dict[str, np.ndarray] | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(glyph_id, char_id, visual, template, rank): templates alone, or fused with the network; a trusted template stays first with its own score at least."""
    protos = prototypes if allowed is None else prototypes.join(allowed, "char_id", "left_semi")
    # Equal glyphs are compared once: a text has few different ones.
    forms = candidates.select(F.col("bits").alias("glyph_id"), "bits").distinct()
    ranked = distance.per_class_topk(distance.class_minimum(forms, protos), KEPT, vision.TARGET**2)
    best = candidates.select("glyph_id", "bits").join(ranked.select(F.col("glyph_id").alias("bits"), "char_id", "score", "rank"), "bits").drop("bits")
    if weights is None:
        return best.select("glyph_id", "char_id", F.col("score").alias("visual"), F.col("score").alias("template"), "rank")
    logits = network_logits(candidates, weights)
    logits = logits if allowed is None else logits.join(allowed, "char_id", "left_semi")
    fused = ranking.fuse(best, logits, reading.w_cnn, reading.w_template)
    trusted = best.where((F.col("rank") == 1) & (F.col("score") >= TRUSTED)).select("glyph_id", "char_id", "score")
    return ranking.fuse_trusted(fused, trusted).where(F.col("rank") <= KEPT).select("glyph_id", "char_id", F.col("combined").alias("visual"), F.col("template_score").alias("template"), "rank")


def lattice_options(images: DataFrame, prototypes: DataFrame, charset: DataFrame, reading: Reading = Reading(), weights: dict[str, np.ndarray] | None = None, metrics: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(line_id, start, end, rank, char, visual, geometry) of every candidate worth a look, for the decoders. A candidate without a class gets ``?``.

    Geometry has both halves where ``metrics`` of the characters are known; an exact template needs none. Merges that are likely several characters lose visual score.
    """
    every = written(candidates_of_images(images, reading, weights is not None), "candidates").withColumn("glyph_id", F.struct("line_id", "start", "end"))
    kept = every.where(sg.passes_filters(F.col("expected_width"), reading.bounds) | ((F.col("n") == 1) & (F.col("parts") == 1)))
    choice = scored(kept, prototypes, reading, weights, allowed)
    atoms = every.where("n = 1").select("line_id", F.col("start").alias("atom_idx"), "x", "y", "w", "h")
    placed = sg.candidate_geometry(kept.select("glyph_id", "line_id", "start", "end", "n", "x", "y", "w", "h", "ink", "gap", "line_h"), atoms, reading.bounds)
    own = choice.join(placed, "glyph_id")
    own = sg.char_geometry(own, metrics) if metrics is not None else own.withColumn("char_geometry", F.lit(0.0))
    exact = (F.col("rank") == 1) & (F.col("template") >= EXACT)
    own = own.withColumn("total", F.when(exact, 0.0).otherwise(merges.total_geometry(F.col("geometry"), F.col("char_geometry"))))
    if weights is not None:
        first = own.where("rank = 1").select("line_id", "start", "end", "w", "h", "visual", "template", F.when(F.col("template") >= F.col("visual"), "template").otherwise("cnn").alias("kind"), "line_h")
        parts = atoms.join(first.where("end - start = 1").select("line_id", F.col("start").alias("atom_idx"), F.col("visual").alias("score")), ["line_id", "atom_idx"], "left")
        penalty = merges.fake_merge_penalty(first.where("end - start > 1"), parts).select("line_id", "start", "end", "penalty")
        own = own.join(penalty, ["line_id", "start", "end"], "left").withColumn("visual", F.greatest(F.lit(0.0), F.col("visual") - F.coalesce("penalty", F.lit(0.0))))
    named = own.join(charset, "char_id").select("line_id", "start", "end", (F.col("rank") - 1).cast("int").alias("rank"), F.col("ch").alias("char"), "visual", F.col("total").alias("geometry"))
    return lexicon_decode.with_unknowns(named, kept.select("line_id", "start", "end"))


def read_lines(images: DataFrame, prototypes: DataFrame, charset: DataFrame, lexicon: DataFrame | None = None, reading: Reading = Reading(), **parts) -> DataFrame:
    """(image_id, line, text, score, confidence, alternatives) of each line.

    With a lexicon the beam decides, without one the path of best mean score; both over the same lattice.
    """
    options = lattice_options(images, prototypes, charset, reading, **parts)
    if lexicon is not None:
        found = lexicon_decode.decode_lattice(options, lexicon)
    else:
        first = options.where("rank = 0").select("line_id", "start", "end", "char", evidence.finalize(F.col("visual"), F.col("geometry"))["visual"].alias("score"))
        spans = decode.best_paths(first.select("line_id", "start", "end", "score"))
        steps = spans.select("line_id", "mean_score", F.posexplode(F.split("path", ",")).alias("at", "span")).select("line_id", "mean_score", "at", F.split("span", "-")[0].cast("int").alias("start"), F.split("span", "-")[1].cast("int").alias("end"))
        chars = steps.join(first, ["line_id", "start", "end"]).groupBy("line_id", "mean_score").agg(F.sort_array(F.collect_list(F.struct("at", "char", "score"))).alias("c"))
        found = chars.select("line_id", F.array_join(F.transform("c", lambda c: c["char"]), "").alias("text"), F.col("mean_score").alias("score"), (F.aggregate("c", F.lit(0.0), lambda s, c: s + c["score"]) / F.size("c")).alias("confidence"), F.array().cast("array<string>").alias("alternatives"))
    return found.select(F.floor(F.col("line_id") / LINES).alias("image_id"), (F.col("line_id") % LINES).cast("int").alias("line"), "text", "score", "confidence", "alternatives")


def read_images(images: DataFrame, prototypes: DataFrame, charset: DataFrame, lexicon: DataFrame | None = None, reading: Reading = Reading(), **parts) -> DataFrame:
    """(image_id, text): the lines of each image one after another."""
    lines = read_lines(images, prototypes, charset, lexicon, reading, **parts)
    rows = lines.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("rows"))
    return rows.select("image_id", F.array_join(F.transform("rows", lambda r: r["text"]), "").alias("text"))
