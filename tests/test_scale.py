"""Findings of round 3: results at their edges, and kernels over many rows against the same for one."""

import itertools

import numpy as np
import pyarrow as pa

from glyphlake.streaming import frames as fr
from glyphlake.streaming import tracker


def test_grey_at_the_threshold_is_ink(spark):
    """0.299, 0.587 and 0.114 of 128 add up to a little less in floating point."""
    grey = spark.createDataFrame([(1, x, y, *[128 if (x, y) == (5, 5) else 127] * 3) for x, y in itertools.product(range(8), range(8))], "frame_id long, x int, y int, r int, g int, b int")
    box = fr.ink_boxes(grey)
    assert tuple(box.first()) == (1, 4, 4, 3, 3)
    assert fr.signatures(grey, box).first().signature != "empty"
    dark = fr.Settings(bright_text=False, threshold=127)
    assert tuple(fr.ink_boxes(grey, dark).first()) == (1, 0, 0, 8, 8)


def test_histories_are_fused_together():
    """Many rows at once give what each gives alone: slots that open and are taken, ties, missing and foreign evidence."""
    r = np.random.default_rng(3)
    place = lambda k: {"x": float(9 * k + r.integers(-6, 7)), "w": float(r.integers(2, 9)), "char": "abc"[r.integers(3)], "confidence": float(r.random()), "logits": [(c, float(r.integers(1, 4)) / 4) for c in r.permutation(list("abcd"))[: r.integers(4)]]}
    rows = [[place(k) for k in range(r.integers(0, 6))] for _ in range(400)]
    kind = pa.list_(pa.struct([("x", pa.float64()), ("w", pa.float64()), ("char", pa.string()), ("confidence", pa.float64()), ("logits", pa.map_(pa.string(), pa.float64()))]))
    seen = np.array([min(8, i % 37 + 1) for i in range(len(rows))])
    for values in (rows, [*rows[:-1], [place(0) | {"x": float("inf")}]]):
        texts, sure = tracker.fuse_histories(pa.array(values, kind), seen, 20, 8.0)
        for i, text, s in zip(range(20, len(rows)), texts.to_pylist(), sure.to_pylist(), strict=True):
            alone = tracker.fuse_positions([[(p["x"], p["w"], p["char"], dict(p["logits"]), p["confidence"]) for p in f] for f in values[i + 1 - seen[i] : i + 1]], 8.0)
            assert text == ("".join(c for _, c, _ in alone) if alone else None)
            assert s == (sum(c for _, _, c in alone) / len(alone) if alone else None)


def test_streams_go_on_from_batch_to_batch(spark, monkeypatch):
    """The same texts whether a task's rows come in one batch or a few at a time."""
    from glyphlake.plans.frame_queries import readings

    own = lambda: [tuple(x) for x in fr.shown_texts(readings(spark, "/root/testdata/sf0.001"), "user_id", ["ts", "event_id"]).orderBy("event_id").collect()]
    whole = own()
    monkeypatch.setattr(fr, "AT_ONCE", 3)
    assert own() == whole and len({x["source"] for x in fr.shown_texts(readings(spark, "/root/testdata/sf0.001"), "user_id", ["ts", "event_id"]).select("source").collect()}) > 1


def drawn(r, n=120):
    """Random masks as a batch of images: noise, lines of bars, and nothing at all."""
    masks = []
    for i in range(n):
        h, w = int(r.integers(1, 40)), int(r.integers(1, 90))
        mask = r.random((h, w)) < r.choice([0.05, 0.3, 0.6]) if i % 3 else np.zeros((h, w), bool)
        for x in range(1, w - 4, int(r.integers(5, 9))) if i % 3 != 1 else ():
            mask[r.integers(h) :, x : x + int(r.integers(2, 5))] = True
        masks.append(mask)
    # Blue is one less, so that no lightness is a whole number, which rounding could take either way.
    level = [((m * r.integers(130, 256, m.shape))[:, :, None] - m[:, :, None] * np.array([0, 0, 1])).astype(np.uint8) for m in masks]
    return masks, level, [(i, m.shape[1], m.shape[0], v.tobytes()) for i, (m, v) in enumerate(zip(masks, level, strict=True))]


SCHEMA = "image_id long, width int, height int, pixels binary"


def test_images_of_a_batch_together(spark, monkeypatch):
    """Components, sums, masks and characters of many images are those of each alone."""
    from glyphlake.operators import glyphs, sheets, vision
    from glyphlake.operators.segmentation import Bounds

    monkeypatch.setattr(sheets, "PIXELS", 5000)
    masks, level, rows = drawn(np.random.default_rng(4))
    images = spark.createDataFrame(rows, SCHEMA).repartition(2)
    every = sorted(map(tuple, vision.glyphs_of_images(images).collect()))
    assert every == sorted((i, k, *c, vision.normalize_glyph(m[c[1] : c[1] + c[3], c[0] : c[0] + c[2]]).tobytes()) for i, m in enumerate(masks) for k, c in enumerate(vision.components(m)))
    assert {tuple(x) for x in vision.masks_of_images(images).collect()} == {(i, int(m.sum()), int(vision.soft_foreground(v).astype(int).sum())) for i, (m, v) in enumerate(zip(masks, level, strict=True))}
    whole = {x.line_id: (x.x, x.y, x.w, x.h, bytes(x.mask)) for x in vision.masks_of_lines(images).collect()}
    for i, m in enumerate(masks):
        if not m.any():
            assert i not in whole
            continue
        x, y, own = glyphs.tight(0, 0, m)
        assert whole[i] == (x, y, own.shape[1], own.shape[0], own.tobytes())
    for bounds, soft in ((Bounds(height_least=2, width_least=2), False), (Bounds(width_most=30), True)):
        out = sorted(map(tuple, glyphs.character_glyphs(images, bounds=bounds, soft=soft).collect()))
        strength = [vision.soft_foreground(v) for v in level]
        assert out == sorted((i, line, k, x, y, c.shape[1], c.shape[0], vision.normalize_glyph(strength[i][y : y + c.shape[0], x : x + c.shape[1]] if soft else c).tobytes()) for i, m in enumerate(masks) for k, (line, (x, y, c)) in enumerate(glyphs.characters_of(m, bounds)))


def test_candidates_of_a_batch_together(spark):
    """Candidates of many images, with cut components, fonts' frames and soft glyphs, are those of each line alone."""
    from glyphlake import lines
    from glyphlake.operators import glyphs, vision
    from glyphlake.operators.segmentation import Bounds

    masks, level, rows = drawn(np.random.default_rng(6), 60)
    images = spark.createDataFrame(rows, SCHEMA).repartition(2)
    for reading in (lines.Reading(bounds=Bounds(height_least=2, width_least=2), longest=2), lines.Reading(bounds=Bounds(height_least=4), longest=3, spec=glyphs.NormalSpec())):
        want = []
        for i, (m, v) in enumerate(zip(masks, level, strict=True)):
            soft = vision.soft_foreground(v)
            for k, (a, b) in enumerate(vision.find_lines(m, reading.bounds.height_least)):
                if parts := glyphs.component_parts(m[a : b + 1]):
                    want += [(i, i * lines.LINES + k, *row[:-2], row[-2].tolist(), row[-1]) for row in lines.candidates_of_line(parts, reading, soft[a : b + 1])]
        found = [(*x[:-1], bytes(x[-1])) for x in map(tuple, lines.candidates_of_images(images, reading).collect())]
        assert len(want) > 300 and any(x[4] > x[5] for x in want)
        assert sorted(map(str, found)) == sorted(map(str, want))
        assert {x.soft for x in lines.candidates_of_images(images, reading, strong=False).collect()} == {None}


def test_distances_without_pairs(spark):
    """The coarse filter and the evidence of characters in parts of prototypes give what all pairs give; no join makes pairs of glyphs and prototypes."""
    import io
    from contextlib import redirect_stdout

    from glyphlake.operators import distance as ds

    r = np.random.default_rng(8)
    word = lambda: int(r.integers(0, 1 << 62)) & int(r.integers(0, 1 << 62))
    glyphs = [(i, b, b.bit_count()) for i, b in enumerate(word() if i else 0 for i in range(40))]
    protos = [(c, p, 12 + p % 3, p % 4, b, b.bit_count()) for c in range(5) for p in range(30) for b in [word()]]
    g = spark.createDataFrame(glyphs, "glyph_id long, bits long, ink int")
    p = spark.createDataFrame(protos, "char_id int, proto_id long, render_size int, mode int, bits long, ink int")
    wanted = spark.createDataFrame([(i, c) for i in range(40) for c in (i % 5, 9)], "glyph_id long, char_id long")
    near = lambda a, b: abs(a - b) <= int(0.2 * a) + 3
    counts, least = {}, {}
    for i, b, k in glyphs:
        found = [(b ^ x[4]).bit_count() for x in protos if near(k, x[5])]
        if found:
            counts[i], least[i] = len(found), min(found)
    assert 0 not in counts and len(counts) > 30
    for rows in (1000, 40):
        assert {x.glyph_id: x.n for x in ds.coarse_counts(g, p).collect()} == counts
        assert {x.glyph_id: x.distance for x in ds.coarse_minimum(g, p, rows).collect()} == least
        out = {(x.glyph_id, x.char_id): x for x in ds.char_evidence(wanted, g, p, 64, rows).collect()}
        assert len(out) == 80
        for (i, c), x in out.items():
            own = [((glyphs[i][1] ^ q[4]).bit_count(), q[1], "clean" if q[3] == 2 else f"{q[2]}_{q[3]}", near(glyphs[i][2], q[5])) for q in protos if q[0] == c]
            states = {}
            for d, _, s, _ in own:
                states[s] = max(states.get(s, -9), 1 - d / 64)
            assert (x.distance, x.proto_id, x.coarse_hit, x.states or {}) == ((*min(own)[:2], any(q[3] for q in own), states) if own else (64, -1, False, {}))
    text = io.StringIO()
    with redirect_stdout(text):
        ds.char_evidence(wanted, g, p, 64).explain()
    assert "bitcount" not in text.getvalue().lower().replace("_", "")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_candidates_need_one_shuffle(spark, sf_dir):
    """Ranges with the fields of their first atom come from one sort by line; parts of a range move their line once."""
    from glyphlake.operators import merges
    from glyphlake.operators import segmentation as sg
    from glyphlake.plans import catalogue, segmentation_queries  # noqa: F401
    from glyphlake.plans.carriers import scored_candidates

    plan = plan_of(scored_candidates(spark, sf_dir))
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    own = segmentation_queries.atoms(spark, sf_dir)
    plan = plan_of(merges.one_cluster(sg.candidate_parts(own, 3), own))
    assert plan.count("Exchange hashpartitioning") <= 2 and plan.count("Join") == 1


def test_spans_without_objects():
    from glyphlake.operators import decode

    kind = pa.list_(pa.struct([("end", pa.int32()), ("start", pa.int32()), ("score", pa.float64())]))
    rows = [[], [{"end": 1, "start": 0, "score": 0.5}, {"end": 2, "start": 1, "score": 0.25}], [{"end": 1, "start": 0, "score": 1.0}]]
    assert list(decode.spans_of(pa.array(rows, kind))) == [([], [], []), ([0, 1], [1, 2], [0.5, 0.25]), ([0], [1], [1.0])]


def test_pieces_at_valleys_are_slices(monkeypatch):
    """Cuts at valleys give the ink between them, without a mask of the whole for each piece."""
    from glyphlake.operators import merges

    mask = np.zeros((10, 40), bool)
    for x in (0, 9, 20, 31):
        mask[x // 9 :, x : x + 7] = True
    cuts = merges.valley_cuts(mask, 8.0, merges.Bounds(), 3)
    want = []
    for own in merges.slices(mask, [np.full(10, x) for x in cuts]):
        rows, columns = np.flatnonzero(own.any(1)), np.flatnonzero(own.any(0))
        want.append((int(columns[0]), int(rows[0]), own[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1]))
    monkeypatch.delattr(merges, "slices")
    found = merges.pieces(mask, 8.0, 3)
    assert cuts and len(found) == len(want) > 1
    assert all(a[:2] == b[:2] and np.array_equal(a[2], b[2]) for a, b in zip(found, want, strict=True))


def test_components_get_partitions_by_size(spark, monkeypatch):
    """Shuffles of larger edges have more partitions; the session's own setting comes back."""
    from glyphlake.operators import lattice

    seen, written = [], lattice.written
    monkeypatch.setattr(lattice, "written", lambda df, name: (seen.append(int(spark.conf.get("spark.sql.shuffle.partitions"))), written(df, name))[1])
    monkeypatch.setattr(lattice, "PART_BYTES", 100, raising=False)
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert {tuple(x) for x in lattice.connected_components(edges).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}
    assert set(seen) != {int(before)} and min(seen) > int(before) and spark.conf.get("spark.sql.shuffle.partitions") == before
