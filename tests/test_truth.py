"""Ground truth, samples, and matching by glyphs, against definitions."""

import itertools
import random

import numpy as np
import pytest

from glyphlake.operators import resolve, truth
from glyphlake.operators.glyphs import component_parts
from glyphlake.sources import lists, samples


def test_ink_coverage(spark):
    r = random.Random(3)
    pixels = sorted({(1, r.randrange(4), r.randrange(90), r.randrange(9)) for _ in range(300)})
    boxes = [(1, k, x, y, x + r.randrange(1, 50), y + r.randrange(1, 9)) for k in range(8) for x, y in [(r.randrange(60), r.randrange(6))]] + [(2, 0, 0, 0, 9, 9)]
    out = {(x.seg_id, x.box_id): x for x in truth.ink_coverage(spark.createDataFrame(pixels, "line_id long, seg_id int, x int, y int"), spark.createDataFrame(boxes, "line_id long, box_id int, x0 int, y0 int, x1 int, y1 int")).collect()}
    for (_, b, x0, y0, x1, y1), s in itertools.product(boxes[:-1], range(4)):
        inside = [p for p in pixels if x0 <= p[2] < x1 and y0 <= p[3] < y1]
        own = [p for p in inside if p[1] == s]
        if not own:
            assert (s, b) not in out
            continue
        total, ink = sum(p[1] == s for p in pixels), len({p[2:] for p in inside})
        assert out[s, b].inside == len(own) and out[s, b].atom_coverage == pytest.approx(len(own) / total) and out[s, b].coverage == pytest.approx(min(len(own) / total, len(own) / ink))


def test_glued_characters():
    a, b = np.ones((12, 5), bool), np.ones((8, 4), bool)
    full, left, right = truth.glue(np.pad(a, 2), b)
    assert full.shape == (12, 9) and left == (0, 0, 5, 12) and right == (5, 4, 9, 12) and len(component_parts(full)) == 1
    apart, _, right = truth.glue(a, b, "none")
    assert apart.shape == (12, 10) and right[0] == 6 and len(component_parts(apart)) == 2
    row = truth.glue(a, b, "row")[0]
    assert len(component_parts(row)) == 1 and row[:, 5].sum() == 1
    with pytest.raises(ValueError):
        truth.glue(a, b, "x")
    with pytest.raises(ValueError):
        truth.glue(np.array([[1, 1], [1, 0], [1, 0], [1, 0], [1, 0], [1, 0], [1, 0], [1, 0]], bool), np.array([[0, 1]] * 7 + [[1, 1]], bool), "row")


def test_spelled_paths(spark):
    r = random.Random(1)
    for _ in range(40):
        spans = [(a, a + n, {c: round(r.random(), 2) for c in r.sample("abc", 2)}) for a in range(4) for n in (1, 2) if a + n <= 4]
        text = "".join(r.choice("abc") for _ in range(r.randrange(1, 5)))
        tilings = [t for k in range(1, 5) for t in itertools.permutations(range(len(spans)), k) if spans[t[0]][0] == 0 and spans[t[-1]][1] == 4 and all(spans[i][1] == spans[j][0] for i, j in zip(t, t[1:])) and k == len(text)]
        value = lambda t: sum(spans[i][2].get(c, -2.0) for i, c in zip(t, text))  # noqa: E731, B023
        found = truth.spelled_path(spans, text)
        assert (found is None) == (not tilings) and (not tilings or value(found) == pytest.approx(max(map(value, tilings))))
    options = spark.createDataFrame([(1, 0, 1, "a", 0.9), (1, 1, 2, "b", 0.8), (1, 0, 2, "w", 0.7), (2, 0, 1, "a", 0.5)], "line_id long, start int, end int, char string, visual double")
    out = {x.line_id: (x.path, x.recalled) for x in truth.spelled_paths(options, spark.createDataFrame([(1, "ab"), (2, "ab")], "line_id long, text string")).collect()}
    assert out == {1: ("0-1,1-2", True), 2: (None, False)}
    assert truth.report_text(0.5, 2, [{"text": "ab", "recalled": True, "status": "ok"}, {"text": "c", "recalled": False, "status": "lost", "reason": "cut"}]).splitlines()[:2] == ["lattice recall 50.0% of 2", "status lost 1, ok 1"]


def test_samples(spark, tmp_path):
    r = np.random.default_rng(1)
    x = r.integers(0, 255, (4, 24, 24)).astype(np.uint8)
    np.savez(tmp_path / "s.npz", x=x, y=np.array([1, 0, 1, 1]), chars=np.array(["a", "b"]), font_sha256=np.array("f"))
    out = samples.read_samples(spark, str(tmp_path / "s.npz")).collect()
    assert [s.label for s in out] == ["b", "a", "b", "b"] and out[0].glyph == x[0].tobytes() and {(s.font_sha256, s.input_mode) for s in out} == {("f", "binary")}
    mask = r.random((6, 9)) < 0.5
    assert samples.scaled(mask, 2.0).shape == (12, 18) and (samples.scaled(mask, 2.0)[::2, ::2] == mask).all()
    flat = np.full((5, 7), 90, np.uint8)
    assert (samples.scaled_soft(flat, 1.7) == 90).all() and samples.scaled_soft(x[0], 1.0).tolist() == x[0].tolist() and samples.scaled_soft(x[0], 0.5).shape == (12, 12)
    moved = samples.shifted(x[0], 2, -3)
    assert (moved[:-3, 2:] == x[0][3:, :-2]).all() and moved[-3:].sum() == 0 and moved[:, :2].sum() == 0 and (samples.shifted(x[0], 0, 0) == x[0]).all()
    line = np.ones((4, 20), bool)
    line[:, 5:7] = line[:, 12:16] = False
    assert samples.character_boxes(line, 2) == [(0, 14), (14, 20)] and samples.character_boxes(line, 3) == [(0, 6), (6, 14), (14, 20)]
    assert samples.character_boxes(np.ones((4, 9), bool), 2, [0, 4]) == [(0, 4), (4, 9)]
    with pytest.raises(ValueError):
        samples.character_boxes(np.ones((4, 9), bool), 2)
    screen = np.zeros((30, 40, 3), np.uint8)
    screen[10:12, 20:25] = 255
    assert samples.inked_crop(screen, (15, 5, 39, 29), 128, 1).shape == (4, 7, 3)
    with pytest.raises(ValueError):
        samples.inked_crop(screen, (0, 0, 5, 5), 128, 1)
    w, g, b, m, v = r.normal(size=(3, 2, 3, 3)), *r.normal(size=(3, 3)), r.uniform(0.5, 2, 3)
    weight, bias = samples.folded(w, g, b, m, v)
    patch = r.normal(size=(2, 3, 3))
    assert np.allclose((weight * patch).sum((1, 2, 3)) + bias, g * ((w * patch).sum((1, 2, 3)) - m) / np.sqrt(v + 1e-5) + b)


def test_matching_by_glyphs(spark):
    """Misread places are told by their glyphs; two terms that fit alike are left open."""
    r = np.random.default_rng(2)
    shapes = {c: r.normal(size=16) for c in "ABCDX"}
    bank = spark.createDataFrame([(c, v.tolist()) for c, v in shapes.items()], "ch string, vec array<double>")
    seen = {1: ("AXC", "ABC"), 2: ("AXX", "ABB")}
    glyphs = spark.createDataFrame([(i, k, (shapes[c] * 2 + 1).tolist()) for i, (_, true) in seen.items() for k, c in enumerate(true)], "text_id long, pos int, vec array<double>")
    own = spark.createDataFrame([(i, t) for i, (t, _) in seen.items()], "text_id long, text string")
    out = {x.text_id: x for x in resolve.ncc_assoc_match(own, glyphs, bank, lists.lexicon_from_terms(spark, "t", ["ABC", "DDD"])).collect()}
    assert out[1].term == "ABC" and (out[1].span_start, out[1].span_end) == (0, 3) and 0.9 < out[1].score <= 1.0
    assert resolve.ncc_assoc_match(own.where("text_id = 2"), glyphs, bank, lists.lexicon_from_terms(spark, "t", ["ABBC", "ABBD"])).collect() == []
