import numpy as np
import pytest

from glyphlake.engine import Engine, prototypes_of
from glyphlake.operators import segmentation as sg
from glyphlake.sources.lists import lexicon_from_terms

SHAPES = {"L": ["#...", "#...", "#...", "####"], "T": ["####", ".#..", ".#..", ".#.."], "O": ["####", "#..#", "#..#", "####"], "I": ["#", "#", "#", "#"]}


def picture(text):
    parts = []
    for c in text:
        shape = np.array([[x == "#" for x in row] for row in SHAPES[c]])
        parts += [np.kron(shape, np.ones((3, 3), bool)), np.zeros((12, 2), bool)]
    mask = np.pad(np.concatenate(parts, 1), 2)
    return mask.shape[1], mask.shape[0], (np.repeat(mask[:, :, None], 3, 2) * 255).astype(np.uint8).tobytes()


def test_engine_reads_and_resolves(spark):
    schema = "image_id long, width int, height int, pixels binary"
    single = spark.createDataFrame([(i, *picture(c)) for i, c in enumerate(SHAPES)], schema)
    names = spark.createDataFrame([(i, i) for i in range(4)], "image_id long, char_id int")
    charset = spark.createDataFrame(list(enumerate(SHAPES)), "char_id int, ch string")
    lex = lexicon_from_terms(spark, "t", ["LOT", "TOIL"])
    engine = Engine(spark, prototypes_of(single, names), charset, lex)
    images = spark.createDataFrame([(10, *picture("LOT")), (11, *picture("TOIL")), (12, *picture("OIL"))], schema)
    out = {r.text_id: r for r in engine.recognize(images).collect()}
    assert [out[i].text for i in (10, 11, 12)] == ["LOT", "TOIL", "OIL"]
    assert out[10].matched_term == "LOT" and out[12].matched_term == "TOIL" and out[12].resolved == "OIL"
    assert {r.resolved for r in engine.recognize(images, "strict").collect()} == {"LOT", "TOIL", ""}
    assert {r.matched_term for r in engine.recognize(images, "dict").collect()} >= {"LOT", "TOIL"}
    with pytest.raises(ValueError):
        Engine(spark, single, charset).recognize(images, "strict")


def test_cuts():
    mask = np.ones((10, 21), bool)
    mask[:, 10] = False
    assert sg.valley_cuts(mask, 10) == [10]
    assert sg.valley_cuts(np.ones((10, 21), bool), 10) == []
    path, cost = sg.seam_cut(mask, 10.0)
    assert (path == 10).all() and cost == 0
    slanted = np.ones((4, 12), bool)
    for y, x in enumerate((5, 6, 7, 6)):
        slanted[y, x] = False
    path, cost = sg.seam_cut(slanted, 6.0)
    assert path.tolist() == [5, 6, 7, 6] and cost == pytest.approx(0.4)
    assert sg.seam_cut(np.ones((1, 9), bool), 4.0) is None


def test_ranker_learns(spark):
    from glyphlake.operators.ranker import pair_differences, train_ranker

    r = np.random.default_rng(2)
    rows = []
    for c in range(200):
        for k in range(4):
            rows.append((c, k == 0, [float(x) for x in (r.normal() + 2 * (k == 0), r.normal(), r.normal() - (k == 0))]))
    w = train_ranker(pair_differences(spark.createDataFrame(rows, "cand_id long, right boolean, features array<double>")), 3)
    assert w[0] > 0.5 > abs(w[1]) and w[2] < -0.2


def test_lines_through_the_lattice(spark):
    """Templates alone, with a lexicon, and with a network; the joined shapes are told apart."""
    from glyphlake import lines
    from glyphlake.operators.vision import Ink

    schema = "image_id long, width int, height int, pixels binary"
    single = spark.createDataFrame([(i, *picture(c)) for i, c in enumerate(SHAPES)], schema)
    names = spark.createDataFrame([(i, i) for i in range(4)], "image_id long, char_id int")
    charset = spark.createDataFrame(list(enumerate(SHAPES)), "char_id int, ch string")
    images = spark.createDataFrame([(10, *picture("LOT")), (11, *picture("TOIL"))], schema)
    reading = lines.Reading(Ink(), sg.Bounds(width_least=2))
    protos = prototypes_of(single, names)
    out = {r.image_id: r.text for r in lines.read_images(images, protos, charset, reading=reading).collect()}
    assert out == {10: "LOT", 11: "TOIL"}
    lex = lexicon_from_terms(spark, "t", ["LOT", "TOIL"])
    found = {r.image_id: r for r in lines.read_lines(images, protos, charset, lex, reading).collect()}
    assert {i: r.text for i, r in found.items()} == out and found[10].line == 0 and found[10].confidence > 0.9
    assert {r.text for r in lines.read_lines(images, protos, charset, lex, reading, allowed=charset.where("ch <> 'O'")).collect()}.isdisjoint({"LOT", "TOIL"})
    r = np.random.default_rng(1)
    shapes = {"conv1_w": (8, 1, 3, 3), "conv1_b": (8,), "dw1_w": (8, 3, 3), "dw1_b": (8,), "pw1_w": (8, 8), "pw1_b": (8,), "dw2_w": (8, 3, 3), "dw2_b": (8,), "pw2_w": (8, 8), "pw2_b": (8,), "fc_w": (4, 8), "fc_b": (4,)}
    weights = {k: r.normal(size=s).astype(np.float32) for k, s in shapes.items()}
    assert {x.image_id: x.text for x in lines.read_images(images, protos, charset, lex, reading, weights=weights).collect()} == out  # trusted templates stay first


def test_characters_of_masks(spark):
    from glyphlake.operators import glyphs
    from glyphlake.operators.vision import components

    r = np.random.default_rng(5)
    for _ in range(20):
        mask = r.random((9, 14)) < 0.45
        parts = glyphs.component_parts(mask)
        assert [(x, y, m.shape[1], m.shape[0], int(m.sum())) for x, y, m in parts] == components(mask)
        whole = np.zeros_like(mask)
        for x, y, m in parts:
            whole[y : y + m.shape[0], x : x + m.shape[1]] |= m
        assert (whole == mask).all()
    dot, bar, far = (2, 0, np.ones((2, 2), bool)), (2, 4, np.ones((8, 2), bool)), (20, 0, np.ones((12, 3), bool))
    assert [(x, y, m.shape) for x, y, m in glyphs.merge_fragments([dot, bar, far])] == [(2, 0, (12, 2)), (20, 0, (12, 3))] and glyphs.merge_fragments([]) == []
    wide = np.ones((10, 90), bool)
    wide[:, 40:46] = False
    assert [(x, m.shape[1]) for x, _, m in glyphs.split_wide([(0, 0, wide)])] == [(0, 40), (46, 44)] and len(glyphs.split_wide([far])) == 1
    patch = r.random((5, 7))
    smooth = glyphs.resize_smooth(patch)
    assert smooth.shape == (24, 24) and smooth[0, 0] == pytest.approx(patch[0, 0]) and smooth[-1, -1] == pytest.approx(patch[-1, -1]) and patch.min() - 1e-6 <= smooth.min() <= smooth.max() <= patch.max() + 1e-6
    assert glyphs.NormalSpec.from_dict(None) is None and glyphs.NormalSpec.from_dict({"baseline_row": 20, "other": 1}).to_dict()["baseline_row"] == 20
    spec = glyphs.spec_of_outlines(spark.createDataFrame([(0.0, -90.0, 950.0, 850.0), (0.0, -70.0, 900.0, 830.0), (0.0, 0.0, 400.0, 700.0)], "x0 double, y0 double, x1 double, y1 double"))
    assert (spec.cjk_height_ratio, spec.cjk_width_ratio, spec.cjk_baseline_offset_ratio, spec.latin_tall_ratio) == pytest.approx((0.92, 0.925, 0.08, 0.7)) and spec.baseline_row == 18
    images = spark.createDataFrame([(1, *picture("LOT"))], "image_id long, width int, height int, pixels binary")
    assert glyphs.character_glyphs(images).count() == 3 and glyphs.character_glyphs(images, soft=True).first().w > 0


def test_position_alternatives(spark):
    from glyphlake.operators import resolve

    own = spark.createDataFrame([(1, "AB", [{"ch": "A", "conf": 1.0, "alts": ["A", "X"]}, {"ch": "B", "conf": 0.5, "alts": ["Q"]}])], "text_id long, text string, chars array<struct<ch:string,conf:double,alts:array<string>>>")
    alts = spark.createDataFrame([(1, 0, "ZB"), (1, 1, "long")], "text_id long, rank int, alt string")
    out = resolve.position_alternatives(own, alts).first()
    assert out.lists == [["A", "X", "Z"], ["Q", "B"]] and out.sets == [["A", "X", "Z"], ["B", "Q"]]
    assert resolve.position_alternatives(own, alts.limit(0)).first().lists[1] == ["B", "Q"]
    assert resolve.substitutions(own).first().alternatives == ["XB"]
