"""Hand-computed values of single operators."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphlake.functions import scoring, text
from glyphlake.operators import decode, lattice, lexicon, probability, ranking, resolve, vision
from glyphlake.plans.catalogue import QUERIES
from glyphlake.sources import lists, models
from glyphlake.streaming import tracker


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("seen", "kind", "score", "span"),
    [("ABCDEF", "exact", 1.0, (0, 6)), ("ABCDE", "prefix_crop", 0.92, (0, 5)), ("BCDEF", "suffix_crop", 0.92, (1, 6)), ("BCDE", "inner_crop", 0.80, (1, 5)), ("BCE", "gap_crop", 0.53, (1, 5)), ("BDF", "gap_crop", 0.46, (1, 6)), ("BF", "gap_crop", 0.34, (1, 6)), ("xABCDEF", "term_in_text", 0.97, (0, 6)), ("XYZ", None, None, None), ("BA", None, None, None), ("ACEB", None, None, None), ("ABXDEF", None, None, None), ("", None, None, None)],
)
def test_match(spark, seen, kind, score, span):
    lex = lists.lexicon_from_terms(spark, "t", ["ABCDEF"])
    out = lexicon.match_all(spark.createDataFrame([(1, seen)], "text_id long, text string"), lex).collect()
    assert [(r.kind, round(r.score, 9), (r.span_start, r.span_end)) for r in out] == ([(kind, score, span)] if kind else [])


def test_lexicon_from_lines_and_best(spark, tmp_path):
    (tmp_path / "w.txt").write_text("Alpha\nBeta\n\nAl pha　\nBeta\n", encoding="utf-8")
    lex = lists.read_terms(spark, str(tmp_path / "w.txt"), "w")
    assert [r.term for r in lex.orderBy("ord").collect()] == ["Alpha", "Beta"]
    assert lexicon.charset(lex, "term").first().charset == "ABaehlpt"
    two = lists.lexicon_from_terms(spark, "t", ["ABCDEF", "ABCD"])
    best = lexicon.best_match(lexicon.match_all(spark.createDataFrame([(1, "ABC")], "text_id long, text string"), two)).first()
    assert (best.term, best.kind) == ("ABCD", "prefix_crop")
    (tmp_path / "c.txt").write_text("# head\nab c\n\nd\n")
    assert [(r.char_id, r.ch) for r in lists.read_charset(spark, str(tmp_path / "c.txt")).orderBy("char_id").collect()] == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]


def test_tolerant_json(spark, tmp_path):
    (tmp_path / "u.json").write_text('{"sequence": [{"t": "a 1: b", 7: "x"}, {"t": "", 7: "y"}, {"t": "c", 7: "x"}]}')
    data = lists.read_tolerant_json(spark, str(tmp_path / "u.json"), "sequence array<struct<t:string,`7`:string>>")
    assert sorted(r.text for r in lists.field_texts(data, "t").collect()) == ["a 1: b", "c"]
    assert sorted(r.text for r in lists.field_texts(data, "7").collect()) == ["x", "y"]


def reading(spark, seen, conf, alts):
    rows = [(1, seen, [(c, k, a) for c, k, a in zip(seen, conf, alts, strict=True)])]
    return spark.createDataFrame(rows, "text_id long, text string, chars array<struct<ch:string,conf:double,alts:array<string>>>")


@pytest.mark.parametrize(
    ("terms", "conf", "alts", "out"),
    [(["AC"], (1.0, 1.0), ["A", "CB"], "AB"), (["AC"], (1.0, 0.6), ["A", "CB"], "AC"), (["AC"], (1.0, 0.6), ["A", "B"], "AB"), (["AC", "CB"], (0.5, 0.52), ["AC", "BC"], "AB")],
)
def test_prefer(spark, terms, conf, alts, out):
    own = reading(spark, "AB", conf, [list(a) for a in alts])
    assert resolve.dispatch(own, lists.lexicon_from_terms(spark, "t", terms), ["prefer"]).first().resolved == out


def test_associate(spark):
    """Pinned readings: whole, with a dropped character, unclear between two, unknown, and by an alternative."""
    cases = [("AB", ["A", "B"], ["AB", "ABC"], "AB"), ("A*B", ["A", "*", "B"], ["AB"], "AB"), ("ABC", ["A", "B", "C"], ["ABCD", "ABCE"], None), ("XY", ["X", "Y"], ["AB"], None), ("A8", ["A", "8B"], ["AB"], "AB")]
    for text, alts, terms, term in cases:
        own = spark.createDataFrame([(1, text, [{"ch": a[0], "conf": 1.0, "alts": list(a)} for a in alts])], "text_id long, text string, chars array<struct<ch:string,conf:double,alts:array<string>>>")
        found = resolve.assoc_match(own, lists.lexicon_from_terms(spark, "t", terms)).collect()
        assert [r.term for r in found] == ([term] if term else []), text
        if text == "AB":
            assert (found[0].span_start, found[0].span_end) == (0, 2)



def test_scalar_functions(spark):
    assert one(spark, text.normalize_text(F.lit("a 　\x1cb "))) == "ab"
    assert one(spark, text.strip_color_codes(F.lit("^C12345678ab^C1234567890abcdefc"))) == "abc"
    for a, b, v in (("abc", "abd", 1 / 3), ("", "abc", 1), ("", "", 0), ("ab", "a", 0.5)):
        assert one(spark, text.sequence_cer(F.lit(a), F.lit(b))) == pytest.approx(v)
    points = [(0, 0), (0.5, 0.4), (0.75, 0.9), (1, 1)]
    assert one(spark, scoring.calibrate_monotone(F.lit(0.5), points)) == pytest.approx(0.4)
    assert one(spark, scoring.calibrate_monotone(F.lit(0.625), points)) == pytest.approx(0.65)
    for bad in ([(0, 1), (1, 0)], [(0, 0), (0, 1)]):
        with pytest.raises(ValueError):
            scoring.piecewise(F.lit(0.5), bad)
    for bad in (0, -1, math.nan, math.inf):
        with pytest.raises(ValueError):
            scoring.temperature_scale(F.lit(1.0), bad)
    assert one(spark, scoring.unified_visual_score(F.lit(0.8), F.lit(0.6), F.lit(-0.1), 0.5, 0.3, 0.2)) == pytest.approx(0.52)
    vec = F.array(*(F.lit(float(x)) for x in (1, 2, 5)))
    assert one(spark, scoring.ncc(vec, F.transform(vec, lambda x: 3 * x + 1))) == pytest.approx(1)
    assert one(spark, scoring.ncc(vec, F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0)))) == 0
    assert one(spark, F.array_join(scoring.normalize_features(F.array(F.lit(9.0), F.lit(1.0)), [1, 1], [1, 0]), ",")) == "4.0,0.0"


def test_probability(spark):
    inf = float("inf")
    rows = [("a", 0.0), ("a", 0.0), ("b", 1000.0), ("b", 1000.0), ("c", 1.0), ("c", -inf), ("d", -inf), ("d", -inf)]
    out = {r.k: r.lse for r in probability.logsumexp_group(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    assert out["a"] == pytest.approx(math.log(2)) and out["b"] == pytest.approx(1000 + math.log(2)) and out["c"] == 1 and out["d"] == -inf
    pred = spark.createDataFrame([(0, 0.9, True), (1, 0.2, False), (2, 0.7, True), (3, 0.55, True), (4, 0.95, True)], "id long, confidence double, correct boolean")
    m = probability.calibration_metrics(pred).first()
    assert (m.n, m.accuracy, round(m.brier, 9), round(m.ece, 9)) == (5, 0.8, 0.069, 0.22)
    counts = probability.char_counts(lists.lexicon_from_terms(spark, "t", ["ABC", "ABD", "A"]))
    assert {r.ch: r.n for r in counts.collect()} == {"A": 3, "B": 2, "C": 1, "D": 1}
    votes = spark.createDataFrame([(1, "12_1", 9), (1, "14_0", 3), (1, "15_1", 1)], "line long, state string, votes long")
    assert {r.state for r in probability.select_states(votes, "line", 2).collect()} == {"12_1", "14_0", "clean"}
    scores = spark.createDataFrame([(1, "12_1", -5.0), (1, "14_0", -3.0), (1, "clean", -8.0)], "line long, state string, score double")
    r = probability.marginalize(scores, ["line"]).first()
    assert r.state == "14_0" and r.marginal == pytest.approx(math.log(sum(map(math.exp, (-3, -5, -8)))))
    assert probability.marginalize(scores, ["line"], use_max=True).first().marginal == -3


def test_ranking_single_class(spark):
    own = spark.createDataFrame([(1, 5, 2.0)], "glyph_id long, char_id int, logit double")
    assert ranking.top2_margin(own).first().second_id == -1
    names = spark.createDataFrame([(5, "e")], "char_id int, ch string")
    assert tuple(ranking.pick(own, names).first()) == (1, "e", 1.0)
    assert tuple(ranking.pick(own, names, spark.createDataFrame([(9,)], "char_id int")).first()) == (1, "?", 0.0)


def test_paths_equal_search():
    r = np.random.default_rng(0)
    for _ in range(60):
        n = int(r.integers(1, 7))
        cand = [(a, b, float(r.random()), f"{a}{b};") for a in range(n) for b in range(a + 1, min(n, a + 3) + 1)]
        every = []
        for k in range(1, n + 1):
            for inner in itertools.combinations(range(1, n), k - 1):
                cuts = [0, *inner, n]
                picks = [next((i for i, c in enumerate(cand) if c[:2] == (a, b)), None) for a, b in zip(cuts, cuts[1:], strict=False)]
                if None not in picks:
                    every.append((sum(cand[i][2] for i in picks), tuple(picks)))
        best = decode.kbest_paths(cand, len(every), 1.0, 0.0)
        assert len(best) == len(every)
        assert best[0][0] / len(best[0][1]) == pytest.approx(max(s / len(p) for s, p in every))
        path, mean = decode.mean_path([c[:3] for c in cand])
        assert (sum(cand[i][2] for i in path) / len(path)) == pytest.approx(mean) and cand[path[-1]][1] == n
    assert decode.mean_path([(0, 1, 0.5), (1, 2, 0.5), (0, 2, 0.5)]) == ([2], 0.5)  # a tie takes fewer candidates


def test_path_score(spark):
    rows = [(1, 1, 0.8, -0.02, 0.0, 0.3), (1, 1, 0.6, -0.04, 0.0, 0.3)]
    own = spark.createDataFrame(rows, "line_id long, path_id long, visual double, geometry double, lexicon double, prior double")
    out = lattice.path_scores(own, 1, 2, 0.5, 0.3, 0.1).first()
    assert out.score == pytest.approx(0.7 - 0.06 + 0.09 - 0.1)


def test_components_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    out = {r.node: r.component for r in lattice.connected_components(edges).collect()}
    assert all(out[i] == 0 for i in range(41)) and out[101] == 100


def brute_components(edges):
    at = {}

    def root(x):
        while at.setdefault(x, x) != x:
            x = at[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        at[b] = a
    return {x: root(x) for x in at}


def test_components_take_every_line(spark, sf_dir, tmp_path):
    """Ten separate blocks, then the smallest tables."""
    rng = np.random.default_rng(3)
    lines = [(int(s), int(p)) for k in range(10) for s, p in zip(rng.integers(k * 9, k * 9 + 9, 12), rng.integers(k * 30, k * 30 + 30, 12), strict=True)]
    spark.createDataFrame([(*x, 1.0, 0.0, 0.0) for x in lines], "l_suppkey long, l_partkey long, l_quantity double, l_discount double, l_tax double").write.parquet(str(tmp_path / "lineitem.parquet"))
    for folder in (str(tmp_path), sf_dir):
        rows = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_suppkey", "l_partkey").collect()
        out = {r.node: r.component for r in QUERIES["connected_components"](spark, folder).collect()}
        assert out == brute_components([(2 * r.l_suppkey, 2 * r.l_partkey + 1) for r in rows])
        assert folder == sf_dir or len(set(out.values())) >= 10


def test_tracker_rules():
    t = tracker.Track()
    assert [t.update(s, "x")[0] for s in ("f1", "f2", "f2")] == [False, True, False]
    t = tracker.Track()
    assert [t.update("s", x)[1] for x in ("good", "bad", "good")] == [None, None, "good"]
    fused = tracker.fuse_positions([[(0, 10, "尔", {"尔": 0.9, "你": 0.8}, 0.9)], [(2, 10, "你", {"你": 0.95, "尔": 0.94}, 0.9)]])
    assert [c for _, c, _ in fused] == ["尔"]


def test_vision():
    image = np.zeros((20, 30, 3), np.uint8)
    image[2:12, 3:6] = 255
    image[4:12, 10:18] = 200
    image[5:7, 12:16] = 0
    mask = vision.foreground(image)
    assert vision.components(mask) == [(3, 2, 3, 10, 30), (10, 4, 8, 8, 56)]
    assert vision.find_lines(mask, 6) == [(2, 19)]
    glyph = vision.normalize_glyph(mask[2:12, 3:6])
    assert glyph.shape == (24, 24) and set(np.unique(glyph)) == {0, 255} and glyph.any(1).sum() == 19
    assert (vision.soft_foreground(image)[3, 4], vision.soft_foreground(image)[0, 0]) == (255, 0) or vision.soft_foreground(image)[3, 4] == 254
    white = vision.foreground(image, hsl=(0.9, 0.2))
    assert white.sum() == 30


def test_network_and_files(spark, tmp_path):
    r = np.random.default_rng(1)
    weights = {n: r.normal(size=s).astype(np.float32) for n, s in models.tensor_shapes(7)}
    place = f"file://{tmp_path}/w.bin"
    models.write_weights(spark, place, weights, 7)
    again = models.read_weights(spark, place, 7)
    assert all((again[n] == weights[n]).all() for n in weights)
    x = r.integers(0, 255, (3, 24, 24)).astype(np.uint8)
    assert vision.forward(x, again).shape == (3, 7)
    tile = r.normal(size=(1, 2, 5, 5))
    w, b = r.normal(size=(3, 2, 3, 3)), r.normal(size=3)
    slow = np.array([[(np.pad(tile, ((0, 0), (0, 0), (1, 1), (1, 1)))[0, :, i : i + 3, j : j + 3] * w[1]).sum() + b[1] for j in range(5)] for i in range(5)])
    assert np.allclose(vision.conv3x3(tile, w, b)[0, 1], slow)
    protos = spark.createDataFrame([(c, p, 12, 1, 0, p, [int(v) for v in r.integers(-(2**62), 2**62, 9)]) for c in range(4) for p in range(2)], models.PROTOTYPE)
    models.write_templates(protos, f"file://{tmp_path}/t.bin")
    back = models.read_templates(spark, f"file://{tmp_path}/t.bin")
    assert sorted(map(str, back.collect())) == sorted(map(str, protos.collect()))
    with pytest.raises(ValueError):
        models.parse_templates(b"x" * 40)
    entries = spark.createDataFrame([(0, 10.0, 5.0, 9.0, 0.5, 20, 1, 8.0, 0.8, 0.4), (1, 10.0, 9.0, 9.0, 1.0, 40, 2, 8.0, 0.8, 0.5)], models.GEOMETRY.split("struct<")[1].rstrip(">").replace(":", " "))
    models.write_geometry(entries, f"file://{tmp_path}/g.json")
    stats = {s.narrow: s.width_ratio for s in models.geometry_classes(models.read_geometry(spark, f"file://{tmp_path}/g.json")).collect()}
    assert stats == {True: 0.5, False: 0.9}


def test_banks_and_datasets(spark, tmp_path):
    np.savez(tmp_path / "b.npz", labels=np.array(["a", "b", "a"]), data=np.arange(12, dtype=np.float32).reshape(3, 2, 2))
    out = sorted((r.char, r.proto_id, r.vec) for r in models.read_glyph_bank(spark, f"file://{tmp_path}/b.npz").collect())
    assert out == [("a", 0, [0, 1, 2, 3]), ("a", 1, [8, 9, 10, 11]), ("b", 0, [4, 5, 6, 7])]
    one_font = spark.createDataFrame([("x", "f"), ("y", "f")], "label string, font_sha256 string")
    more = spark.createDataFrame([("y", "f"), ("a", "f")], "label string, font_sha256 string")
    assert {(r.label, r.char_id) for r in models.union_datasets([one_font, more]).collect()} == {("x", 0), ("y", 1), ("a", 2)}
    with pytest.raises(ValueError):
        models.union_datasets([one_font, spark.createDataFrame([("y", "g")], "label string, font_sha256 string")])
