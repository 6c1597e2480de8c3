"""Decoding, merges and frames against brute force and hand-made cases."""

import itertools
import math
import random

import numpy as np
import pytest

from glyphlake.operators import domain_prior, merges, vision
from glyphlake.operators.lexicon_decode import Option, Terms, Weights, best_path, decode_lattice, ranked_paths, relevant_terms, text_of, with_unknowns
from glyphlake.operators.segmentation import Bounds
from glyphlake.sources import lists
from glyphlake.streaming import frames as fr


def random_options(r, places=5):
    spans = [(a, b) for a in range(places) for b in (a + 1, a + 2) if b <= places and (b == a + 1 or r.random() < 0.6)]
    return [Option(a, b, c, round(r.uniform(0.2, 1.0), 3), -round(r.uniform(0, 0.05), 3), 0.35 + 0.1 * r.randrange(6)) for a, b in spans for c in r.sample("abcd", r.randrange(1, 4))]


def all_paths(options, end, at=0):
    if at == end:
        yield ()
    for o in options:
        if o.start == at:
            for rest in all_paths(options, end, o.end):
                yield (o, *rest)


def plain_total(path, terms):
    """The score by its definition, with the lexicon's score by kinds of containment."""
    n, visual = len(path), sum(o.visual for o in path) / len(path)
    text, best = text_of(path), 0.0
    for t in terms:
        if text == t:
            best = max(best, 1.0)
        elif t in text:
            best = max(best, 0.97)
        elif text in t:
            best = max(best, 0.92 if t.startswith(text) or t.endswith(text) else 0.80)
        else:
            it, at = [], -1
            for ch in text:
                at = t.find(ch, at + 1)
                it.append(at)
                if at < 0:
                    break
            if it and min(it) >= 0:
                s = max(0.2, 0.7 - 0.12 * (it[-1] - it[0] + 1 - len(text)))
                best = max(best, max(0.15, s - 0.05) if it[0] > 0 and it[-1] + 1 < len(t) else s)
    doubt = 1 - min(1, max(0, visual))
    prior = sum(o.prior * (1 - min(1, o.visual)) for o in path) / n
    return visual + sum(o.geometry for o in path) / n + 0.2 * best * doubt + 0.15 * prior - 0.005 * (n - 1)


def test_wide_beam_finds_the_best_of_all_paths():
    r = random.Random(4)
    for _ in range(30):
        options, terms = random_options(r), ["abc", "bcad", "dd"]
        found = ranked_paths(options, Weights(beam=10_000), Terms(terms))
        best = max(plain_total(p, terms) for p in all_paths(options, 5))
        assert found[0][0] == pytest.approx(best, abs=1e-9) and plain_total(found[0][2], terms) == pytest.approx(best, abs=1e-9)
        assert ranked_paths(options, Weights(), Terms(terms))[0][0] >= ranked_paths(options, Weights(), Terms(terms), beam=False)[0][0] - 1e-12


def test_best_path_prefers_prefixes_and_terms():
    terms = Terms(["AB"])
    assert terms.step("", "A") == ("A", True, False) and terms.step("A", "B") == ("AB", True, True) and terms.step("AB", "A") == ("A", True, False) and terms.step("A", "x") == ("", False, False)
    even = [Option(0, 1, c, 0.6, 0.0, 0.5) for c in "XA"] + [Option(1, 2, c, 0.6, 0.0, 0.5) for c in "YB"]
    assert text_of(best_path(even, Weights(), terms)) == "AB" and text_of(best_path(even, Weights(), None)) == "XY"
    sure = [Option(0, 1, "X", 1.0, 0.0, 0.5), Option(0, 1, "A", 0.9, 0.0, 0.5)]
    assert text_of(best_path(sure, Weights(), terms)) == "X"  # a confident reading stays
    assert best_path([], Weights(), terms) == () and best_path([Option(0, 1, "a", 1, 0, 0), Option(2, 3, "b", 1, 0, 0)], Weights(), None) == ()
    with pytest.raises(ValueError):
        Weights(beam=0)


def test_decode_lattice(spark, monkeypatch):
    lex = lists.lexicon_from_terms(spark, "t", ["AB", "CD"])
    rows = [(1, 0, 1, 0, "X", 0.6, 0.0), (1, 0, 1, 1, "A", 0.6, 0.0), (1, 1, 2, 0, "B", 0.7, 0.0), (2, 0, 1, 0, "Q", 1.0, 0.0)]
    options = spark.createDataFrame(rows, "line_id long, start int, end int, rank int, char string, visual double, geometry double")
    spans = spark.createDataFrame([(1, 0, 1), (2, 0, 1), (2, 1, 2)], "line_id long, start int, end int")
    own = with_unknowns(options, spans)
    out = {r.line_id: r for r in decode_lattice(own, lex).collect()}
    assert out[1].text == "AB" and out[1].alternatives == ["XB"] and out[2].text == "Q?"
    from glyphlake.operators import lexicon_decode

    monkeypatch.setattr(lexicon_decode, "small_enough", lambda _: False)
    assert {r.line_id: r for r in decode_lattice(own, lex).collect()} == out  # a lexicon too large to be sent
    assert {r.line_id: r.terms for r in relevant_terms(own, lex).collect()} == {1: ["AB"]}
    assert decode_lattice(own.limit(0), lex).collect() == [] and decode_lattice(own, None, beam=False).count() == 2


def test_priors(spark):
    charset = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "char_id int, ch string")
    lex = lists.lexicon_from_terms(spark, "t", ["ab", "a"])
    of = lambda df: {r.char_id: round(r.log_p, 6) for r in df.collect()}
    inf = float("-inf")
    assert of(domain_prior.open_text(charset, charset.limit(0))) == of(domain_prior.choose(charset)) == dict.fromkeys(range(3), round(-math.log(3), 6))
    assert of(domain_prior.open_text(charset, charset.where("char_id > 0"))) == {0: inf, 1: round(-math.log(2), 6), 2: round(-math.log(2), 6)}
    assert of(domain_prior.choose(charset, allowed=charset.limit(0), lexicon=lex)) == dict.fromkeys(range(3), inf)
    assert of(domain_prior.choose(charset, allowed=charset, lexicon=lex)) == {0: 0.0, 1: round(-math.log(2), 6), 2: -6.0}
    assert of(domain_prior.choose(charset, {"calibration": [[-1, -3], [0, -1]], "floor_log_p": -2.5}, lexicon=lex)) == {0: -1.0, 1: round(max(-2.5, -3 + (1 - math.log(2)) * 2), 6), 2: -2.5}


def test_pieces_of_wide_components():
    left, right = np.ones((12, 10), bool), np.ones((12, 10), bool)
    bridge = np.zeros((12, 3), bool)
    bridge[6] = True
    joined = np.concatenate([left, bridge, right], 1)
    found = merges.pieces(joined, 10.0, 3)
    assert len(found) == 2 and found[0][0] == 0 and sum(m.sum() for _, _, m in found) == joined.sum()
    solid = np.ones((12, 24), bool)
    cut = merges.pieces(solid, 10.0, 3)
    assert len(cut) >= 2 and sum(m.sum() for _, _, m in cut) == solid.sum()
    assert merges.pieces(left, 10.0, 3) == [(0, 0, left)] or len(merges.pieces(left, 10.0, 3)) == 1
    assert len(merges.pieces(solid, 10.0, 0)) == 1 and merges.forced_seams(np.ones((1, 30), bool), 10.0, 3) == []
    snake = merges.slices(np.ones((3, 6), bool), [np.array([2, 3, 2])])
    assert [int(s.sum()) for s in snake] == [7, 11] and snake[1][0, 2] and not snake[1][1, 2]


def test_clusters_and_vertical_gap(spark):
    atoms = spark.createDataFrame([(1, 0, 0, 0, 4, 10), (1, 1, 30, 0, 4, 10), (1, 2, 5, 0, 25, 10), (2, 0, 0, 0, 4, 4), (2, 1, 0, 20, 4, 4)], "line_id long, atom_idx int, x int, y int, w int, h int")
    spans = spark.createDataFrame([(1, 0, 3), (1, 0, 2), (2, 0, 2), (2, 0, 1)], "line_id long, start int, end int")
    got = {(r.line_id, r.start, r.end): r.connected for r in merges.one_cluster(spans, atoms).collect()}
    assert got == {(1, 0, 3): True, (1, 0, 2): False, (2, 0, 2): False, (2, 0, 1): True}
    from pyspark.sql import functions as F

    row = spark.range(1).select(merges.vertical_gap(F.lit(0), F.lit(5), F.lit(8), F.lit(9)).alias("a"), merges.total_geometry(F.lit(-0.1), F.lit(-0.1)).alias("b"), merges.is_anomalous(F.lit(1), F.lit(2)).alias("c")).first()
    assert (row.a, row.b, row.c) == (3, -0.12, True)
    assert merges.build_lattice(atoms, spans).where("line_id = 1").first().width == 34


def test_soft_glyphs():
    image = np.zeros((8, 8, 3), np.uint8)
    image[2:6, 2:4] = 200
    ink = vision.Ink(threshold=100)
    assert ink.hard(image).sum() == 8 and set(np.unique(ink.soft(image))) == {0, 200} or ink.soft(image).max() in (199, 200)
    soft = vision.normalize_glyph(ink.soft(image)[2:6, 2:4])
    hard = vision.normalize_glyph(ink.hard(image)[2:6, 2:4])
    assert soft.shape == (24, 24) and ((soft > 0) == (hard > 0)).all() and hard.max() == 255
    assert vision.normalize_glyph(np.zeros((0, 3), bool)).sum() == 0
    colour = vision.Ink(color=(200, 200, 200), tolerance=5)
    assert colour.hard(image).sum() == 8 and colour.soft(image)[3, 3] == 255
    script = vision.Script(0.9, 0.9, 0.1)
    assert vision.glyph_frame(20, 20, script) == pytest.approx((20 - 0.1 * 20 / 0.9, 0.96)) and vision.glyph_frame(4, 20, script)[0] == 20
    dark = vision.Ink(threshold=0.5, bright=False, saturation=0.7)
    assert dark.hard(image).sum() == 64 - 8 and dark.soft(image)[0, 0] == 255


def test_shown_texts(spark):
    """Voted, else fused where it differs from the frame's own, else the latest; by a plain walk over the frames."""
    r = random.Random(2)
    place = lambda i, c: {"x": 10.0 * i, "w": 8.0, "char": c, "confidence": 0.5, "logits": {c: r.choice([0.4, 0.9])}}
    rows = [("k", i, t, [place(j, c) for j, c in enumerate(t)]) for i, t in enumerate(r.choice(["AB", "AC", "XB", "AB"]) for _ in range(30))]
    frames = spark.createDataFrame(rows, "key string, seq int, text string, positions array<struct<x:double,w:double,char:string,confidence:double,logits:map<string,double>>>")
    out = sorted(fr.shown_texts(frames, "key", ["seq"]).collect(), key=lambda x: x.seq)
    for i, x in enumerate(out):
        last = rows[max(0, i - 7) : i + 1]
        counts = {t: [q[2] for q in last].count(t) for t in dict.fromkeys(q[2] for q in last)}
        voted = max(counts, key=counts.get)
        stable = voted if len(last) >= 3 and counts[voted] / len(last) >= 0.6 else None
        sums = [{}, {}]
        for q in last:
            for j, p in enumerate(q[3]):
                sums[j][p["char"]] = sums[j].get(p["char"], 0) + p["logits"][p["char"]]
        best = [max(s.values()) for s in sums]
        assert x.stable == stable and all(sums[j][c] == pytest.approx(best[j]) for j, c in enumerate(x.fused))
        expect = stable or (x.fused if len(last) >= 2 and x.fused != x.text else x.text)
        assert x.shown == expect and x.source == ("stable" if stable else "fused" if x.fused != x.text and len(last) >= 2 else "latest")
        if x.source == "fused":
            assert x.alternatives == list(dict.fromkeys(q[2] for q in reversed(last)))[:8]
    lex = lists.lexicon_from_terms(spark, "t", ["AB"])
    assert {(y.shown, y.term) for y in fr.annotate(fr.shown_texts(frames, "key", ["seq"]), lex).select("shown", "term").distinct().collect()} >= {("AB", "AB")}


def test_calls_and_boxes(spark):
    is_name = lambda v: v == "words"
    assert fr.lexicon_of_call((), {"lexicon": "words"}, is_name) == ("words", "prefer")
    assert fr.lexicon_of_call(("x", "words", "strict"), {}, is_name) == ("words", "strict") and fr.lexicon_of_call(("words",), {}, is_name) == ("words", "prefer")
    assert fr.lexicon_of_call((1,), {}, is_name) == (None, None)
    with pytest.raises(ValueError):
        fr.given_box((0, 0, 9, 9), 8, 8)
    assert fr.given_box((1, 2, 3, 4), 8, 8) == (1, 2, 3, 4)
    with pytest.raises(ValueError):
        fr.Settings(vote_ratio=0)
    from pyspark.sql import functions as F

    keys = spark.createDataFrame([({"a": "1", "b": "2"},), ({"b": "2", "a": "1"},), ({"a": "2"},)], "o map<string,string>").select(fr.call_key(F.col("o")).alias("k")).collect()
    assert keys[0] == keys[1] != keys[2]
    black = spark.createDataFrame([(1, x, y, 0, 0, 0) for x, y in itertools.product(range(3), range(3))], "frame_id long, x int, y int, r int, g int, b int")
    assert tuple(fr.ink_boxes(black).first())[1:] == (0, 0, 0, 0) and fr.signatures(black, fr.ink_boxes(black)).first().signature == "empty"
    chars = spark.createDataFrame([(1, 0, "A", 0.5), (1, 1, "B", 0.7)], "frame_id long, position int, char string, confidence double")
    alts = spark.createDataFrame([(1, 0, "A", 2.0), (1, 0, "X", 1.0)], "frame_id long, position int, char string, logit double")
    assert {r.position: r.logits for r in fr.evidence(chars, alts).collect()} == {0: {"A": 2.0, "X": 1.0}, 1: {"B": 0.7}}
    assert Bounds().height_least == 8
