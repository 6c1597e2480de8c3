"""Probabilistic decoding against an enumeration of all paths."""

import itertools
import math

import numpy as np
import pytest

from glyphlake.operators import prob_decoder as pd

SPANS = [(0, 1), (1, 2), (2, 3), (0, 2), (1, 3)]


def carriers(spark, seed, states=("clean", "12_1"), chars=3):
    r = np.random.default_rng(seed)
    feats = [(1, z, a, b, c, c, r.normal(size=26).tolist(), r.normal(size=9).tolist()) for z in states for a, b in SPANS for c in range(chars)]
    edges = [(1, a, b, r.normal(size=14).tolist(), b - a > 1) for a, b in SPANS]
    f = spark.createDataFrame(feats, "line_id long, state string, start int, end int, rank int, char_id long, f_visual array<double>, f_geometry array<double>")
    e = spark.createDataFrame(edges, "line_id long, start int, end int, f_boundary array<double>, anomalous boolean")
    prior = spark.createDataFrame([(c, -1.0 - 0.3 * c) for c in range(chars)], "char_id long, log_p double")
    return feats, edges, f, e, prior


def plain_options(feats, edges, config):
    """Log probabilities by their definitions."""
    scale = lambda f, at: np.clip((np.array(f) - config.mean[at : at + len(f)]) / config.std[at : at + len(f)], -config.clip, config.clip)
    logit = {x[1:5]: (scale(x[6], 0) @ np.array(config.visual) + config.intercept) / config.temperature for x in feats}
    edge = {x[1:3]: float(np.clip(scale(x[3], 35) @ np.array(config.boundary), -6, 0)) for x in edges}
    out = {}
    for _, z, a, b, c, _, _, geo in feats:
        own = [logit[z, a, b, k] for k in range(3)] + [config.background]
        visual = logit[z, a, b, c] - math.log(sum(math.exp(v) for v in own))
        out[z, a, b, c] = visual + float(np.clip(scale(geo, 26) @ np.array(config.geometry), -6, 0)) + edge[a, b] + (-1.0 - 0.3 * c)
    return out


def test_wide_search_equals_all_paths(spark):
    for seed in (1, 2):
        config = pd.random_config(seed, k=1000, alpha=0.9, beta=0.5, temperature=1.3, background=0.2, calibration=((0.0, 0.0), (0.5, 0.7), (1.0, 1.0)), reject=True, reject_confidence=0.0, reject_margin=10.0)
        feats, edges, f, e, prior = carriers(spark, seed)
        charset = spark.createDataFrame([(c, "abc"[c]) for c in range(3)], "char_id long, ch string")
        out = pd.decode_lattice(pd.option_scores(f, e, prior, config), charset, config).first()
        gain = plain_options(feats, edges, config)
        best = []
        for tiling in ([(0, 1), (1, 2), (2, 3)], [(0, 2), (2, 3)], [(0, 1), (1, 3)]):
            for chars in itertools.product(range(3), repeat=len(tiling)):
                by = {z: sum(gain[z, a, b, c] for (a, b), c in zip(tiling, chars)) for z in ("clean", "12_1")}
                total = math.log(sum(math.exp(v) for v in by.values()))
                best.append((total / (len(tiling) + 0.5) ** 0.9, total, "".join("abc"[c] for c in chars), tiling, max(by, key=by.get)))
        best.sort(key=lambda x: -x[0])
        share = math.exp(best[0][0]) / sum(math.exp(x[0]) for x in best)
        assert out.text == best[0][2] and out.path == ",".join(f"{a}-{b}" for a, b in best[0][3]) and out.state == best[0][4]
        assert out.score == pytest.approx(best[0][1], abs=1e-9) and out.normalised == pytest.approx(best[0][0], abs=1e-9)
        assert out.margin == pytest.approx(best[0][0] - best[1][0], abs=1e-9) and out.searched == len(best)
        assert out.confidence == pytest.approx(share * 1.4 if share <= 0.5 else 0.7 + (share - 0.5) * 0.6, abs=1e-9)
        assert out.rejected == "margin" and out.visual + out.geometry + out.boundary + out.domain == pytest.approx(max(sum(gain[z, a, b, "abc".index(c)] for (a, b), c in zip(best[0][3], best[0][2])) for z in ("clean", "12_1")), abs=1e-9)


def test_unknowns_and_allowed(spark):
    config = pd.random_config(3)
    _, _, f, e, prior = carriers(spark, 3)
    charset = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "char_id long, ch string")
    none = pd.option_scores(f, e, prior, config, allowed=charset.limit(0))
    assert {(r.char_id, r.visual) for r in none.collect()} == {(-1, -8.0)}
    assert set(pd.decode_lattice(none, charset, config).first().text) == {"?"}
    only = pd.option_scores(f, e, prior, config, allowed=charset.where("ch = 'b'"))
    assert set(pd.decode_lattice(only, charset, config).first().text) == {"b"}
    assert pd.decode_lattice(none.limit(0), charset, config).collect() == []


def test_configurations():
    good = pd.random_config(1)
    block = {"version": 2, "local_ranker": {"coef": good.visual, "intercept": 0.5}, "geometry_weights": {"coef": good.geometry}, "boundary_weights": {"coef": good.boundary}, "feature_normalization": {"mean": good.mean, "std": good.std}, "render_states": {"top_m": 2}, "confidence_calibration": [[0, 0], [1, 1]], "reject": {"enabled": True, "margin_threshold": 0.2}, "k_best": 4}
    own, why = pd.load_config({"decoder": block})
    assert why is None and own.k == 4 and own.intercept == 0.5 and own.states.top == 2 and own.reject and own.calibration == ((0.0, 0.0), (1.0, 1.0))
    assert pd.load_config({}) == (None, None) == pd.load_config({"decoder": {"version": 1}}) == pd.load_config({"decoder": {"version": "x"}}) == pd.load_config(None)
    for bad in ({"temperature": 0}, {"length_alpha": 3}, {"unknown_log_prob": 1}, {"confidence_calibration": [[0.5, 0], [0.5, 1]]}, {"local_ranker": {"coef": [1.0]}}, {"score_type": "x"}, {"k_best": 0}, {"render_states": {"top_m": 0}}, {"background_logit": float("nan")}, {"reject": {"margin_threshold": 11}}):
        assert pd.load_config({"decoder": block | bad})[1], bad
    assert pd.States(2).select(["x", "a", "b", "a", "c"], ["a", "b", "c"]) == ["a", "b", "clean"] and pd.States(enabled=False).select(["a"], ["a"]) == ["clean"]
    assert pd.States().log_prior(["a", "b"]) == pytest.approx(-math.log(2))
