import math
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphlake.llm.toxicity import Model, background_rate, learn, maximal_segments, score_documents


def brute(scores, at=0):
    """By definition: the best segment (shortest, leftmost), then the same to its left and right."""
    best = None
    for i in range(len(scores)):
        for j in range(i, len(scores)):
            s = sum(scores[i : j + 1])
            if s > 0 and (best is None or s > best[0]):
                best = (s, i, j)
    if best is None:
        return []
    s, i, j = best
    return [*brute(scores[:i], at), (s, at + i, at + j), *brute(scores[j + 1 :], at + j + 1)]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=14))
def test_maximal_segments(scores):
    # Tiny distinct parts make every sum unique, so that there is one answer.
    exact = [s + 2.0**-20 * 3**-i for i, s in enumerate(scores)]
    got, expect = maximal_segments(exact), brute(exact)
    assert [x[1:] for x in got] == [x[1:] for x in expect]
    assert np.allclose([x[0] for x in got], [x[0] for x in expect])


def test_background_rate():
    scores, shares = np.array([1.0, -1.0]), np.array([0.25, 0.75])
    assert abs(background_rate(scores, shares) - np.log(3)) < 1e-6
    assert background_rate(np.array([-1.0]), np.array([1.0])) == 1.0


def tables(spark, n=200):
    docs, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        docs.append((i, "the calm river runs past a quiet town " * 6 + ("you vile grub vile grub " if bad else "") + f"and word{i} goes " + "the river runs on " * 3))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_accuracy_and_edge_rows(spark):
    docs, labels = tables(spark)
    docs += [(900, None), (901, ""), (None, "vile grub"), (902, "vile grub " * 20_000), (902, "vile grub " * 20_000)]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, score int")
    lab = spark.createDataFrame([*labels, (None, 1), (3, None), (5, 1)], "doc_id long, toxic int")
    out = score_documents(d, learn(d, lab)).collect()
    assert len(out) == len(docs)
    by = {r.doc_id: r for r in out}
    held = [i for i, _ in labels if by[i].held_out]
    assert held and all(by[i].predicted == dict(labels)[i] for i in held)
    assert by[900].score == by[901].score and 0 <= by[900].score < 0.5 and not by[None].held_out and by[902].predicted == 1
    none = score_documents(d, learn(d, lab.where("toxic > 5"))).collect()
    assert {r.score for r in none} == {0.0}
    assert score_documents(d.limit(0), Model()).collect() == []


def test_scores_equal_their_definition(spark):
    """From the learned weights on, each document's score by the formulas, with segments by definition."""
    docs, labels = tables(spark, 60)
    docs = [(i, " ".join(t.split()[-18:])) if i % 2 else (i, " ".join(t.split()[30:])) for i, t in docs]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = learn(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.calibration and model.weights
    for r in score_documents(d, model).collect():
        scores = []
        for w in re.findall(r"[^\W\d_]+", dict(docs)[r.doc_id].lower()):
            known = [model.weights[f] for f in [w, *(w[:n] + "*" for n in (6, 5, 4) if len(w) > n)] if f in model.weights]
            scores.append((max(known, key=lambda x: abs(x[1]))[0] if known else 0.0) - 0.7)
        own, norm = brute(scores), math.log(0.1 * len(scores) + 1)
        best = max((model.rate * s for s, _, _ in own), default=0.0) - norm
        good = [s for s in own if model.rate * s[0] - norm > -math.log(0.01)]
        a, b, c = model.calibration
        score = 1 / (1 + math.exp(-(a + b * best + c * math.log1p(sum(model.rate * s - norm for s, _, _ in good)))))
        assert abs(r.score - score) < 1e-9 and r.predicted == int(score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.segments == ",".join(f"{i}:{j}:{s:.2f}" for s, i, j in good) and r.n_segments == len(good)
