"""Values of functions that no query covers."""

import hashlib

import pytest
from pyspark.sql import functions as F

from glyphlake.functions import scoring
from glyphlake.operators import evaluate, ranking, resolve, vision
from glyphlake.operators import segmentation as sg
from glyphlake.sources import lists, models


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_scores(spark):
    lit, inf = F.lit, float("inf")
    array = lambda *v: F.array(*map(lit, v))
    out = one(
        spark, a=scoring.finite_logit(lit(1.0)), b=scoring.finite_logit(lit(inf)), c=scoring.finite_logit(lit(-inf)), d=scoring.finite_logit(lit(float("nan"))),
        e=scoring.all_finite(array(1.0, 2.0)), f=scoring.all_finite(array(1.0, -inf)), g=scoring.clamp_log_prob(lit(-99.0)), h=scoring.clamp_log_prob(lit(0.5)),
        i=scoring.calibrate_log_monotone(lit(-1.5), [(-2.0, -4.0), (-1.0, -1.0)]), j=scoring.linear(array(1.0, 2.0), (0.5, -1.0), 0.25), k=scoring.overlap(lit(0), lit(5), lit(3), lit(9)), m=scoring.overlap(lit(0), lit(2), lit(3), lit(9)),
    )
    assert tuple(out) == (True, False, True, False, True, False, -30.0, 0.0, -2.5, -1.25, 2, -1)


def test_envelope(spark):
    e = sg.Envelope(0.7, 0.4, 0.3, 0.6, 0.9, 0.9, 0.8, 1.0)
    ok = lambda w, h: one(spark, v=sg.envelope_ok(F.lit(w), F.lit(h), e, F.lit(1.35))).v
    assert ok(18, 18) and ok(1, 1) and not ok(60, 18) and not ok(1, 30) and ok(6, 14)


def test_trusted_templates_and_crossover(spark):
    fused = spark.createDataFrame([(1, 5, 0.9), (1, 6, 0.4), (1, 7, 0.8), (2, 5, 0.3)], "glyph_id long, char_id int, combined double")
    out = {(r.glyph_id, r.char_id): (r["rank"], r.combined) for r in ranking.fuse_trusted(fused, spark.createDataFrame([(1, 6, 0.95)], "glyph_id long, char_id int, score double")).collect()}
    assert out == {(1, 6): (1, 0.95), (1, 5): (2, 0.9), (1, 7): (3, 0.8), (2, 5): (1, 0.3)}
    costs = spark.createDataFrame([("gpu", 1, 5.0), ("gpu", 8, 6.0), ("cpu", 1, 1.0), ("cpu", 8, 8.0)], "backend string, batch int, cost double")
    assert ranking.crossover(costs, "gpu", "cpu").first().crossover == 8


def test_promotions(spark):
    lex = lists.lexicon_from_terms(spark, "t", ["AB", "CD"])
    own = spark.createDataFrame([(1, "XY"), (2, "XZ")], "text_id long, text string")
    alts = spark.createDataFrame([(1, 0, "QQ"), (1, 1, "CD"), (1, 2, "AB"), (2, 0, "no")], "text_id long, rank int, alt string")
    assert [tuple(r) for r in resolve.promotions(own, alts, lex).collect()] == [(1, "CD", pytest.approx(0.9))]


def test_lists_and_hashes(spark, tmp_path):
    (tmp_path / "w.txt").write_text("one\ntwo\none\n")
    lists.name_lexicon("numbers", "w.txt")
    assert sorted(r.term for r in lists.load_lexicon(spark, "numbers", str(tmp_path)).collect()) == ["one", "two"] == sorted(r.term for r in lists.load_lexicon(spark, str(tmp_path / "w.txt"), "").collect())
    with pytest.raises(ValueError):
        lists.load_lexicon(spark, "", str(tmp_path))
    old = spark.createDataFrame([("a", 1), ("b", 2)], "category string, n int")
    assert sorted(map(tuple, lists.upsert_category(old, spark.createDataFrame([(9,)], "n int"), "a").select("category", "n").collect())) == [("a", 9), ("b", 2)]
    lists.write_lines(spark.createDataFrame([("y", 2), ("x", 1)], "t string, o int"), "t", "o", str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["x", "y"]
    path = str(tmp_path / "w.txt")
    sha = hashlib.sha256((tmp_path / "w.txt").read_bytes()).hexdigest()
    assert models.registered_hash(spark, path, {"w.txt": sha}) == sha
    with pytest.raises(ValueError):
        models.registered_hash(spark, path, {})


def test_soft_sums(spark):
    image = bytes([0, 0, 0, 200, 200, 200])
    out = vision.masks_of_images(spark.createDataFrame([(1, 2, 1, image)], "image_id long, width int, height int, pixels binary")).first()
    assert out.ink == 1 and out.soft_sum in (199, 200)
    rows = spark.createDataFrame([(True,), (False,), (True,), (True,)], "recalled boolean")
    assert tuple(evaluate.recall_report(rows).first()) == (4, 3, 0.75)


def test_prototypes_in_parts(spark):
    """The nearest of each class is the same whether prototypes go in one part or in many."""
    from glyphlake.operators import distance

    rows = [(c, p, (c * 7919 + p * 104729) % (1 << 40)) for c in range(6) for p in range(9)]
    protos = spark.createDataFrame(rows, "char_id long, proto_id long, bits long")
    glyphs = spark.createDataFrame([(i, i * 999_983) for i in range(20)], "glyph_id long, bits long")
    whole = sorted(map(tuple, distance.class_minimum(glyphs, protos).collect()))
    assert whole == sorted(map(tuple, distance.class_minimum(glyphs, protos, rows=40).collect())) and len(whole) == 120
    plain = {(i, c): min(((g ^ b).bit_count(), p) for k, p, b in rows if k == c) for i, g in [(i, i * 999_983) for i in range(20)] for c in range(6)}
    assert {(i, c): (d, p) for i, c, d, p in whole} == plain
    with pytest.raises(ValueError):
        distance.class_minimum(glyphs, protos.select("char_id", F.lit(0).cast("long").alias("proto_id"), "bits"), rows=5)
