"""Model folders by round trips, profiles, fonts and word lists."""

import hashlib
import json

import numpy as np
import pytest

from glyphlake.operators.glyphs import NormalSpec
from glyphlake.sources import folders
from glyphlake.sources.models import PROTOTYPE, tensor_shapes, write_bytes


def prototypes(spark, per_class=1):
    r = np.random.default_rng(2)
    rows = [(c, p, 0, 0, 0, 0, r.integers(-(2**62), 2**62, 9).tolist()) for c in range(3) for p in range(per_class)]
    return spark.createDataFrame(rows, PROTOTYPE)


def network():
    r = np.random.default_rng(1)
    return {n: r.normal(size=s).astype(np.float32) for n, s in tensor_shapes(3)}


@pytest.mark.parametrize(("kind", "per_class"), [("template", 1), ("template", 4), ("tinycnn", 0), ("hybrid", 1), ("hybrid", 4)])
def test_model_round_trip(spark, tmp_path, kind, per_class):
    protos, weights = prototypes(spark, per_class) if per_class else None, network() if kind != "template" else None
    metrics = spark.createDataFrame([(c, 0.5, 0.6) for c in range(3)], "char_id int, advance double, bbox_width double")
    folders.save_model(spark, str(tmp_path / "m"), ["a", "b", "漢"], protos, weights, metrics, spec=NormalSpec(baseline_row=17), font_sha256="f" * 64)
    own = folders.load_model(spark, str(tmp_path / "m"))
    assert own.kind == kind and own.charset == ["a", "b", "漢"] and own.spec.baseline_row == 17 and own.metrics.count() == 3 and own.classes(spark).count() == 3
    if per_class:
        assert sorted(map(str, own.prototypes.collect())) == sorted(map(str, protos.collect())) and own.config.get("template_version", 1) == (2 if per_class > 1 else 1)
    if weights:
        assert all((own.weights[n] == weights[n]).all() for n in weights)
    config = json.loads((tmp_path / "m" / "config.json").read_text())
    for bad in ({"version": 2}, {"dtype": "f16"}, {"input_height": 9}, {"classes": 4}, {"classifier": "x"}, {"input_mode": "x"}):
        write_bytes(spark, str(tmp_path / "m/config.json"), json.dumps(config | bad).encode())
        with pytest.raises(ValueError):
            folders.load_model(spark, str(tmp_path / "m"))
    write_bytes(spark, str(tmp_path / "m/config.json"), json.dumps(config | {"font_sha256": "0" * 64}).encode())
    with pytest.raises(ValueError):
        folders.load_model(spark, str(tmp_path / "m"))
    (tmp_path / "m" / "weights.bin").unlink()
    with pytest.raises(FileNotFoundError):
        folders.load_model(spark, str(tmp_path / "m"))


def test_faulty_models(spark, tmp_path):
    for bad in ({}, {"prototypes": prototypes(spark), "input_mode": "x"}):
        with pytest.raises(ValueError):
            folders.save_model(spark, str(tmp_path / "m"), ["a", "b", "c"], **bad)
    with pytest.raises(ValueError):
        folders.save_model(spark, str(tmp_path / "m"), ["a", "b"], prototypes(spark))
    with pytest.raises(ValueError):
        folders.parse_plain_templates(b"\0" * 20, 3)


def test_profiles():
    own = folders.Profile.from_dict({"name": "x", "target_color": [1, 2, 3], "use_grayscale": False, "tolerance": "7", "other": 1})
    assert own.target_color == (1, 2, 3) and own.tolerance == 7 and own.ink().color == (1, 2, 3) and own.bounds().width_least == 3
    assert folders.DEFAULT_PROFILE.ink().threshold == 140 and folders.Profile(use_hsl=True).ink().saturation == 0.70


def test_fonts(spark, tmp_path):
    (tmp_path / "a.ttf").write_bytes(b"font")
    assert folders.font_registry(spark, str(tmp_path)) == {} and folders.font_path(spark, str(tmp_path), "a.ttf").endswith("a.ttf")
    (tmp_path / "registry.json").write_text(json.dumps({"fonts": {"a.ttf": hashlib.sha256(b"font").hexdigest()}}))
    assert folders.font_path(spark, str(tmp_path), "a.ttf", check=True)
    (tmp_path / "a.ttf").write_bytes(b"other")
    (tmp_path / "b.ttf").write_bytes(b"font")
    for name, check in (("a.ttf", True), ("b.ttf", False), ("../a.ttf", False), ("/a.ttf", False)):
        with pytest.raises(ValueError):
            folders.font_path(spark, str(tmp_path), name, check)
    with pytest.raises(FileNotFoundError):
        folders.font_path(spark, str(tmp_path), "none.ttf")


def test_words_and_charsets(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"sequence": [{"title": "Beta"}, {"title": "Al<color=#ff0000>p</color>ha"}, {"title": "Beta"}, {"title": ""}, {"other": 1}]}')
    assert folders.export_words(spark, str(tmp_path / "r.json"), "title", str(tmp_path / "w")) == 2
    assert folders.export_words(spark, str(tmp_path / "r.json"), "title", str(tmp_path / "v"), colors=True) == 2
    (tmp_path / "list.txt").write_text("b a\n漢b\n", encoding="utf-8")
    sets = folders.extract_charsets(spark, {"names": str(tmp_path / "list.txt")}, str(tmp_path / "sets"), han_of="names")
    assert sets["names"] == "ab漢" and sets["names_hanzi"] == "漢" and sets["digits"] == "0123456789" and set("ab漢!9Z") <= set(sets["all_charset"])
    assert (tmp_path / "sets" / "names.txt").read_text(encoding="utf-8") == "ab漢\n"
