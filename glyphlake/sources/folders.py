"""Model folders, profiles, the register of fonts, and word lists and character sets made from tables of records.

A model folder holds ``config.json``, ``charset.txt``, ``weights.bin``, for hybrid models ``templates.bin``, and ``geometry.json`` where it is known.
All are small files; the tables they describe are bounded by a charset.
"""

from __future__ import annotations

import json
import string
import struct
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, field, fields
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import characters, is_han, strip_color_codes
from ..operators.glyphs import NormalSpec
from ..operators.lexicon import first_seen
from ..operators.segmentation import Bounds
from ..operators.vision import Ink
from .lists import LINE_END, field_texts, read_tolerant_json, write_lines
from .models import MAGIC, PROTOTYPE, parse_templates, read_bytes, read_weights, tensor_shapes, words_of, write_bytes, write_templates, write_weights

#: What a configuration may say.
KINDS = ("template", "tinycnn", "hybrid")
NETWORK = "tinycnn_v1"
MODES = ("binary", "soft")
VISUAL = {"cnn": 0.45, "template": 0.45, "geometry": 0.10}


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


@dataclass(frozen=True)
class Profile:
    """How text of one kind looks."""

    name: str = "default"
    target_color: tuple[int, int, int] | None = None
    tolerance: int = 40
    use_grayscale: bool = True
    grayscale_threshold: int = 140
    use_hsl: bool = False
    hsl_lightness_min: float = 0.55
    hsl_saturation_max: float = 0.70
    char_height_min: int = 8
    char_height_max: int = 64
    char_width_min: int = 3
    char_width_max: int = 72
    stroke_width: int = 1
    char_spacing: int = 1
    target_size: int = 24
    bright_text: bool = True

    @classmethod
    def from_dict(cls, data: Mapping[str, Any]) -> Profile:
        """Each known key as its default's type; others are left out."""
        plain = cls()
        kind = lambda f, v: tuple(v) if f == "target_color" and v is not None else v if f == "target_color" else type(getattr(plain, f))(v)
        return cls(**{f.name: kind(f.name, data[f.name]) for f in fields(cls) if f.name in data})

    def ink(self) -> Ink:
        if self.use_hsl:
            return Ink(self.hsl_lightness_min, self.bright_text, self.hsl_saturation_max)
        plain = self.use_grayscale or self.target_color is None
        return Ink(self.grayscale_threshold, self.bright_text, None, None if plain else self.target_color, self.tolerance)

    def bounds(self) -> Bounds:
        return Bounds(self.char_height_min, self.char_height_max, self.char_width_min, self.char_width_max, self.char_spacing)


#: The profile of a caller that names none.
DEFAULT_PROFILE = Profile(target_color=(255, 255, 255), tolerance=48)


@dataclass
class Model:
    """A model folder in memory: configuration, classes in order, prototypes (a table), network weights and character metrics (a table)."""

    config: dict
    charset: list[str]
    prototypes: DataFrame | None = None
    weights: dict[str, np.ndarray] | None = None
    metrics: DataFrame | None = None
    size: int = 24
    problems: list[str] = field(default_factory=list)

    @property
    def kind(self) -> str:
        return self.config.get("classifier", "template")

    @property
    def spec(self) -> NormalSpec | None:
        return NormalSpec.from_dict(self.config.get("normalize"))

    def classes(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.charset)), "char_id int, ch string")


def parse_plain_templates(raw: bytes, classes: int, size: int = 24) -> pd.DataFrame:
    """One prototype a class: a header of two words, then the packed bits."""
    width = (size * size + 7) // 8
    if len(raw) < 8 or struct.unpack("<II", raw[:8]) != (classes, width) or len(raw) != 8 + classes * width:
        raise ValueError(f"the file isn't {classes} templates of {width} bytes")
    bits = np.frombuffer(raw, np.uint8, classes * width, 8).reshape(classes, width)
    out = pd.DataFrame({"char_id": np.arange(classes, dtype=np.int32), "proto_id": 0, "render_size": 0, "dx": 0, "dy": 0, "mode": 0})
    return out.assign(bits=list(words_of(bits)))


def plain_templates(prototypes: DataFrame, size: int = 24) -> bytes:
    rows = prototypes.orderBy("char_id").select("bits").toPandas()
    width = (size * size + 7) // 8
    bits = np.stack([np.asarray(b, "<i8") for b in rows["bits"]]).view(np.uint8)[:, :width]
    return struct.pack("<II", len(rows), width) + np.ascontiguousarray(bits).tobytes()


def config_faults(config: Mapping, charset: list[str]) -> list[str]:
    """What a configuration says that can't be loaded."""
    size = config.get("input_width")
    rules = {
        f"version {config.get('version', 1)} is unknown": config.get("version", 1) == 1,
        f"type {config.get('dtype')} is unknown": config.get("dtype", "f32") == "f32",
        "width and height of the input differ": size is not None and int(size) == int(config.get("input_height", -1)),
        f"{config.get('classes')} classes, but {len(charset)} characters": int(config.get("classes", -1)) == len(charset),
        f"classifier {config.get('classifier')} is unknown": config.get("classifier", "template") in KINDS,
        f"network {config.get('architecture')} is unknown": config.get("classifier", "template") == "template" or config.get("architecture", NETWORK) == NETWORK,
        f"input {config.get('input_mode')} is unknown": config.get("input_mode", "binary") in MODES,
    }
    return [what for what, ok in rules.items() if not ok]


def charset_of(raw: bytes) -> list[str]:
    """One class for each character that isn't white space; blank lines and # lines are left out."""
    import re

    lines = [x for x in re.split(LINE_END.replace("\\x{2028}", " ").replace("\\x{2029}", " "), raw.decode()) if x.strip() and not x.lstrip().startswith("#")]
    return [c for x in lines for c in x if not c.isspace()]


def load_model(spark: SparkSession, path: str) -> Model:
    """A model folder, checked: the configuration, the files it asks for, and that all of them are of one charset and font."""
    base = path.rstrip("/")
    for name in ("config.json", "charset.txt", "weights.bin"):
        if not exists(spark, f"{base}/{name}"):
            raise FileNotFoundError(f"{base}/{name}")
    config, charset = json.loads(read_bytes(spark, f"{base}/config.json")), charset_of(read_bytes(spark, f"{base}/charset.txt"))
    if faults := config_faults(config, charset):
        raise ValueError("; ".join(faults))
    model = Model(config, charset, size=int(config["input_width"]))
    if model.kind != "template":
        model.weights = read_weights(spark, f"{base}/weights.bin", len(charset))
    if model.kind != "tinycnn":
        raw = read_bytes(spark, f"{base}/{'templates' if model.kind == 'hybrid' else 'weights'}.bin")
        many = raw[:4] == MAGIC.to_bytes(4, "little")
        if many and config.get("template_version", 1) != 2:
            raise ValueError("a set of several prototypes needs template_version 2")
        rows = parse_templates(raw, model.size) if many else parse_plain_templates(raw, len(charset), model.size)
        if rows["char_id"].max() + 1 != len(charset):
            raise ValueError("templates and charset differ")
        model.prototypes = spark.createDataFrame(rows.assign(bits=[b.tolist() for b in rows["bits"]]), PROTOTYPE)
    if exists(spark, f"{base}/geometry.json"):
        data = json.loads(read_bytes(spark, f"{base}/geometry.json"))
        if len(data["entries"]) != len(charset) or data.get("charset", "".join(charset)) != "".join(charset):
            raise ValueError("geometry.json is of another charset")
        if config.get("font_sha256") and data.get("font_sha256", config["font_sha256"]) != config["font_sha256"]:
            raise ValueError("geometry.json is of another font")
        model.metrics = spark.createDataFrame(pd.DataFrame(data["entries"]))
    return model


def save_model(spark: SparkSession, path: str, charset: list[str], prototypes: DataFrame | None = None, weights: dict[str, np.ndarray] | None = None, metrics: DataFrame | None = None, size: int = 24, input_mode: str = "binary", spec: NormalSpec | None = None, font_sha256: str | None = None, thresholds: Mapping[str, float] | None = None, visual_weights: Mapping[str, float] | None = None, calibration: Iterable = ()) -> None:
    """Write a model folder: prototypes alone make a template model, weights alone a network, both a hybrid. Classes with several prototypes make a set."""
    if prototypes is None and weights is None or input_mode not in MODES:
        raise ValueError(f"a model needs prototypes or weights, and an input of {MODES}")
    base = path.rstrip("/")
    kind = "hybrid" if prototypes is not None and weights is not None else "template" if weights is None else "tinycnn"
    config: dict[str, Any] = {"input_width": size, "input_height": size, "classes": len(charset), "version": 1, "dtype": "f32", "classifier": kind}
    if weights is not None:
        config |= {"architecture": NETWORK, "input_mode": input_mode}
        if weights["fc_w"].shape != dict(tensor_shapes(len(charset)))["fc_w"]:
            raise ValueError("weights and charset differ")
    if kind == "hybrid":
        config |= {"template_threshold": 0.9, "template_margin_threshold": 0.0, "cnn_threshold": 0.0} | dict(thresholds or {}) | {"visual_weights": dict(visual_weights or VISUAL), "visual_calibration": [list(p) for p in calibration]}
    many = False
    if prototypes is not None:
        sizes = prototypes.groupBy("char_id").count().agg(F.count("*").alias("classes"), F.max("count").alias("most")).first()
        if sizes.classes != len(charset):
            raise ValueError("templates and charset differ")
        many = sizes.most > 1
        config |= {"template_version": 2} if many else {}
    config |= ({"font_sha256": font_sha256} if font_sha256 else {}) | ({"normalize": spec.to_dict()} if spec else {})
    write_bytes(spark, f"{base}/config.json", (json.dumps(config, indent=4) + "\n").encode())
    write_bytes(spark, f"{base}/charset.txt", ("".join(charset) + "\n").encode())
    if weights is not None:
        write_weights(spark, f"{base}/weights.bin", weights, len(charset))
    if prototypes is not None:
        place = f"{base}/{'templates' if weights is not None else 'weights'}.bin"
        if many:
            write_templates(prototypes, place, size)
        else:
            write_bytes(spark, place, plain_templates(prototypes, size))
    if metrics is not None:
        rows = [r.asDict() for r in metrics.orderBy("char_id").collect()]  # one row for each character
        write_bytes(spark, f"{base}/geometry.json", json.dumps({"format": "geometry-v1", "charset": "".join(charset), "font_sha256": font_sha256, "entries": rows}).encode())


def font_registry(spark: SparkSession, folder: str) -> dict[str, str]:
    """Names and digests of the registered fonts; none without a register."""
    path = f"{folder.rstrip('/')}/registry.json"
    return dict(json.loads(read_bytes(spark, path)).get("fonts", {})) if exists(spark, path) else {}


def font_path(spark: SparkSession, folder: str, name: str, check: bool = False) -> str:
    """A font within the folder, registered if there is a register, and unchanged if asked for."""
    if name.startswith("/") or ".." in name.split("/"):
        raise ValueError("a font lies within its folder")
    path = f"{folder.rstrip('/')}/{name}"
    if not exists(spark, path):
        raise FileNotFoundError(path)
    register = font_registry(spark, folder)
    if register and name not in register:
        raise ValueError(f"{name} isn't registered")
    if check and register:
        found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("sha")).first().sha
        if found != register[name]:
            raise ValueError(f"{name} has changed since it was registered")
    return path


def export_words(spark: SparkSession, records: str, name: str, out: str, colors: bool = False) -> int:
    """Write a field's different texts, first seen first, to a word list; ``colors`` strips colour codes before. Returns their number."""
    data = read_tolerant_json(spark, records, f"sequence array<struct<{name}:string>>")
    texts = field_texts(data, name)
    if colors:
        texts = first_seen(texts.select(strip_color_codes(F.col("text")).alias("text"), "ord").where("text <> ''"), ["text"], ["ord"])
    write_lines(texts, "text", "ord", out)
    return texts.count()


#: Sets that every collection has.
ASCII = {"ascii_letters": string.ascii_letters, "digits": string.digits, "ascii_punct": string.punctuation}


def extract_charsets(spark: SparkSession, words: Mapping[str, str], out: str, han_of: str | None = None) -> dict[str, str]:
    """Write the characters of each word list (name -> file), in code-point order, those of ASCII, and all together; ``han_of`` names a list whose Han characters are written too."""
    every = None
    for name, path in words.items():
        one = spark.read.text(path).select(F.lit(name).alias("name"), F.explode(F.array_distinct(characters(F.col("value")))).alias("ch")).where("trim(ch) <> ''").distinct()
        every = one if every is None else every.unionByName(one)
    sets = {**ASCII, "ascii": "".join(ASCII.values())}
    fixed = spark.createDataFrame([("ascii", c) for c in sets["ascii"]], "name string, ch string")
    own = every.unionByName(every.where(F.col("name") == han_of).where(is_han(F.col("ch"))).withColumn("name", F.lit(f"{han_of}_hanzi"))) if han_of else every
    both = own.unionByName(every.unionByName(fixed).select(F.lit("all_charset").alias("name"), "ch").distinct())
    found = both.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("ch")), "").alias("chars"))  # charsets
    sets |= {r.name: r.chars for r in found.collect()}
    sets["combined"] = sets["all_charset"]
    for name, chars in sets.items():
        write_bytes(spark, f"{out.rstrip('/')}/{name}.txt", (chars + "\n").encode())
    return sets


__all__ = ["DEFAULT_PROFILE", "Model", "Profile", "asdict", "export_words", "extract_charsets", "font_path", "font_registry", "load_model", "save_model"]
