"""Probabilistic decoding: options with log probabilities under render states, the k best paths of each, and their union.

Features, normalisation, weights and priors are columns; only the search over a line's options runs as a kernel. The k best paths of all
states are joined by identity, their scores added up over states in the log domain, and ranked by length-normalised score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import calibrate_monotone, clamp, linear, normalize_features

#: Version and kind of a configuration, the sizes of its feature vectors, the limits of log evidence, the state without artefacts.
VERSION, KIND, FEATURE_VERSION = 2, "log_probability", 1
SIZES = {"visual": 26, "geometry": 9, "boundary": 14}
EVIDENCE = (-6.0, 0.0)
UNKNOWN, CLEAN = "?", "clean"


@dataclass(frozen=True)
class States:
    """Which render states a line is decoded under: the most voted ones, and the clean one."""

    top: int = 3
    enabled: bool = True
    clean: bool = True

    def __post_init__(self):
        if self.top < 1:
            raise ValueError("at least one state")

    def select(self, voted: Sequence[str], known: Sequence[str]) -> list[str]:
        """``voted`` in order; states that are not known are left out."""
        own = list(dict.fromkeys(v for v in voted if v in known))[: self.top] if self.enabled else []
        return own + [CLEAN] * (self.clean and CLEAN not in own)

    def log_prior(self, states: Sequence[str]) -> float:
        return -math.log(max(len(states), 1))


@dataclass(frozen=True)
class Config:
    """A decoder's parameters, as its configuration file has them."""

    visual: tuple[float, ...] = ()
    intercept: float = 0.0
    geometry: tuple[float, ...] = ()
    boundary: tuple[float, ...] = ()
    mean: tuple[float, ...] = ()
    std: tuple[float, ...] = ()
    clip: float = 4.0
    temperature: float = 1.0
    alpha: float = 0.0
    beta: float = 0.0
    states: States = field(default_factory=States)
    calibration: tuple[tuple[float, float], ...] = ()
    reject: bool = False
    reject_confidence: float = 0.0
    reject_margin: float = 0.0
    k: int = 8
    alternatives: int = 8
    unknown: float = -8.0
    background: float = 0.0
    use_max: bool = False
    prior: Mapping = field(default_factory=dict)

    def faults(self) -> list[str]:
        """What is wrong with it, each in a few words."""
        finite = lambda x: math.isfinite(x)
        x, y = ([p[i] for p in self.calibration] for i in (0, 1))
        rising = lambda v, strict: all(b > a if strict else b >= a for a, b in zip(v, v[1:], strict=False))
        rules = [(f"{name}: {len(getattr(self, name))} values, not {n}", len(getattr(self, name)) == n) for name, n in {**SIZES, "mean": sum(SIZES.values()), "std": sum(SIZES.values())}.items()]
        rules += [(f"{name}: not all finite", all(map(finite, getattr(self, name)))) for name in (*SIZES, "mean", "std")]
        rules += [
            ("std: negative", all(s >= 0 for s in self.std)),
            ("intercept, background: not finite", finite(self.intercept) and finite(self.background)),
            ("temperature, clip: not positive", all(finite(v) and v > 0 for v in (self.temperature, self.clip))),
            ("alpha: not in [0, 2]", finite(self.alpha) and 0 <= self.alpha <= 2),
            ("beta: negative", finite(self.beta) and self.beta >= 0),
            ("unknown: positive", finite(self.unknown) and self.unknown <= 0),
            ("k, alternatives: less than 1", min(self.k, self.alternatives) >= 1),
            ("calibration: x not rising in [0, 1]", all(0 <= v <= 1 for v in x) and rising(x, True)),
            ("calibration: y not monotone in [0, 1]", all(0 <= v <= 1 for v in y) and rising(y, False)),
            ("reject: thresholds outside [0, 1] and [0, 10]", 0 <= self.reject_confidence <= 1 and 0 <= self.reject_margin <= 10),
        ]
        return [what for what, ok in rules if not ok]


#: Where a configuration file has the parameters.
PLACES = {
    "visual": ("local_ranker", "coef"), "intercept": ("local_ranker", "intercept"), "geometry": ("geometry_weights", "coef"), "boundary": ("boundary_weights", "coef"),
    "mean": ("feature_normalization", "mean"), "std": ("feature_normalization", "std"), "clip": ("feature_normalization", "clip"), "temperature": ("temperature",),
    "alpha": ("length_alpha",), "beta": ("length_beta",), "calibration": ("confidence_calibration",), "reject": ("reject", "enabled"), "reject_confidence": ("reject", "confidence_threshold"),
    "reject_margin": ("reject", "margin_threshold"), "k": ("k_best",), "alternatives": ("num_alternatives",), "unknown": ("unknown_log_prob",), "background": ("background_logit",),
    "use_max": ("max_state_approx",), "prior": ("domain_prior",),
}


def read_config(block: Mapping) -> Config:
    """The decoder block of a configuration; raises with all that is wrong."""
    values = {}
    for name, path in PLACES.items():
        at = block
        for key in path:
            at = (at or {}).get(key) if isinstance(at, Mapping) or at is None else None
        if at is not None:
            kind = type(getattr(Config(), name))
            values[name] = tuple(tuple(map(float, p)) if isinstance(p, (list, tuple)) else float(p) for p in at) if kind is tuple else kind(at)
    states = block.get("render_states") or {}
    own = Config(states=States(int(states.get("top_m", 3)), bool(states.get("enabled", True)), bool(states.get("clean_fallback", True))), **values)
    faults = own.faults()
    faults += [f"{k}: not {v!r}" for k, v in (("version", VERSION), ("score_type", KIND), ("feature_schema_version", FEATURE_VERSION)) if block.get(k, v) != v]
    if states.get("state_prior", "uniform") != "uniform":
        faults.append("render_states: prior not uniform")
    if faults:
        raise ValueError("decoder configuration: " + "; ".join(faults))
    return own


def load_config(config: Mapping | None) -> tuple[Config | None, str | None]:
    """(configuration, why there is none). Without a block, or with one of an earlier version, there is none and no fault; a faulty one is told."""
    block = (config or {}).get("decoder")
    try:
        if not isinstance(block, Mapping) or int(block.get("version", 1)) < VERSION:
            return None, None
    except (TypeError, ValueError):
        return None, None
    try:
        return read_config(block), None
    except ValueError as fault:
        return None, str(fault)


def part_of(config: Config, name: str) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Mean and deviation of one group of features; the groups stand one after another."""
    at = 0
    for group, n in SIZES.items():
        if group == name:
            return config.mean[at : at + n], config.std[at : at + n]
        at += n
    raise KeyError(name)


def option_scores(features: DataFrame, boundaries: DataFrame, prior: DataFrame, config: Config, allowed: DataFrame | None = None) -> DataFrame:
    """(line_id, state, start, end, rank, char_id, visual, geometry, boundary, domain, anomalous) of every option.

    ``features``: line_id, state, start, end, rank, char_id, f_visual, f_geometry; ``boundaries``: line_id, start, end, f_boundary, anomalous; ``prior``: char_id, log_p.
    An option's visual log probability is its tempered logit against the other options of its candidate and a background; a candidate without an allowed option has
    one unknown (char_id -1).
    """
    normal = lambda c, name: normalize_features(F.col(c), *part_of(config, name), config.clip)
    own = features if allowed is None else features.join(allowed.select("char_id").distinct(), "char_id", "left_semi")
    own = own.withColumn("logit", linear(normal("f_visual", "visual"), config.visual, config.intercept) / config.temperature)
    own = own.withColumn("geometry", clamp(linear(normal("f_geometry", "geometry"), config.geometry, 0.0), *EVIDENCE))
    each = Window.partitionBy("line_id", "state", "start", "end")
    top = F.greatest(F.max("logit").over(each), F.lit(config.background))
    own = own.withColumn("_top", top).withColumn("visual", F.col("logit") - F.col("_top") - F.ln(F.sum(F.exp(F.col("logit") - F.col("_top"))).over(each) + F.exp(F.lit(config.background) - F.col("_top"))))
    own = own.join(prior.select("char_id", F.col("log_p").alias("domain")), "char_id", "left").withColumn("domain", F.coalesce("domain", F.lit(float("-inf"))))
    keys = ["line_id", "state", "start", "end"]
    own = own.select(*keys, "rank", F.col("char_id").cast("long").alias("char_id"), "visual", "geometry", "domain")
    spans = features.select("line_id", "state").distinct().join(boundaries.select("line_id", "start", "end"), "line_id")
    none = spans.join(own.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit(0).alias("rank"), F.lit(-1).cast("long").alias("char_id"), F.lit(config.unknown).alias("visual"), F.lit(0.0).alias("geometry"), F.lit(0.0).alias("domain"))
    edge = boundaries.select("line_id", "start", "end", "anomalous", clamp(linear(normal("f_boundary", "boundary"), config.boundary, 0.0), *EVIDENCE).alias("boundary"))
    return own.unionByName(none).join(edge, ["line_id", "start", "end"])


Path = tuple[tuple[int, int, int], ...]


def state_paths(options: list[dict], config: Config) -> list[tuple[float, int, str, Path]]:
    """The k best (score, anomalies, text, path) under one state. Partial paths compete by normalised score, then anomalies, then text."""
    last = max(o["end"] for o in options)
    key = lambda p: (-p[0] / (len(p[3]) + config.beta) ** config.alpha if p[3] else 0.0, p[1], p[2], p[3])
    kept: dict[int, list[tuple[float, int, str, Path]]] = {0: [(0.0, 0, "", ())]}
    for end in sorted({o["end"] for o in options}):
        grown = {}
        for o in options:
            if o["end"] == end > o["start"]:
                gain = o["visual"] + o["geometry"] + o["boundary"] + o["domain"]
                for score, odd, text, path in kept.get(o["start"], ()):
                    further = (*path, (o["start"], end, o["char_id"]))
                    grown.setdefault(further, (score + gain, odd + bool(o["anomalous"]), text + o["ch"], further))
        kept[end] = sorted(grown.values(), key=key)[: config.k]
    return kept[last]


def log_sum(values: Sequence[float]) -> float:
    top = max(values)
    return top if not math.isfinite(top) else top + math.log(sum(math.exp(v - top) for v in values))


def merged(by_state: dict[str, list[tuple[float, int, str, Path]]], config: Config) -> list[tuple[float, float, str, int, str, Path]]:
    """(normalised, total, best state, anomalies, text, path) of the paths of all states, best first. A path's total is over the states that kept it."""
    scores: dict[Path, dict[str, float]] = {}
    about: dict[Path, tuple[int, str]] = {}
    for state, paths in by_state.items():
        for score, odd, text, path in paths:
            scores.setdefault(path, {})[state] = float("-inf") if math.isnan(score) else score
            about[path] = (odd, text)
    out = []
    for path, own in scores.items():
        total = max(own.values()) if config.use_max else log_sum(list(own.values()))
        out.append((total / (len(path) + config.beta) ** config.alpha, total, max(own, key=own.get), *about[path], path))
    return sorted(out, key=lambda p: (-p[0], p[3], p[4], p[5]))


DECODED = "line_id long, text string, path string, score double, normalised double, share double, margin double, state string, searched int, visual double, geometry double, boundary double, domain double, alternatives array<string>"
KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
ARROW = pa.schema([(c, KINDS[k]) for c, k in (x.split(" ") for x in DECODED.split(", "))])


def decode_line(line: int, options: list[dict], config: Config) -> tuple:
    by_state: dict[str, list] = {}
    for o in options:
        by_state.setdefault(o["state"], []).append(o)
    found = merged({z: state_paths(own, config) for z, own in sorted(by_state.items())}, config)
    if not found:
        return line, "", "", 0.0, 0.0, 0.0, 0.0, None, 0, 0.0, 0.0, 0.0, 0.0, []
    norm, total, state, _, text, path = found[0]
    share = math.exp(min(0.0, max(-30.0, norm - log_sum([f[0] for f in found])))) if math.isfinite(norm) else 0.0
    margin = norm - found[1][0] if len(found) > 1 and math.isfinite(found[1][0]) else 0.0
    chosen = {(o["start"], o["end"], o["char_id"]): o for o in by_state[state]}
    sums = [sum(chosen[step][c] for step in path) for c in ("visual", "geometry", "boundary", "domain")]
    others = [t for t in dict.fromkeys(f[4] for f in found[1:]) if t and t != text]
    return line, text, ",".join(f"{a}-{b}" for a, b, _ in path), total, norm, share, margin, state, len(found), *sums, others[: config.alternatives]


def decode_lattice(options: DataFrame, charset: DataFrame, config: Config) -> DataFrame:
    """One row per line: text, spans, score, confidence, margin, decomposition, best state, alternatives, and why it would be rejected (null: it wouldn't).

    ``options`` as ``option_scores`` gives them; one row for each state, candidate and character.
    """
    named = options.join(charset.select(F.col("char_id").cast("long").alias("char_id"), "ch"), "char_id", "left").withColumn("ch", F.coalesce("ch", F.lit(UNKNOWN)))
    fields = ["state", "end", "start", "rank", "char_id", "ch", "visual", "geometry", "boundary", "domain", "anomalous"]
    lines = named.groupBy("line_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("options"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [decode_line(line, own, config) for line, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(ARROW), ARROW, strict=True)], schema=ARROW)

    out = lines.mapInArrow(run, DECODED).withColumn("confidence", calibrate_monotone(F.col("share"), config.calibration))
    reason = F.when(F.lit(config.reject) & (F.col("confidence") < config.reject_confidence), "confidence").when(F.lit(config.reject) & (F.col("margin") < config.reject_margin), "margin")
    return out.withColumn("rejected", reason).drop("share")


def random_config(seed: int = 0, **more) -> Config:
    """A valid configuration of random weights, for tests and trials."""
    r = np.random.default_rng(seed)
    draw = lambda n, scale=1.0: tuple(float(v) for v in r.normal(size=n) * scale)
    every = sum(SIZES.values())
    return Config(visual=draw(SIZES["visual"], 0.3), geometry=draw(SIZES["geometry"], 0.2), boundary=draw(SIZES["boundary"], 0.2), mean=draw(every), std=tuple(float(v) for v in r.uniform(0.5, 2, every)), **more)
