"""Lexicon-aware decoding of candidate lattices.

The lattice is a table of options: one row for each candidate range and character, with its visual score, geometry and
the character's prior. Priors and terms are joined as tables; the search itself depends on order and runs as a kernel over one
line at a time, many lines in a batch. A line is bounded by its screen width.

A path's score is mean visual + mean geometry + 0.2 lexicon (1 - visual) + 0.15 mean gated prior - 0.005 (n - 1); a character's
prior is gated by 1 - its visual score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import characters
from .lexicon import SCORES, small_enough
from .probability import CHAR_PRIOR_BASE, char_counts, gated_char_prior

UNKNOWN = "?"
TIE = 1e-12


@dataclass(frozen=True)
class Weights:
    """The weights of the score, what the best-path search adds for prefixes and whole terms, and its widths."""

    visual: float = 1.0
    geometry: float = 1.0
    lexicon: float = 0.2
    prior: float = 0.15
    segment: float = 0.005
    prefix: float = 0.02
    term: float = 0.06
    beam: int = 16
    alternatives: int = 8

    def __post_init__(self):
        if self.beam < 1 or self.alternatives < 1 or min(self.visual, self.geometry, self.lexicon, self.prior, self.segment) < 0:
            raise ValueError("widths are at least 1, weights are not negative")


@dataclass(frozen=True)
class Option:
    start: int
    end: int
    char: str
    visual: float
    geometry: float
    prior: float

    @property
    def doubt(self) -> float:
        return 1.0 - min(1.0, max(0.0, self.visual))


class Terms:
    """A lexicon for the kernel: the prefixes of its terms, and the score of a visible text's best match."""

    def __init__(self, terms: Iterable[str]):
        self.terms = frozenset(t for t in terms if t)
        self.prefixes = frozenset(t[:k] for t in self.terms for k in range(1, len(t) + 1))
        self.longest = max(map(len, self.terms), default=0)
        self.holding: dict[str, list[str]] = {}
        for t in self.terms:
            for ch in set(t):
                self.holding.setdefault(ch, []).append(t)
        self.known: dict[str, float] = {"": 0.0}

    def step(self, prefix: str, ch: str) -> tuple[str, bool, bool]:
        """The longest prefix after one more character (a new one may begin there), whether there is any, and whether it is a term."""
        for now in (prefix + ch, ch):
            if now in self.prefixes:
                return now, True, now in self.terms
        return "", False, False

    def score(self, text: str) -> float:
        if text not in self.known:
            if len(self.known) > 100_000:
                self.known = {"": 0.0}
            self.known[text] = self.best(text)
        return self.known[text]

    def best(self, text: str) -> float:
        if text in self.terms:
            return SCORES["exact"]
        n = len(text)
        found = [SCORES["term_in_text"]] if any(text[a:b] in self.terms for a in range(n) for b in range(a + 1, min(n, a + self.longest) + 1)) else []
        for t in self.holding.get(text[0], ()):
            if text in t:
                found.append(SCORES["prefix_crop" if t.startswith(text) or t.endswith(text) else "inner_crop"])
            elif n <= len(t):
                found.append(gap_score(text, t))
        return max(found, default=0.0)


def gap_score(text: str, term: str) -> float:
    """Greedy subsequence: 0.70 less 0.12 for each character left out within its span, at least 0.20; 0.05 less if both sides of the term are cut, then at least 0.15."""
    at, first = -1, None
    for ch in text:
        at = term.find(ch, at + 1)
        if at < 0:
            return 0.0
        first = at if first is None else first
    score = max(0.20, 0.70 - 0.12 * (at - first + 1 - len(text)))
    return max(0.15, score - 0.05) if first > 0 and at + 1 < len(term) else score


def total(path: tuple[Option, ...], weights: Weights, terms: Terms | None) -> tuple[float, float]:
    """(score, mean visual) of a path."""
    n = len(path)
    if not n:
        return 0.0, 0.0
    visual, geometry = sum(o.visual for o in path) / n, sum(o.geometry for o in path) / n
    prior = sum(o.prior * o.doubt for o in path) / n
    doubt = 1.0 - min(1.0, max(0.0, visual))
    matched = terms.score(text_of(path)) if terms else 0.0
    return weights.visual * visual + weights.geometry * geometry + weights.lexicon * matched * doubt + weights.prior * prior - weights.segment * (n - 1), visual


def text_of(path: tuple[Option, ...]) -> str:
    return "".join(o.char for o in path)


def best_path(options: list[Option], weights: Weights, terms: Terms | None) -> tuple[Option, ...]:
    """One state for each (end, lexicon prefix): the best mean of local scores, less the segments. Earlier options win ties."""
    if not options:
        return ()
    last = max(o.end for o in options)
    # Of each place: prefix -> (sum of local scores, length, path as a linked list).
    states: dict[int, dict[str, tuple[float, int, tuple | None]]] = {0: {"": (0.0, 0, None)}}
    rank = lambda s: s[0] / s[1] - weights.segment * (s[1] - 1)
    for end, group in groupby(sorted(options, key=lambda o: o.end), key=lambda o: o.end):  # a stable sort
        here = states.setdefault(end, {})
        for o in group:
            base = weights.visual * o.visual + weights.geometry * o.geometry + weights.prior * o.prior * o.doubt
            for prefix, (total_, n, path) in states.get(o.start, {}).items():
                after, begun, whole = terms.step(prefix, o.char) if terms else ("", False, False)
                state = (total_ + base + o.doubt * (weights.prefix * begun + weights.term * whole), n + 1, (path, o))
                if after not in here or rank(state) > rank(here[after]) + TIE:
                    here[after] = state
    best = None
    for state in states[last].values():
        if best is None or rank(state) > rank(best) + TIE:
            best = state
    out, node = [], best[2] if best else None
    while node:
        node, o = node
        out.append(o)
    return tuple(reversed(out))


def beam_paths(options: list[Option], weights: Weights, terms: Terms | None) -> list[tuple[Option, ...]]:
    """The complete paths that the beam holds at its end. Complete ones keep competing with those that still grow."""
    last = max((o.end for o in options), default=0)
    following: dict[int, list[Option]] = {}
    for o in options:
        following.setdefault(o.start, []).append(o)
    beam: list[tuple[Option, ...]] = [()]
    for _ in range(last):
        grown = [p for p in beam if p and p[-1].end >= last]
        grown += [(*p, o) for p in beam if not p or p[-1].end < last for o in following.get(p[-1].end if p else 0, ()) if o.end > o.start]
        if not grown:
            break
        beam = sorted(grown, key=lambda p: -total(p, weights, terms)[0])[: weights.beam]
    return list(dict.fromkeys(p for p in beam if p and p[-1].end == last))


def ranked_paths(options: list[Option], weights: Weights, terms: Terms | None, beam: bool = True) -> list[tuple[float, float, tuple[Option, ...]]]:
    """(score, mean visual, path), best first; ties by fewer segments, then by text. The best path of the plain search always takes part."""
    paths = dict.fromkeys(p for p in [best_path(options, weights, terms), *(beam_paths(options, weights, terms) if beam else [])] if p)
    return sorted(((*total(p, weights, terms), p) for p in paths), key=lambda x: (-x[0], len(x[2]), text_of(x[2])))


def with_unknowns(options: DataFrame, spans: DataFrame) -> DataFrame:
    """Every candidate range has an option: ranges without a known character get ``?`` with a visual score of 0."""
    none = spans.join(options.select("line_id", "start", "end").distinct(), ["line_id", "start", "end"], "left_anti")
    return options.unionByName(none.select("line_id", "start", "end", F.lit(0).alias("rank"), F.lit(UNKNOWN).alias("char"), F.lit(0.0).alias("visual"), F.lit(0.0).alias("geometry")))


def relevant_terms(options: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(line_id, terms): the terms that share a character with an option of the line; others neither match nor begin there."""
    chars = options.select("line_id", "char").distinct()
    index = lexicon.select(F.explode(F.array_distinct(characters(F.col("term")))).alias("char"), "term")
    return chars.join(index, "char").groupBy("line_id").agg(F.collect_set("term").alias("terms"))


SCHEMA = "line_id long, text string, path string, n int, score double, confidence double, alternatives array<string>"
ARROW = pa.schema([("line_id", pa.int64()), ("text", pa.string()), ("path", pa.string()), ("n", pa.int32()), ("score", pa.float64()), ("confidence", pa.float64()), ("alternatives", pa.list_(pa.string()))])


def decode_lattice(options: DataFrame, lexicon: DataFrame | None = None, weights: Weights | None = None, beam: bool = True) -> DataFrame:
    """One row per line: the best path's text, spans, score and confidence, and the next texts.

    ``options``: line_id, start, end, rank, char, visual, geometry. A lexicon of a checked size goes to all tasks; of a larger one, each line
    gets the terms it can need.
    """
    weights = weights or Weights()
    own = options.withColumn("prior", F.lit(0.0))
    small = True
    if lexicon is not None:
        priors = gated_char_prior(char_counts(lexicon)).select(F.col("ch").alias("char"), F.col("prior").alias("known"))
        own = options.join(priors, "char", "left").withColumn("prior", F.coalesce("known", F.lit(CHAR_PRIOR_BASE)))
        small = small_enough(lexicon)
    lines = own.groupBy("line_id").agg(F.sort_array(F.collect_list(F.struct("end", "start", "rank", "char", "visual", "geometry", "prior"))).alias("options"))
    if small:
        lines = lines.withColumn("terms", F.lit(None).cast("array<string>"))
        shared = options.sparkSession.sparkContext.broadcast([r.term for r in lexicon.select("term").collect()] if lexicon is not None else None)
    else:
        lines = lines.join(relevant_terms(options, lexicon), "line_id", "left")
        shared = options.sparkSession.sparkContext.broadcast([])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = Terms(shared.value) if shared.value is not None else None
        for batch in batches:
            rows = []
            for line, options_, own_terms in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                terms = Terms(own_terms) if own_terms is not None else every
                found = ranked_paths([Option(x["start"], x["end"], x["char"], x["visual"], x["geometry"], x["prior"]) for x in options_], weights, terms, beam)
                if not found:
                    rows.append((line, "", "", 0, 0.0, 0.0, []))
                    continue
                score, visual, path = found[0]
                others = [t for t in dict.fromkeys(text_of(p) for _, _, p in found[1:]) if t and t != text_of(path)]
                rows.append((line, text_of(path), ",".join(f"{o.start}-{o.end}" for o in path), len(path), score, min(1.0, max(0.0, visual)), others[: weights.alternatives]))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(ARROW), ARROW, strict=True)], schema=ARROW)

    return lines.mapInArrow(run, SCHEMA)
