"""Toxic passages as maximum-scoring segments of token log-odds.

Learning: over at most ``TRAIN_ROWS`` labelled rows (those of the smallest hash of their id; the bound is this
parameter; equal texts of a label count once) the documents that hold a word, or a word's beginning, are counted by label. A feature's
log-odds ratio uses an informative Dirichlet prior, its weight in both classes being ``LEAST_PRIOR`` plus ``PRIOR`` times its share of the whole sample; its z-score is the ratio over its standard deviation.
The ``FEATURES`` features of largest |z| are kept, which bounds the model. A word scores as its feature of largest |z|, less ``DRIFT``,
so that clean text has a negative expected score.

Scoring: one linear scan (Ruzzo and Tompa) finds all maximal segments. With lambda the positive root of
E[exp(lambda s)] = 1 on clean words, a segment S among n words has the normalised score lambda S - ln(K n), whose
exceedance under clean text is extreme-value distributed; segments with an expected count under ``E_VALUE`` are significant. A document's
largest normalised score and the sum over its significant segments enter a logistic calibration, fitted on the sample.

Defined results: a null or empty text has no words and gets the calibrated score of that; without labelled rows of both
classes every score is the prior (0 without any label); repeated rows each give a row; a null doc_id is not held out; labels given twice count as toxic if one is;
words over ``LONGEST`` characters have no feature; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, filter_texts, id_and_text, map_texts, small_batches, texts_of

TRAIN_ROWS = 20_000
FEATURES = 20_000
LEAST_PRIOR = 0.5
PRIOR = 100.0
DRIFT = 0.7
LEAST_Z = 3.0
LEAST_COUNT = 3
E_VALUE = 0.01
K = 0.1
LONGEST = 32
STEMS = (4, 5, 6)
FEATURES_HELD = 300_000
FOLDS, HELD_OUT = 5, 0

WORD = re.compile(r"[^\W\d_]+")
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_segments long, segments string"
ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_segments", pa.int64()), ("segments", pa.string())])


def features_of(word: str) -> list[str]:
    """The word and its beginnings, most specific first; a beginning is marked so that it isn't taken for a word."""
    if len(word) > LONGEST:
        return []
    return [word, *(f"{word[:n]}*" for n in reversed(STEMS) if len(word) > n)]


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


@dataclass
class Model:
    """Feature -> (log-odds, z); the background's lambda; the calibration's weights."""

    weights: dict[str, tuple[float, float]] = field(default_factory=dict)
    rate: float = 1.0
    calibration: tuple[float, float, float] | None = None
    prior: float = 0.0
    words: dict[str, float] = field(default_factory=dict, repr=False)

    def word_score(self, word: str) -> float:
        found = self.words.get(word)
        if found is None:
            known = [self.weights[f] for f in features_of(word) if f in self.weights]
            found = (max(known, key=lambda x: abs(x[1]))[0] if known else 0.0) - DRIFT
            if len(word) <= LONGEST:
                if len(self.words) >= FEATURES_HELD:
                    self.words.clear()
                self.words[word] = found
        return found

    def segments(self, text: str) -> tuple[int, list[tuple[float, int, int]]]:
        """Number of words, and (score, first, last) of all maximal segments, in words."""
        scores = list(map(self.word_score, WORD.findall(text.lower())))
        return len(scores), maximal_segments(scores)

    def evidence(self, n: int, segments: list[tuple[float, int, int]]) -> tuple[float, float]:
        """Largest normalised score, and the sum over significant segments, both on a log scale that is 0 for none."""
        norm = math.log(K * n + 1)
        best = max((self.rate * s for s, _, _ in segments), default=0.0) - norm if segments else -norm
        total = sum(x for s, _, _ in segments if (x := self.rate * s - norm) > -math.log(E_VALUE))
        return best, math.log1p(total)

    def score(self, evidence: tuple[float, float]) -> float:
        if self.calibration is None:
            return self.prior
        a, b, c = self.calibration
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, a + b * evidence[0] + c * evidence[1]))))


def maximal_segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments in one pass: (score, first, last), in order. Amortised linear time."""
    if not scores or max(scores) <= 0:
        return []
    # Of each segment: first and last word, total before it, total with it; and the nearest earlier one with a lower total before it.
    stack: list[tuple[int, int, float, float, int]] = []
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        first, last, low, high = i, i, before, total
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append((first, last, low, high, j))
                break
            first, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(high - low, first, last) for first, last, low, high, _ in stack]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of features by label, added up in the task."""
    held: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def rows() -> pa.RecordBatch:
        names = list(held[0].keys() | held[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(names, type=pa.string()), *(pa.array([held[y][f] for f in names], type=pa.int64()) for y in (0, 1))], names=["feature", "n0", "n1"])
        held[0].clear()
        held[1].clear()
        return out

    for batch in small_batches(batches):
        for toxic, text in zip(batch.column(2).to_pylist(), texts_of(batch.column(1)), strict=True):
            held[toxic].update({f for w in set(WORD.findall(text.lower())) for f in features_of(w)})
        if len(held[0]) + len(held[1]) >= FEATURES_HELD:
            yield rows()
    yield rows()


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """The labelled rows to learn from, with their texts."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    ids = ids.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT)
    ids = ids.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = id_and_text(docs).join(F.broadcast(ids), "doc_id")  # at most ``rows`` pairs of numbers
    return found.select("doc_id", "text", "toxic", F.sha2("text", 256).alias("same")).dropDuplicates(["same", "toxic"]).drop("same")


def background_rate(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(share * exp(rate * score)) = 1; 1 where the mean score isn't negative or no score is positive."""
    if not len(scores) or scores.max() <= 0 or (scores * shares).sum() >= 0:
        return 1.0
    value = lambda r: float((shares * np.exp(np.minimum(r * scores, 50))).sum()) - 1
    low, high = 0.0, 1.0
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return high


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, ...]:
    """Newton steps on three weights, with a small ridge on the slopes."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6, ridge, ridge])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, features: int = FEATURES) -> Model:
    """Fit on the sample. What reaches the driver is bounded by ``rows`` and ``features``."""
    train = cut(sample(docs, labels, rows), "toxicity-sample")
    counts = cut(train.mapInArrow(_count, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "toxicity-counts")
    words = counts.where("feature not like '%*'")
    total = words.agg(F.coalesce(F.sum("n0"), F.lit(0)).alias("N0"), F.coalesce(F.sum("n1"), F.lit(0)).alias("N1")).first()
    toxic = train.agg(F.avg("toxic")).first()[0]
    if not total.N0 or not total.N1:
        return Model(prior=float(toxic or 0))
    prior = F.lit(LEAST_PRIOR) + F.lit(PRIOR / (total.N0 + total.N1)) * (F.col("n0") + F.col("n1"))
    odds = lambda n, size: F.log((F.col(n) + prior) / (F.greatest(F.lit(size + PRIOR) - F.col(n) - prior, F.lit(0.5))))
    scored = counts.where(F.col("n0") + F.col("n1") >= LEAST_COUNT).withColumn("odds", odds("n1", total.N1) - odds("n0", total.N0))
    scored = scored.withColumn("z", F.col("odds") / F.sqrt(1 / (F.col("n1") + prior) + 1 / (F.col("n0") + prior)))
    kept = scored.where(F.abs("z") >= LEAST_Z).orderBy(F.abs("z").desc(), "feature").limit(features).collect()
    model = Model(weights={r.feature: (r.odds, r.z) for r in kept}, prior=float(toxic))

    # The background is the clean words. Words without a kept feature all score the same, so only the others are listed.
    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[round(model.word_score(w), 2)] += n
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), type=pa.float64()), pa.array(held.values(), type=pa.int64())], names=["score", "n"])

    clean = words.where("n0 > 0").select("feature", "n0").mapInArrow(shares, "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).collect()  # scores have two digits
    model.rate = background_rate(np.array([r.score for r in clean]), np.array([r.n for r in clean]) / max(1, sum(r.n for r in clean)))

    def kernel():
        def one(text: str) -> tuple:
            return model.evidence(*model.segments(text))

        return one

    seen = map_texts(train.select("doc_id", "text"), kernel, "doc_id long, best double, total double", pa.schema([("doc_id", pa.int64()), ("best", pa.float64()), ("total", pa.float64())]))
    pairs = seen.join(train.select("doc_id", "toxic").distinct(), "doc_id").select("best", "total", "toxic").toPandas()
    model.calibration = fit_logistic(pairs[["best", "total"]].to_numpy(), pairs["toxic"].to_numpy(dtype=float))
    model.words.clear()
    return model


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: score, prediction, and its significant segments as ``first:last:score`` in words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by FEATURES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in small_batches(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                n, found = own.segments(text)
                score = own.score(own.evidence(n, found))
                norm = math.log(K * n + 1)
                good = [(s, a, b) for s, a, b in found if own.rate * s - norm > -math.log(E_VALUE)]
                rows.append((doc_id, is_held_out(doc_id), score, int(score >= 0.5), len(good), ",".join(f"{a}:{b}:{s:.2f}" for s, a, b in good)))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that score under 0.5, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by FEATURES

    def kernel():
        own = shared.value
        return lambda raws: [own.score(own.evidence(*own.segments(r.decode("utf-8", "replace")))) < 0.5 for r in raws]

    return filter_texts(docs, kernel, text_col)
