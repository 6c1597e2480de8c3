"""Cross-frame tracking: change flags, a sliding vote, a cache of results, fused evidence; in batch and as a stream."""

from __future__ import annotations

from collections import Counter, OrderedDict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Frames in the vote, least frames and share, results in the cache.
WINDOW, MIN_FRAMES, RATIO, CACHE = 8, 3, 0.6, 32


def change_flags(frames: DataFrame, key: str, order: list[str], signature: str) -> DataFrame:
    """Whether a frame differs from the one before; the first never does."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag(signature).over(w)
    return frames.withColumn("changed", F.coalesce(F.col(signature) != before, F.lit(False)))


def stable_votes(frames: DataFrame, key: str, order: list[str], text: str, window: int = WINDOW, least: int = MIN_FRAMES, ratio: float = RATIO) -> DataFrame:
    """The modal text of the last frames where it has its share, else null; of equal counts the first seen."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - window, 0)
    own = frames.withColumn("_last", F.collect_list(text).over(w))
    counts = F.transform(F.array_distinct("_last"), lambda t, i: F.struct(F.size(F.filter("_last", lambda x: x == t)).alias("n"), (-i).alias("i"), t.alias("t")))
    best = F.array_max(counts)
    enough = (F.size("_last") >= least) & (best["n"] / F.size("_last") >= ratio)
    return own.withColumn("stable", F.when(enough, best["t"])).drop("_last")


def cache_hits(frames: DataFrame, order: list[str], cache_key: str, key: str | None = None, size: int = CACHE) -> DataFrame:
    """Whether an LRU cache of ``size`` results holds a frame's key: at most size - 1 other keys since its last use.

    The stream's frames are walked in order by one kernel for each ``key``; the state is the cache, of ``size`` entries.
    """

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        held: OrderedDict = OrderedDict()
        hits = []
        for k in part.sort_values(order)[cache_key]:
            hits.append(k in held)
            held[k] = True
            held.move_to_end(k)
            if len(held) > size:
                held.popitem(last=False)
        return part.sort_values(order).assign(hit=hits)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.schema) + ", hit boolean"
    return frames.groupBy(key).applyInPandas(walk, schema)


def fused_evidence(frames: DataFrame, key: str, position: str, char: str, logit: str, order: str) -> DataFrame:
    """The character of largest summed evidence at each position; ties by votes, then by being the latest."""
    each = frames.groupBy(key, position, char).agg(F.sum(logit).alias("evidence"), F.count("*").alias("votes"), F.max(order).alias("latest"))
    best = each.groupBy(key, position).agg(F.max(F.struct("evidence", "votes", "latest", char)).alias("b"))
    return best.select(key, position, F.col(f"b.{char}").alias(char), "b.evidence", "b.votes")


def fuse_positions(frames: list[list[tuple[float, float, str, dict[str, float], float]]], align: float = 8.0) -> list[tuple[float, str, float]]:
    """Greedy alignment of characters across frames: (x, w, char, logits, confidence) -> (x, char, confidence).

    Each position joins the nearest slot within 1.5 times the widest of slot, position and ``align`` that no other position of
    its frame took, or opens a slot. A slot's character has the largest summed evidence, then votes, then is the latest.
    """
    slots: list[dict] = []
    for frame in frames:
        taken: set[int] = set()
        for x, w, char, logits, confidence in frame:
            near = [(abs(s["x"] - x), i) for i, s in enumerate(slots) if i not in taken and abs(s["x"] - x) <= max(s["w"], w, align) * 1.5]
            if near:
                i = min(near)[1]
            else:
                i = len(slots)
                slots.append({"x": x, "w": w, "logits": Counter(), "votes": Counter(), "confidence": []})
            slot = slots[i]
            taken.add(i)
            slot["x"], slot["w"], slot["latest"] = x, w, char
            for c, v in logits.items():
                slot["logits"][c] += v
                slot["votes"][c] += 1
            slot["confidence"].append(confidence)
    out = []
    for s in sorted(slots, key=lambda s: s["x"]):
        best = max(s["logits"], key=lambda c: (s["logits"][c], s["votes"][c], c == s["latest"])) if s["logits"] else s["latest"]
        out.append((s["x"], best, sum(s["confidence"]) / len(s["confidence"])))
    return out


def added(high: np.ndarray, low: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A compensated sum and one more value, as Python's ``sum`` takes them."""
    total = high + x
    return total, low + np.where(np.abs(high) >= np.abs(x), (high - total) + x, (x - total) + high)


def fuse_histories(positions: pa.ListArray, seen: np.ndarray, first: int, align: float = 8.0) -> tuple[pa.Array, pa.Array]:
    """(text, confidence) of the rows from ``first`` on, each over its last ``seen`` rows of ``positions``: what ``fuse_positions`` finds, for all rows at once.

    In each step every row places the next position of its next frame; the evidence is summed by row, slot and character in that order.
    """
    struct, n = positions.values, len(positions) - first
    x, w, char, confidence, logits = (struct.field(c) for c in ("x", "w", "char", "confidence", "logits"))
    x, w, confidence, each = (c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (x, w, confidence, logits.items))
    if not all(np.isfinite(c).all() for c in (x, w, confidence, each)):
        found = [fuse_positions([[(p["x"], p["w"], p["char"], dict(p["logits"]), p["confidence"]) for p in f] for f in positions[i + 1 - int(seen[i]) : i + 1].to_pylist()], align) for i in range(first, first + n)]
        return pa.array(["".join(c for _, c, _ in f) if f else None for f in found], pa.string()), pa.array([sum(s for _, _, s in f) / len(f) if f else None for f in found], pa.float64())
    codes = pa.concat_arrays([char, logits.keys]).dictionary_encode()
    code, names = codes.indices.to_numpy().astype(np.int64), codes.dictionary
    begin, at, seen = positions.offsets.to_numpy().astype(np.int64), np.arange(first, first + n), seen[first:]
    size, map_at = np.diff(begin), logits.offsets.to_numpy().astype(np.int64)
    slots = max(1, int(size.max(initial=0)))
    slot_x, slot_w, high, low = (np.zeros((n, slots)) for _ in range(4))
    latest, held, used = np.zeros((n, slots), np.int64), np.zeros((n, slots), np.int64), np.zeros(n, np.int64)
    placed = []
    for back in range(int(seen.max(initial=0)) - 1, -1, -1):
        many = np.where(back < seen, size[np.maximum(at - back, 0)], 0)
        taken = np.zeros((n, slots), bool)
        for p in range(int(many.max(initial=0))):
            row = np.flatnonzero(many > p)
            q = begin[at[row] - back] + p
            k, free = used[row], np.ones(len(row), bool)
            if m := int(k.max()):
                off = np.abs(slot_x[row, :m] - x[q, None])
                near = (off <= np.maximum(slot_w[row, :m], np.maximum(w[q], align)[:, None]) * 1.5) & ~taken[row, :m] & (np.arange(m) < k[:, None])
                off[~near] = np.inf
                best, free = off.argmin(1), ~near.any(1)
                k = np.where(free, k, best)
            used[row[free]] += 1
            if used.max() > slots:
                slot_x, slot_w, high, low, latest, held, taken = (np.pad(a, ((0, 0), (0, slots))) for a in (slot_x, slot_w, high, low, latest, held, taken))
                slots *= 2
            taken[row, k], slot_x[row, k], slot_w[row, k], latest[row, k] = True, x[q], w[q], code[q]
            high[row, k], low[row, k] = added(high[row, k], low[row, k], confidence[q])
            held[row, k] += 1
            placed.append((row, k, q))
    # What stands at each slot: its latest character, or the one of largest evidence, votes, being the latest, being the first.
    shown = latest.copy()
    if placed:
        row, k, q = (np.concatenate(c) for c in zip(*placed, strict=True))
        count = map_at[q + 1] - map_at[q]
        entry = np.repeat(map_at[q] - np.cumsum(count) + count, count) + np.arange(count.sum())
        one, kinds = np.repeat(row * slots + k, count), len(names)
        own, begun, group = np.unique(one * kinds + code[len(char) + entry], return_index=True, return_inverse=True)
        evidence, votes, slot, letter = np.bincount(group, each[entry]), np.bincount(group), own // max(1, kinds), own % max(1, kinds)
        order = np.lexsort((begun, letter != latest.ravel()[slot], -votes, -evidence, slot))
        lead = order[np.flatnonzero(np.diff(slot[order], prepend=-1))]
        shown.ravel()[slot[lead]] = letter[lead]
    whole = np.arange(slots) < used[:, None]
    order = np.argsort(np.where(whole, slot_x, np.inf), axis=1, kind="stable")
    in_order = lambda a: np.take_along_axis(a, order, 1)
    offsets = np.concatenate(([0], np.cumsum(used)))
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names.take(pa.array(in_order(shown)[whole]))), "")
    sure = in_order((high + low) / np.maximum(held, 1))
    top, rest = np.zeros(n), np.zeros(n)
    for k in range(int(used.max(initial=0))):
        more = added(top, rest, sure[:, k])
        top, rest = (np.where(k < used, new, old) for new, old in zip(more, (top, rest), strict=True))
    none = used == 0
    return pc.if_else(pa.array(none), pa.scalar(None, pa.string()), texts), pa.array((top + rest) / np.maximum(used, 1), mask=none)


STATE = "signature string, texts array<string>"
OUTPUT = "key string, seq long, changed boolean, text string, stable string"


class Track:
    """State of one stream: the last signature and the last texts."""

    def __init__(self, signature: str | None = None, texts=(), window: int = WINDOW, least: int = MIN_FRAMES, ratio: float = RATIO):
        self.signature, self.texts, self.least, self.ratio = signature, deque(texts, maxlen=window), least, ratio

    def update(self, signature: str, text: str) -> tuple[bool, str | None]:
        changed = self.signature is not None and signature != self.signature
        self.signature = signature
        self.texts.append(text)
        best, n = Counter(self.texts).most_common(1)[0]
        ok = len(self.texts) >= self.least and n / len(self.texts) >= self.ratio
        return changed, best if ok else None


def track_stream(frames: DataFrame) -> DataFrame:
    """Stateful tracking of a stream (key, seq, signature, text). Frames of a batch are put in order of seq.

    State is keyed and bounded by the window, and lives in the state store, so a lost executor resumes from its checkpoint.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        track = Track(*state.get) if state.exists else Track()
        rows = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            changed, stable = track.update(r.signature, r.text)
            rows.append((key[0], r.seq, changed, r.text, stable))
        state.update((track.signature, list(track.texts)))
        yield pd.DataFrame(rows, columns=["key", "seq", "changed", "text", "stable"])

    return frames.groupBy("key").applyInPandasWithState(step, OUTPUT, STATE, "append", "NoTimeout")
