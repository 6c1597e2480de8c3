"""Benchmark decontamination with training suffix arrays.

Each task builds suffix arrays over shards of its own documents and looks every test window up in them by binary search;
an interval of the array is all places where the window stands verbatim. Documents are never shuffled: a document lies
whole in one shard, so its answer is complete where it is read. Only suffixes that begin a run of benchmark words long
enough for a window are kept in an array, since no other suffix can match. The array is sorted by as many words as the longest
window has, which decides every lookup; longer verbatim matches are chains of windows that follow one another in document and item alike: their union marks the words, and the longest of
them is returned with its place in both. All longest matches are returned on request.

The benchmark goes to the tasks as blocks of at most ``BLOCK_CHARS`` characters (one item at least). One block is the
usual case; further blocks run one after another over the same rows, each adding to the words already hit.

Defined results: a null or empty text, or one without words, has no hits; an item without words has no windows; an item
of fewer than ``WINDOW`` words is one window; equal windows of several items count for each; repeated rows each give a
row; null ids are kept for documents and left out for items; empty tables give empty or clean results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, filter_texts, id_and_text, raw_texts, small_batches

WINDOW = 10
#: Characters of benchmark text in one block, and words of documents in one shard.
BLOCK_CHARS = 16_000_000
SHARD_WORDS = 500_000

#: Every byte outside 0-9, a-z and the non-ASCII range ends a word.
SPACES = bytes(32 if b < 128 and not (48 <= b <= 57 or 97 <= b <= 122) else b for b in range(256))

FIELDS = {"doc_id": ("long", pa.int64()), "text": ("string", pa.string()), "n_words": ("long", pa.int64()), "n_hit": ("long", pa.int64()), "hits": ("binary", pa.binary()), "items": ("array<string>", pa.list_(pa.string())), "longest": ("struct<length:int,doc_start:int,item:string,item_start:int>", pa.struct([("length", pa.int32()), ("doc_start", pa.int32()), ("item", pa.string()), ("item_start", pa.int32())]))}
MATCH = ("array<struct<doc_start:int,item:string,item_start:int,length:int>>", pa.list_(pa.struct([("doc_start", pa.int32()), ("item", pa.string()), ("item_start", pa.int32()), ("length", pa.int32())])))


#: Columns of the longest match in the report: without one it has no words, no item, and places of -1.
LONGEST = [("length", "longest", 0, "long"), ("doc_start", "longest_start", -1, "long"), ("item", "longest_item", "", "string"), ("item_start", "longest_item_start", -1, "long")]


def words_of(raw: bytes) -> list[bytes]:
    """Lower-cased words of a UTF-8 text: [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+."""
    return raw.lower().translate(SPACES).split()


class Windows:
    """The windows of a block of items, as integer words packed into fixed-width keys that compare as sequences."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW, places_too: bool = True):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        self.texts: list[int] = []
        spans: list[int] = []
        self.items = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.items)}
        for item, raw in items:
            k = number[item]
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(raw)]
            if ids:
                for at in range(max(1, len(ids) - window + 1)):
                    owners.setdefault(key := tuple(ids[at : at + window]), set()).add(k)
                    if places_too:
                        places.setdefault(key, []).append((len(self.texts), at))
                self.texts.append(k)  # the item of each text: an id may have several
                spans.append(len(ids))
        self.window = window
        self.windows = sorted(owners)
        self.owners = [np.array(sorted(owners[w])) for w in self.windows]
        self.places = [np.array(places[w]) for w in self.windows] if places_too else None
        # Places as one number each; texts stand apart, so that neighbours are places of one text.
        self.base = np.cumsum([0, *(s + 1 for s in spans)])
        self.lines = [np.sort(self.base[p[:, 0]] + p[:, 1]) for p in self.places] if places_too else None
        self.sizes = np.array([len(w) for w in self.windows], dtype=np.int64)
        self.least = int(self.sizes.min()) if self.windows else 0
        bits = max(1, len(self.vocabulary).bit_length())
        self.bits, self.per_key = bits, max(1, 63 // bits)
        padded = np.zeros((len(self.windows), window), dtype=np.int64)
        for k, w in enumerate(self.windows):
            padded[k, : len(w)] = w
        self.low_keys = self.keys(padded)
        # The largest sequence that begins with the window: all later words at their largest.
        filled = np.where(np.arange(window) < self.sizes[:, None], padded, (1 << bits) - 1)
        self.high_keys = self.keys(filled)

    def keys(self, words: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, self.window, self.per_key):
            key = np.zeros(len(words), dtype=np.int64)
            for column in range(at, min(at + self.per_key, self.window)):
                key = (key << self.bits) | words[:, column]
            out.append(key)
        return np.stack(out, axis=1) if len(words) else np.zeros((0, -(-self.window // self.per_key)), dtype=np.int64)


def search(order: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of all wanted keys at once in a sorted table of integer tuples (one row each)."""
    lo = np.zeros(len(wanted), dtype=np.int64)
    hi = np.full(len(wanted), len(order), dtype=np.int64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        row = order[np.minimum(mid, len(order) - 1)]
        less = np.zeros(len(wanted), dtype=bool)
        equal = np.ones(len(wanted), dtype=bool)
        for c in range(order.shape[1]):
            less |= equal & (row[:, c] < wanted[:, c])
            equal &= row[:, c] == wanted[:, c]
        right = open_ & ((less | equal) if after else less)
        lo = np.where(right, mid + 1, lo)
        hi = np.where(open_ & ~right, mid, hi)
    return lo


def chains(found: list[tuple[np.ndarray, np.ndarray, int]], begin: np.ndarray, windows: Windows) -> Iterator[tuple[int, dict]]:
    """(document, match) of every longest match: ``found`` has places in the shard, (text, place) of the items, and a window's size."""
    at = np.concatenate([np.repeat(a, len(p)) for a, p, _ in found])
    text, place = np.concatenate([np.tile(p, (len(a), 1)) for a, p, _ in found]).T
    size = np.concatenate([np.full(len(a) * len(p), n) for a, p, n in found])
    order = np.lexsort((at, at - place, text))
    at, text, place, size = at[order], text[order], place[order], size[order]
    apart = (np.diff(text) != 0) | (np.diff(at - place) != 0) | (np.diff(at) != 1)
    first, last = np.flatnonzero(np.concatenate(([True], apart))), np.flatnonzero(np.concatenate((apart, [True])))
    doc = np.searchsorted(begin, at[first], side="right") - 1
    for d, a, b in zip(doc.tolist(), first.tolist(), last.tolist(), strict=True):
        yield d, {"doc_start": int(at[a] - begin[d]), "item": windows.items[windows.texts[text[a]]], "item_start": int(place[a]), "length": int(at[b] - at[a] + size[a])}


def longest_matches(found: list[tuple[int, np.ndarray]], begin: np.ndarray, windows: Windows) -> Iterator[tuple[int, dict]]:
    """(document, its longest match): the longest, then the first in the document, then by item and place there.

    Places of a shard are walked in order. Held are only the places in the items where the window before stood, each with the start of its chain, so
    repeated words take no more room than the items do.
    """
    at = np.concatenate([a for _, a in found])
    number = np.concatenate([np.full(len(a), k) for k, a in found])
    order = np.lexsort((number, at))
    at, number = at[order], number[order]
    doc = np.searchsorted(begin, at, side="right") - 1
    held, starts, before, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), -2, None
    now: list[tuple[np.ndarray, np.ndarray]] = []
    for i, (p, k, d) in enumerate(zip(at.tolist(), number.tolist(), doc.tolist(), strict=True)):
        if p != before:
            if now:
                held, starts = (np.concatenate(x) for x in zip(*now, strict=True))
                if len(now) > 1:
                    by = np.argsort(held, kind="stable")
                    held, starts = held[by], starts[by]
                now = []
            if p != before + 1 or (i and doc[i - 1] != d):
                held = held[:0]
            if i and doc[i - 1] != d:
                yield int(doc[i - 1]), best[1]
                best = None
            before = p
        lines, size = windows.lines[k], int(windows.sizes[k])
        own = np.full(len(lines), p)
        if len(held):
            slot = np.minimum(np.searchsorted(held, lines - 1), len(held) - 1)
            own = np.where(held[slot] == lines - 1, starts[slot], p)
        now.append((lines, own))
        first = int(own.min())
        length = p - first + size
        if best is None or (-length, first) <= best[0][:2]:
            # Of the chains that begin there, the first by item and place.
            ends = lines[own == first] - (p - first)
            text = np.searchsorted(windows.base, ends, side="right") - 1
            item, place = min((windows.items[windows.texts[t]], int(e - windows.base[t])) for t, e in zip(text.tolist(), ends.tolist(), strict=True))
            key = (-length, first, item, place)
            if best is None or key < best[0]:
                best = key, {"length": length, "doc_start": first - int(begin[d]), "item": item, "item_start": place}
    if best:
        yield int(doc[-1]), best[1]


def shard_hits(docs: list[list[int]], windows: Windows, with_matches: bool = False, with_longest: bool = False) -> tuple[list[np.ndarray], list[list[int]], list[list[dict]], list[dict | None]]:
    """For each document of a shard: which of its words are hit, the numbers of the items that occur in it, and on request all longest matches and the longest of them."""
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    words = np.zeros(int((sizes + 1).sum()) + windows.window, dtype=np.int64)
    for d, at in zip(docs, begin, strict=True):
        words[at : at + len(d)] = d
    stops = np.flatnonzero(words == 0)
    run = stops[np.searchsorted(stops, np.arange(len(words)))] - np.arange(len(words))
    starts = np.flatnonzero(run >= windows.least) if windows.least else np.zeros(0, dtype=np.int64)
    marks = np.zeros(len(words) + 1, dtype=np.int32)
    pairs: set[tuple[int, int]] = set()
    found: list[tuple[int, np.ndarray]] = []
    if len(starts):
        # A document's end is a stop, so words past it must not count towards a key.
        ahead = np.where(np.arange(windows.window) < run[starts][:, None], words[np.minimum(starts[:, None] + np.arange(windows.window), len(words) - 1)], 0)
        keys = windows.keys(ahead)
        order = np.lexsort(keys.T[::-1])
        keys, suffixes = keys[order], starts[order]
        low = search(keys, windows.low_keys, after=False)
        high = search(keys, windows.high_keys, after=True)
        for k in np.flatnonzero(high > low):
            at = suffixes[low[k] : high[k]]
            np.add.at(marks, at, 1)
            np.add.at(marks, at + windows.sizes[k], -1)
            inside = np.unique(np.searchsorted(begin, at, side="right") - 1)
            pairs.update((int(d), int(i)) for d in inside for i in windows.owners[k])
            found.append((int(k), at))
    hit = np.cumsum(marks)[:-1] > 0
    items: list[list[int]] = [[] for _ in docs]
    for d, i in pairs:
        items[d].append(i)
    matches: list[list[dict]] = [[] for _ in docs]
    if with_matches and found:
        for d, m in chains([(at, windows.places[k], int(windows.sizes[k])) for k, at in found], begin, windows):
            matches[d].append(m)
    longest: list[dict | None] = [None for _ in docs]
    if with_longest and found:
        for d, m in longest_matches(found, begin, windows):
            longest[d] = m
    return [hit[a : a + n] for a, n in zip(begin, sizes, strict=True)], items, matches, longest


def longer(a: dict | None, b: dict | None) -> dict | None:
    """The longer of two matches, then the first in the document, then by item and place there."""
    return min((m for m in (a, b) if m), key=lambda m: (-m["length"], m["doc_start"], m["item"], m["item_start"]), default=None)


def _scan(block, keep_text: bool, with_matches: bool):
    fields = FIELDS | ({"matches": MATCH} if with_matches else {})
    names = [c for c in fields if keep_text or c != "text"]
    arrow = pa.schema([(c, fields[c][1]) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(block.value)
        get = windows.vocabulary.get
        held: list[dict] = []

        def flush() -> pa.RecordBatch:
            ids = [x["ids"] for x in held]
            found, numbers, matches, longest = shard_hits(ids, windows, with_matches, with_longest=True)
            for k, x in enumerate(held):
                if x["hits"]:
                    found[k] = found[k] | np.unpackbits(np.frombuffer(x["hits"], dtype=np.uint8), count=len(ids[k])).astype(bool)
            out = {
                "doc_id": [x["doc_id"] for x in held],
                "text": [x["text"] for x in held],
                "n_words": [len(x) for x in ids],
                "n_hit": [int(h.sum()) for h in found],
                "hits": [np.packbits(h).tobytes() for h in found],
                "items": [[*(x["items"] or ()), *(windows.items[i] for i in own)] for x, own in zip(held, numbers, strict=True)],
                "longest": [longer(x["longest"], own) for x, own in zip(held, longest, strict=True)],
                "matches": [[*(x.get("matches") or ()), *own] for x, own in zip(held, matches, strict=True)],
            }
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(out[c], type=fields[c][1]) for c in names], schema=arrow)

        size = 0
        for batch in small_batches(batches):
            rest = batch.drop_columns(["text"]).to_pylist()
            for row, raw in zip(rest, raw_texts(batch.column(1)), strict=True):
                held.append(row | {"text": raw if keep_text else None, "ids": [get(w, 0) for w in words_of(raw)]})
                size += len(held[-1]["ids"])
                if size >= SHARD_WORDS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run, ", ".join(f"{c} {fields[c][0]}" for c in names)


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items with an id, in blocks whose texts have at most ``block_chars`` characters (one item at least)."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("item is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if total <= block_chars:
        yield [(r.item, r.text.encode()) for r in items.collect()]
        return
    held, size = [], 0
    for r in items.toLocalIterator():
        if held and size + len(r.text) > block_chars:
            yield held
            held, size = [], 0
        held.append((r.item, r.text.encode()))
        size += len(r.text)
    if held:
        yield held


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS, with_matches: bool = False) -> DataFrame:
    """One row per document: n_words, n_hit, ``hits`` (a bit for each word), ``items``, the ids that occur in it, and ``longest``, its longest match with the places in both, in words.

    With ``matches`` on request: every longest match of a window's length or more. An item that repeats its own windows matches a place once for each.
    """
    context = docs.sparkSession.sparkContext
    rows = id_and_text(docs, id_col, text_col).withColumns({"hits": F.lit(None).cast("binary"), "items": F.lit(None).cast("array<string>"), "longest": F.lit(None).cast(FIELDS["longest"][0])} | ({"matches": F.lit(None).cast(MATCH[0])} if with_matches else {}))
    carried = ["doc_id", "text", "hits", "items", "longest", *(["matches"] if with_matches else [])]
    blocks = blocks_of(benchmark, item_col, item_text_col, block_chars)
    block = next(blocks, [])
    while True:
        following = next(blocks, None)
        run, schema = _scan(context.broadcast(block), keep_text=following is not None, with_matches=with_matches)
        rows = rows.select(carried).mapInArrow(run, schema)
        if following is None:
            return rows
        rows, block = cut(rows, "decontaminate"), following


def contamination_report(docs: DataFrame, benchmark: DataFrame, **columns) -> DataFrame:
    """The contract's columns, and the longest match."""
    items = F.array_sort(F.array_distinct("items"))
    found = find_contamination(docs, benchmark, **columns)
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), *(F.coalesce(F.col(f"longest.{c}"), F.lit(none)).cast(kind).alias(name) for c, name, none, kind in LONGEST))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows without a window of any item, with all their columns; each block of items filters what the last one left."""
    context = docs.sparkSession.sparkContext
    for block in blocks_of(benchmark, item_col, item_text_col, block_chars):
        shared = context.broadcast(block)

        def kernel(shared=shared):
            windows = Windows(shared.value, places_too=False)
            get = windows.vocabulary.get

            def keep(raws: list[bytes]) -> list[bool]:
                out: list[bool] = []
                held, size = [], 0
                for k, raw in enumerate(raws, 1):
                    held.append([get(w, 0) for w in words_of(raw)])
                    size += len(held[-1])
                    if size >= SHARD_WORDS or k == len(raws):
                        out += [not h.any() for h in shard_hits(held, windows)[0]]
                        held, size = [], 0
                return out

            return keep

        docs = filter_texts(docs, kernel, text_col)
    return docs
