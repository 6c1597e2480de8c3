"""Exact n-gram Jaccard join with a token-group matrix.

Documents with the same set of shingles are one class. Tasks send their classes' shingles, packed and by ranges, to where each
shingle's classes are counted; shingles of one class only can't be shared, so just the others travel back. A class then
knows its size n, its number s of shared shingles and how common each is, and its prefix: the n - ceil(3/4 n) + 1 rarest shingles, one of which every class it links with has in its own
prefix. Most classes have no shared shingle in their prefix and are done. Counts stop at 65,535; that only decides ties in the order of rarity, which is the same for all classes, so no link is lost.

Groups of similar classes: each class is compared with one representative, the class that is best connected in the prefix shingles they have in common,
and links make groups (components). The matrix has a row for each prefix shingle and group, with the bounds of its members, and each group's token
union: all shared shingles of its members. A query class meets other groups in the matrix; a pair whose first common shingle has r and r' left from it on can only link
if 7 min(r, r') >= 3 (n + n') and 4 min(n, n') >= 3 max(n, n'). What is left is bounded by the union: a group is opened only if the query shares enough shingles
with it for a link to its smallest possible member. Members of opened groups are compared exactly. Two classes of which more than a seventh is rarer than all they have in common can't link, so many documents that share a passage are never paired with each other.

Skew: equal sets of a task are one class; counts are packed by range of hash, not by shingle. A shingle that many classes of one task have goes to its
range as one number, and its classes stay behind in a row of that task that only wants the total back, so a range gets few entries of a hot
shingle from each task. With more than 2^``COARSE`` ranges they are split a second time, so a range never grows with the corpus. Hot shingles
and hubs are joined by pre-aggregated rows (``naming.attach``) or split by adaptive execution. No pairs within a group are made.

Shingles are told apart by at least 54 bits of a hash, classes by 64; a pair's overlap is wrong with a probability of about n n' / 2^54.

Defined results: null or empty texts, or ones without words, have no shingles and stand alone; fewer than five words are one shingle; repeated rows
and copies share a component; null ids are never a component's id while another is there; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, id_and_text, raw_texts, release, small_batches, trim
from .naming import attach

N = 5
#: Link when LINK[0] * intersection >= LINK[1] * union.
LINK = (100, 75)
#: Shingles that a task gathers before it sends them on, the documents it gathers at most, and the shingles one range should hold.
FLUSH = 1_000_000
FLUSH_DOCS = 50_000
RANGE = 1_250_000
#: A shingle of so many classes of one flush is sent as a count.
LOCAL_HOT = 16
#: Bits of a range in the first shuffle. Finer ranges are split from these in a second one.
COARSE = 10
#: Shingles of one row of a group's union.
UNION = 2_000_000
WORDS_HELD = 400_000
LONGEST_HELD = 64
LOW = np.uint64((1 << 48) - 1)


def arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(c, kinds[k]) for c, k in (x.split(" ") for x in schema.split(", "))])


#: r >= 0: a range's classes with their shingles, or (without sids) its shingles that are hot in a flush with their counts. r < 0: documents, or the classes behind a flush's hot shingles.
SENT = "r long, flush long, docs binary, sids binary, counts binary, toks binary"
#: A document; or classes of one part (sb) with shared shingles and their counts; or what a flush keeps of, or hears about, its hot shingles.
BACK = "doc_id long, n int, sid long, sb long, flush long, sids binary, counts binary, toks binary, dfs binary"
LIVE = "sid long, n int, s int, score double, toks binary, prefix array<long>"
SENT_ARROW, BACK_ARROW, LIVE_ARROW = arrow(SENT), arrow(BACK), arrow(LIVE)
DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("n", "<i4"), ("sid", "<i8")])
CLASS = np.dtype([("sid", "<i8"), ("n", "<i4")])


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST_HELD:
            if len(self) >= WORDS_HELD:
                self.clear()
            self[word] = found
        return found


def shingles(raw: bytes, hashes: WordHashes, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles. bytes.split() parts words at 09-0D and 20, bytes.lower() lowers A-Z."""
    words = raw.lower().split()
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1 + len(words))] if words else [], dtype=np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    last = len(words) - n + 1
    h = ids[:last].copy()
    for k in range(1, n):
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h += ids[k : last + k]
    for shift, factor in ((32, 0x94D049BB133111EB), (29, 0x9E3779B97F4A7C15)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return np.unique(h ^ (h >> np.uint64(31)))


def class_id(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def pack(tokens: np.ndarray) -> bytes:
    """The low 48 bits of each shingle; the range has the others."""
    return np.ascontiguousarray((tokens & LOW).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack(toks: bytes) -> np.ndarray:
    low = np.zeros((len(toks) // 6, 8), dtype=np.uint8)
    low[:, :6] = np.frombuffer(toks, dtype=np.uint8).reshape(-1, 6)
    return low.view("<u8").ravel()


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of runs of equal neighbours."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
    return first, np.diff(np.concatenate((first, [len(keys)])))


def record(schema: pa.Schema, **row) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], type=f.type) for f in schema], schema=schema)


def by_range(part: np.ndarray, of: np.ndarray, tokens: np.ndarray, heads: np.ndarray) -> Iterator[dict]:
    """For each range the classes that have shingles in it. ``of`` is the place of a shingle's class in ``heads``."""
    order = np.lexsort((of, part))
    part, of, tokens = part[order], of[order], tokens[order]
    for at, n in zip(*runs(part), strict=True):
        first, count = runs(of[at : at + n])
        yield {"r": int(part[at]), "sids": heads[of[at : at + n][first]].tobytes(), "counts": count.astype("<u4").tobytes(), "toks": pack(tokens[at : at + n])}


def _send(bits: int, n: int):
    """Pack a task's documents, and the shingles of its classes by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, part = WordHashes(), TaskContext.get().partitionId()
        classes: dict[int, np.ndarray] = {}
        docs: list[tuple] = []
        size = flushes = 0

        def rows(flush: int) -> Iterator[dict]:
            own = -1 - flush % (1 << bits)
            yield {"r": own, "docs": np.array(docs, dtype=DOC).tobytes()}
            if not classes:
                return
            heads = np.array([(s, len(t)) for s, t in classes.items()], dtype=CLASS)
            tokens = np.concatenate(list(classes.values()))
            of = np.repeat(np.arange(len(heads), dtype=np.int32), heads["n"])
            order = np.argsort(tokens, kind="stable")
            tokens, of = tokens[order], of[order]
            first, count = runs(tokens)
            often = np.repeat(count >= LOCAL_HOT, count)
            if often.any():
                held, to, count = tokens[often], of[often], count[count >= LOCAL_HOT]
                first = np.concatenate(([0], np.cumsum(count)))[:-1]
                ranges = (held[first] >> np.uint64(64 - bits)).astype(np.int64)
                for at, k in zip(*runs(ranges), strict=True):
                    yield {"r": int(ranges[at]), "counts": count[at : at + k].astype("<u4").tobytes(), "toks": pack(held[first][at : at + k])}
                order = np.argsort(to, kind="stable")
                at, k = runs(to[order])
                yield {"r": own, "sids": heads[to[order][at]].tobytes(), "counts": k.astype("<u4").tobytes(), "toks": clip(held[order], bits).tobytes()}
            tokens, of = tokens[~often], of[~often]
            yield from by_range((tokens >> np.uint64(64 - bits)).astype(np.int16), of, tokens, heads)

        def flush() -> Iterator[pa.RecordBatch]:
            here = part << 32 | flushes
            for row in rows(here):
                yield record(SENT_ARROW, flush=here, **row)
            classes.clear()
            docs.clear()

        for batch in small_batches(batches):
            for doc_id, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                tokens = shingles(raw, hashes, n)
                sid = class_id(tokens) if len(tokens) else 0
                docs.append((doc_id or 0, doc_id is None, len(tokens), sid))
                if len(tokens) and sid not in classes:
                    classes[sid] = tokens
                    size += len(tokens)
                if size >= FLUSH or len(docs) >= FLUSH_DOCS:
                    yield from flush()
                    size, flushes = 0, flushes + 1
        if docs:
            yield from flush()
        hashes.clear()
        release()

    return run


def clip(tokens: np.ndarray, bits: int) -> np.ndarray:
    """A shingle as its range and its low 48 bits have it."""
    return (tokens >> np.uint64(64 - bits)) << np.uint64(48) | tokens & LOW


def heads_and_tokens(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct classes, each shingle's place among them, low bits) of rows with classes."""
    heads = np.concatenate([np.frombuffer(x.as_buffer(), dtype=CLASS) for x in rows.column("sids")])
    counts = np.concatenate([np.frombuffer(x.as_buffer(), dtype="<u4") for x in rows.column("counts")])
    _, first, place = np.unique(heads["sid"], return_index=True, return_inverse=True)
    return heads[first], np.repeat(place.astype(np.int32), counts), np.concatenate([unpack(x.as_py()) for x in rows.column("toks")])


def _split(bits: int, coarse: int):
    """Rows of one coarse range to its fine ones, classes of several flushes together."""
    fine = np.uint64(bits - coarse)

    def reduce(sent: pa.Table) -> pa.Table:
        r = sent.column("r")[0].as_py()
        if r < 0:
            return sent
        place = lambda low: (np.int64(r) << np.int64(fine)) | (low >> (np.uint64(48) - fine)).astype(np.int64)
        out = []
        if (rows := sent.filter(pc.is_valid(sent.column("sids")))).num_rows:
            heads, of, low = heads_and_tokens(rows)
            out += [record(SENT_ARROW, flush=rows.column("flush")[0].as_py(), **x) for x in by_range(place(low), of, low, heads)]
        for row in sent.filter(pc.is_null(sent.column("sids"))).to_pylist():
            low, counts = unpack(row["toks"]), np.frombuffer(row["counts"], "<u4")  # in order of shingles, so of ranges
            out += [record(SENT_ARROW, r=int(place(low)[at]), flush=row["flush"], counts=counts[at : at + n].tobytes(), toks=pack(low[at : at + n])) for at, n in zip(*runs(place(low)), strict=True)]
        return pa.Table.from_batches(out, SENT_ARROW)

    return reduce


def by_class(cls: np.ndarray, token: np.ndarray, df: np.ndarray, heads: np.ndarray, parts: int) -> Iterator[dict]:
    """Shared shingles packed by parts of the classes."""
    place = heads["sid"][cls] & (parts - 1)
    order = np.lexsort((cls, place))
    cls, token, df, place = cls[order], token[order], df[order], place[order]
    for at, n in zip(*runs(place), strict=True):
        own = slice(at, at + n)
        first, count = runs(cls[own])
        yield {"sb": int(place[at]), "sids": heads[cls[own][first]].tobytes(), "counts": count.astype("<u4").tobytes(), "toks": token[own].tobytes(), "dfs": df[own].astype("<u2").tobytes()}


def _count(bits: int, coarse: int):
    """In one range: which shingles several classes have, packed by class for the way back. Documents pass through."""
    def reduce(sent: pa.Table) -> pa.Table:
        r = sent.column("r")[0].as_py()
        if r < 0:
            out = []
            for row in sent.to_pylist():
                if row["docs"] is None:
                    out.append(record(BACK_ARROW, **{c: row[c] for c in ("flush", "sids", "counts", "toks")}))
                else:
                    own = np.frombuffer(row["docs"], dtype=DOC)
                    columns = {"doc_id": pa.array(own["doc_id"], mask=own["null"].astype(bool)), "n": pa.array(own["n"]), "sid": pa.array(own["sid"])}
                    out.append(pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(len(own), f.type) for f in BACK_ARROW], schema=BACK_ARROW))
            return pa.Table.from_batches(out, BACK_ARROW)
        top = np.uint64((r >> (bits - coarse)) << 48)
        hot = [(row["flush"], unpack(row["toks"]), np.frombuffer(row["counts"], "<u4")) for row in sent.filter(pc.is_null(sent.column("sids"))).to_pylist()]
        known, at = np.unique(np.concatenate([t for _, t, _ in hot]), return_inverse=True) if hot else (np.zeros(0, dtype=np.uint64), [])
        held = np.zeros(len(known) + 1, dtype=np.int64)
        if hot:
            np.add.at(held, at, np.concatenate([c for _, _, c in hot]))
        out = []
        if (rows := sent.filter(pc.is_valid(sent.column("sids")))).num_rows:
            heads, cls, token = heads_and_tokens(rows)
            del sent, rows
            order = np.lexsort((cls, token))  # the same class may come from several flushes
            token, cls = token[order], cls[order]
            del order
            fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])))
            token, cls = token[fresh], cls[fresh]
            first, size = runs(token)
            if len(known):
                place = np.minimum(np.searchsorted(known, token[first]), len(known) - 1)
                same = known[place] == token[first]
                np.add.at(held, place[same], size[same])
                total = np.where(same, held[place], size)
            else:
                total = size
            shared = np.repeat(total > 1, size)
            df = np.repeat(np.minimum(total, 65535).astype(np.int32), size)[shared]
            out += [record(BACK_ARROW, **x) for x in by_class(cls[shared], token[shared] | top, df, heads, 1 << bits)]
        for flush, tokens, _ in hot:
            df = np.minimum(held[np.searchsorted(known, tokens)], 65535)
            out.append(record(BACK_ARROW, flush=flush, toks=(tokens | top).tobytes(), dfs=df.astype("<u2").tobytes()))
        trim()
        return pa.Table.from_batches(out, BACK_ARROW)

    return reduce


def _held(bits: int):
    """In one flush: its hot shingles, with their totals, back to its classes."""

    def reduce(rows: pa.Table) -> pa.Table:
        own = rows.filter(pc.is_valid(rows.column("sids")))
        told = rows.filter(pc.is_null(rows.column("sids")))
        heads = np.concatenate([np.frombuffer(x.as_buffer(), dtype=CLASS) for x in own.column("sids")])
        cls = np.repeat(np.arange(len(heads), dtype=np.int32), np.concatenate([np.frombuffer(x.as_buffer(), dtype="<u4") for x in own.column("counts")]))
        token = np.concatenate([np.frombuffer(x.as_buffer(), dtype="<u8") for x in own.column("toks")])
        known = np.concatenate([np.frombuffer(x.as_buffer(), dtype="<u8") for x in told.column("toks")])
        dfs = np.concatenate([np.frombuffer(x.as_buffer(), dtype="<u2") for x in told.column("dfs")])
        order = np.argsort(known)
        df = dfs[order][np.searchsorted(known[order], token)]
        return pa.Table.from_batches([record(BACK_ARROW, **x) for x in by_class(cls, token, df, heads, 1 << bits)], BACK_ARROW)

    return reduce


def _gather(back: pa.Table) -> pa.Table:
    """In one part of the classes: their shared shingles, and the prefixes that hold any. A class may come from several flushes."""
    heads = np.concatenate([np.frombuffer(x.as_buffer(), dtype=CLASS) for x in back.column("sids")])
    counts = np.concatenate([np.frombuffer(x.as_buffer(), dtype="<u4") for x in back.column("counts")])
    _, first, place = np.unique(heads["sid"], return_index=True, return_inverse=True)
    heads, cls = heads[first], np.repeat(place.astype(np.int32), counts)
    token = np.concatenate([np.frombuffer(x.as_buffer(), dtype="<u8") for x in back.column("toks")])
    df = np.concatenate([np.frombuffer(x.as_buffer(), dtype="<u2") for x in back.column("dfs")])
    order = np.lexsort((token, df, cls))
    token, df, cls = token[order], df[order], cls[order]
    fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])))
    token, df, cls = token[fresh], df[fresh], cls[fresh]
    del order, fresh
    trim()
    rows: list[tuple] = []
    for at, s in zip(*runs(cls), strict=True):
        sid, n = heads[cls[at]].item()
        least = -(-LINK[1] * n // LINK[0])
        prefix = (n - least + 1) - (n - int(s))  # what the class's own shingles, which come first, leave of it
        if prefix > 0:
            own = token[at : at + s]
            rows.append((sid, n, int(s), float(np.log(df[at : at + s]).sum() / n), np.sort(own).tobytes(), own[:prefix].astype(np.int64)))
    return pa.table([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(LIVE_ARROW), LIVE_ARROW, strict=True)], schema=LIVE_ARROW)


def common_tokens(left: pa.Scalar, right: pa.Scalar) -> int:
    """How many shingles two sorted sets share: the smaller is looked up in the larger."""
    a, b = (np.frombuffer(x.as_buffer(), "<u8") for x in (left, right))
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both sets of shared shingles, those that link."""
    for batch in small_batches(batches, 1024):
        a, b, na, nb = (batch.column(k).to_numpy() for k in range(4))
        both = np.fromiter((common_tokens(x, y) for x, y in zip(batch.column(4), batch.column(5), strict=True)), np.int64, batch.num_rows)
        keep = LINK[0] * both >= LINK[1] * (na.astype(np.int64) + nb - both)
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])
    release()


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, comp, both) of queries and rows of unions."""
    for batch in small_batches(batches, 1024):
        both = [common_tokens(x, y) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, type=pa.int64())], names=["sid", "comp", "both"])
    release()


def _unions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(comp, part, toks): what a task has of each group's union, by parts of the hash."""
    held: dict[tuple[int, int], list[np.ndarray]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (comp, bits), own in held.items():
            tokens = np.unique(np.concatenate(own))
            part = (tokens >> np.uint64(58 - bits)).astype(np.int64) if bits else np.zeros(len(tokens), dtype=np.int64)
            for at, n in zip(*runs(part), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([comp]), pa.array([int(part[at])]), pa.array([tokens[at : at + n].tobytes()], pa.binary())], names=["comp", "part", "toks"])
        held.clear()

    for batch in small_batches(batches):
        for comp, bits, toks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            held.setdefault((comp, bits), []).append(np.frombuffer(toks.as_py(), "<u8"))
            size += len(held[comp, bits][-1])
        if size >= FLUSH:
            yield from flush()
            size = 0
    yield from flush()
    release()


def _union(rows: pa.Table) -> pa.Table:
    tokens = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for x in rows.column("toks")]))
    return pa.table([rows.column("comp")[:1], rows.column("part")[:1], pa.array([tokens.tobytes()], pa.binary())], names=["comp", "part", "toks"])


def verify(pairs: DataFrame, live: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by exact intersection."""
    one = live.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta"))
    two = live.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ta", "tb").mapInArrow(_links, "a long, b long")


def components(links: DataFrame, name: str, rounds: int = 200) -> DataFrame:
    """(sid, comp) of every class with a link; comp is the smallest reachable. Alternates large and small stars, in about log^2 rounds; raises if they don't suffice."""
    edges, before = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0"), None
    for k in range(1, rounds):
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if before == (state.n, state.x):
            break
        before = (state.n, state.x)
        for large in (True, False):
            side = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
            least = cut(side.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size")).withColumn("m", F.least("m", "u")), f"{name}-least")
            near = attach(side, least, ["u"], "size")
            out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
            old, edges = edges, cut(out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-{k}")
            discard(old, least)
    else:
        raise RuntimeError(f"components of {name} did not settle in {rounds} rounds")
    roots = edges.select("v").distinct().select(F.col("v").alias("sid"), F.col("v").alias("comp"))
    return cut(edges.select(F.col("u").alias("sid"), F.col("v").alias("comp")).unionByName(roots), f"{name}-end")


def range_bits(docs: DataFrame) -> int:
    """Ranges of about RANGE shingles, taking a word for six bytes."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(6, int(size / 6 / RANGE).bit_length())


def possible(n1: str, left1: str, n2: str, left2: str):
    """Whether two classes of these sizes can link if a shingle with so many left from it on, in either, is the first they have in common.

    Links are never lost by this: at the first shingle a pair has in common, all it shares is among what is left in both.
    """
    need = LINK[1] * (F.col(n1) + F.col(n2))
    return (LINK[0] * F.least(n1, n2) >= LINK[1] * F.greatest(n1, n2)) & ((LINK[0] + LINK[1]) * F.least(left1, left2) >= need)


def link_classes(live: DataFrame) -> DataFrame:
    """All links that components need, from the classes with shared shingles in their prefix."""
    posts = live.select("sid", "n", "s", "score", F.posexplode("prefix").alias("pos", "token"))
    # A class's own shingles come first, so s - pos shingles are left from this one on.
    posts = cut(posts.select("sid", "n", "score", "token", (F.col("s") - F.col("pos")).alias("left")), "near-posts")
    # One representative per shingle, one comparison per class.
    reps = posts.groupBy("token").agg(F.max(F.struct("score", "sid", "n", "left")).alias("rep"), F.count("*").alias("size")).where("size > 1")
    met = attach(posts, cut(reps, "near-reps"), ["token"], "size").select("sid", "n", "left", F.col("rep.sid").alias("rep"), F.col("rep.n").alias("rn"), F.col("rep.left").alias("rleft"))
    votes = met.where("sid <> rep").where(possible("n", "left", "rn", "rleft")).groupBy("sid", "rep").agg(F.count("*").alias("votes"))
    best = votes.groupBy("sid").agg(F.max(F.struct("votes", "rep")).alias("best"))
    first = cut(verify(best.select(F.col("sid").alias("a"), F.col("best.rep").alias("b")), live), "near-first")
    groups = components(first, "near-groups")
    # The matrix: a row for each shingle and group, with the bounds of the members that have it.
    room = (LINK[0] + LINK[1]) * F.col("left") - LINK[1] * F.col("n")  # LINK[1] times the largest partner
    own = posts.join(groups, "sid", "left").select("token", "sid", "n", "left", F.coalesce("comp", "sid").alias("comp"), room.alias("room"))
    matrix = cut(own.groupBy("token", "comp").agg(F.min("n").alias("g_least"), F.max("n").alias("g_most"), F.max("room").alias("g_room")), "near-matrix")
    open_tokens = matrix.groupBy("token").agg(F.count("*").alias("size")).where("size > 1")
    query = cut(attach(own, cut(open_tokens, "near-open"), ["token"], "size").drop("size"), "near-query")
    group = matrix.withColumnRenamed("comp", "g_comp")
    bound = (query["token"] == group["token"]) & (F.col("comp") < F.col("g_comp")) & (LINK[0] * F.col("g_most") >= LINK[1] * F.col("n")) & (LINK[1] * F.col("g_least") <= F.col("room")) & (F.col("g_room") >= LINK[1] * F.col("n"))
    dense = F.col("room") >= LINK[1] * F.col("n")
    hits = lambda q, g: q.join(g, bound).select(group["token"], "sid", "n", "left", "g_comp", "g_least")
    hit = cut(hits(query.where(dense), group).unionByName(hits(query.where(~dense), group.where(F.col("g_room") >= LINK[1] * F.col("g_least")))), "near-hits")
    opened = open_groups(hit, groups, live)
    member = query.select(F.col("token"), F.col("comp").alias("g_comp"), F.col("sid").alias("sid2"), F.col("n").alias("n2"), F.col("left").alias("left2"))
    pairs = hit.join(opened, ["sid", "g_comp"], "left_semi").join(member, ["token", "g_comp"]).where(possible("n", "left", "n2", "left2"))
    pairs = cut(pairs.select(F.col("sid").alias("a"), F.col("sid2").alias("b")).distinct(), "near-pairs")
    return first.unionByName(cut(verify(pairs, live), "near-second"))


def open_groups(hit: DataFrame, groups: DataFrame, live: DataFrame) -> DataFrame:
    """Of (sid, g_comp) that met in the matrix, those where the query shares enough shingles with the group's token union.

    With its smallest possible member of n' shingles, 7 |query & union| >= 3 (n + n') has to hold. A group of one class is its own
    union. Other unions are rows of about ``UNION`` shingles; overlaps with them add up.
    """
    asked = cut(hit.groupBy("sid", "g_comp").agg(F.first("n").alias("n"), F.min("g_least").alias("g_least")), "near-asked")
    wanted = asked.select(F.col("g_comp").alias("comp")).distinct()
    many = groups.join(wanted, "comp", "left_semi").join(live.select("sid", "s", "toks"), "sid")
    sizes = many.groupBy("comp").agg(F.ceil(F.log2(F.greatest(F.lit(1), F.sum("s") / UNION))).cast("int").alias("bits"), F.count("*").alias("size"))
    parts = attach(many, cut(sizes, "near-sizes"), ["comp"], "size").select("comp", "bits", "toks").mapInArrow(_unions, "comp long, part long, toks binary")
    union = cut(parts.groupBy("comp", "part").applyInArrow(_union, "comp long, part long, toks binary"), "near-unions").select("comp", "toks")
    ones = live.join(groups, "sid", "left_anti").join(wanted, live["sid"] == wanted["comp"], "left_semi").select(F.col("sid").alias("comp"), "toks")
    queries = asked.join(live.select("sid", F.col("toks").alias("own")), "sid").withColumnRenamed("g_comp", "comp")
    found = queries.join(union.unionByName(ones), "comp").select("sid", "comp", "own", "toks").mapInArrow(_overlaps, "sid long, comp long, both long")
    found = found.groupBy("sid", "comp").agg(F.sum("both").alias("both")).withColumnRenamed("comp", "g_comp")
    least = F.greatest("g_least", F.ceil(F.lit(LINK[1] / LINK[0]) * F.col("n")))
    return cut(asked.join(found, ["sid", "g_comp"]).where((LINK[0] + LINK[1]) * F.col("both") >= LINK[1] * (F.col("n") + least)).select("sid", "g_comp"), "near-opened")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, coarse: int = COARSE) -> DataFrame:
    """One row per document: its number of shingles and the smallest id that links reach."""
    own = id_and_text(docs, id_col, text_col)
    bits = range_bits(own)
    coarse = min(bits, coarse)
    sent = own.mapInArrow(_send(coarse, n), SENT)
    if bits > coarse:
        sent = sent.groupBy("r", F.pmod(F.xxhash64("flush"), F.lit(1 << (bits - coarse)))).applyInArrow(_split(bits, coarse), SENT)
    back = cut(sent.groupBy("r").applyInArrow(_count(bits, coarse), BACK), "near-back")
    rows = back.where("n is not null").select("doc_id", "n", "sid")
    told = ["sids", "counts", "toks", "dfs"]
    held = back.where("flush is not null").groupBy("flush").applyInArrow(_held(bits), BACK)
    live = cut(back.where("sb is not null").select("sb", *told).unionByName(held.select("sb", *told)).groupBy("sb").applyInArrow(_gather, LIVE), "near-live")
    found = components(link_classes(live), "near-comp")
    alone = rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    named = cut(rows.where("n > 0").join(found, "sid", "left").select("doc_id", "n", F.coalesce("comp", "sid").alias("comp")), "near-named")
    least = cut(named.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("size")), "near-least")
    return attach(named, least, ["comp"], "size").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id").unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of the smallest id of each component, with all their columns. Rows repeated with that id all stay, as do null ids.

    The ids that go are few; whether they are sent to the texts or the texts to them is decided by their size when it is known.
    """
    gone = cut(near_groups(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("near_gone")).distinct(), "near-gone")
    return docs.join(gone, docs["doc_id"] == gone["near_gone"], "left_anti")
