"""Nearest prototypes by Hamming distance on packed bits, and by correlation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The coarse filter's tolerance of ink.
INK_SHARE, INK_EXTRA = 0.2, 3
#: Prototypes are sent in parts of at most so many rows.
BROADCAST_PROTOTYPES = 100_000
#: Words, or products, that a kernel holds at a time.
AT_ONCE = 2_000_000


def pack_bits(values: Column) -> Column:
    """Sign bits of up to 64 values in one BIGINT, the first in the lowest bit."""
    return F.aggregate(F.transform(values, lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def with_bits(df: DataFrame, values: str) -> DataFrame:
    return df.withColumn("bits", pack_bits(F.col(values))).withColumn("ink", F.bit_count("bits"))


def chunks(table: DataFrame, order: list[str], rows: int) -> Iterator[pa.Table]:
    """A table in parts of a checked size: in one if it has at most ``rows`` rows, else by the hash of its key."""
    first = table.limit(rows + 1).toArrow()  # a table that is dear to make is made once
    if first.num_rows <= rows:
        yield first
        return
    del first
    parts = -(-2 * table.count() // rows)
    place = F.pmod(F.xxhash64(*order), F.lit(parts))
    for k in range(parts):
        part = table.where(place == k)
        if part.limit(rows + 1).count() > rows:
            raise ValueError("a key of the table has more rows than may be sent")
        yield part.toArrow()


def by_class(table: pa.Table, values: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(classes, first row of each, prototype of each row, values as a matrix) in order of class and prototype."""
    table = table.sort_by([("char_id", "ascending")] + ([("proto_id", "ascending")] if "proto_id" in table.column_names else []))
    char = table.column("char_id").to_numpy()
    first = np.flatnonzero(np.concatenate(([True], char[1:] != char[:-1]))) if len(char) else np.zeros(0, dtype=np.int64)
    return char[first], first, table.column("proto_id").to_numpy() if "proto_id" in table.column_names else np.zeros(len(char), dtype=np.int64), matrix(table.column(values).combine_chunks())


def matrix(column: pa.Array) -> np.ndarray:
    """A column of numbers, or of arrays of one size, with a row for each of its rows."""
    if not pa.types.is_list(column.type):
        return column.to_numpy(zero_copy_only=False)[:, None]
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), dtype=flat.dtype)


def class_minimum(glyphs: DataFrame, prototypes: DataFrame, rows: int = BROADCAST_PROTOTYPES) -> DataFrame:
    """(glyph_id, char_id, distance, proto_id): the nearest prototype of each class, of equal ones the first.

    Prototypes go to the tasks in parts of a checked size, sorted by class; one kernel compares a batch of glyphs with all of a part at
    once and keeps the least of each class, so no pair ever becomes a row. ``bits`` is one 64-bit word or an array of them.
    """
    kind = glyphs.schema["glyph_id"].dataType.simpleString()
    own, out = glyphs.select("glyph_id", "bits"), None
    for part in chunks(prototypes.select("char_id", "proto_id", "bits"), ["char_id", "proto_id"], rows):
        shared = glyphs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            classes, first, proto, words = by_class(shared.value, "bits")
            words = words.view(np.uint64)
            for batch in batches:
                step = max(1, AT_ONCE // max(1, words.size))
                for at in range(0, batch.num_rows if len(classes) else 0, step):
                    some = batch.slice(at, step)
                    mine = matrix(some.column(1)).view(np.uint64)
                    apart = sum(np.bitwise_count(mine[:, k, None] ^ words[None, :, k]).astype(np.int64) for k in range(words.shape[1]))
                    least = np.minimum.reduceat(apart * len(proto) + np.arange(len(proto)), first, axis=1)
                    yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(np.repeat(np.arange(some.num_rows), len(classes)))), pa.array(np.tile(classes, some.num_rows), pa.int64()), pa.array((least // len(proto)).ravel(), pa.int64()), pa.array(proto[least % len(proto)].ravel(), pa.int64())], names=["glyph_id", "char_id", "distance", "proto_id"])

        one = own.mapInArrow(run, f"glyph_id {kind}, char_id long, distance long, proto_id long")
        out, many = (one, False) if out is None else (out.unionByName(one), True)
    return fold(out) if many else out  # one part has one row for each glyph and class already


def fold(pairs: DataFrame) -> DataFrame:
    """The least distance of each glyph and class."""
    return pairs.groupBy("glyph_id", "char_id").agg(F.min(F.struct("distance", "proto_id")).alias("b")).select("glyph_id", "char_id", "b.distance", "b.proto_id")


def coarse_counts(glyphs: DataFrame, prototypes: DataFrame) -> DataFrame:
    """(glyph_id, n): how many prototypes have an ink like the glyph's. Only counts of each ink are joined; inks of 64 bits have at most 65 values."""
    g = glyphs.groupBy(F.col("ink").alias("g_ink")).count().drop("count")
    p = prototypes.groupBy(F.col("ink").alias("p_ink")).agg(F.count("*").alias("k"))
    near = F.abs(F.col("g_ink") - F.col("p_ink")) <= F.floor(INK_SHARE * F.col("g_ink")).cast("int") + INK_EXTRA
    n = g.join(F.broadcast(p), near).groupBy("g_ink").agg(F.sum("k").alias("n"))
    return glyphs.select("glyph_id", F.col("ink").alias("g_ink")).join(F.broadcast(n), "g_ink").select("glyph_id", "n")


def coarse_minimum(glyphs: DataFrame, prototypes: DataFrame, rows: int = BROADCAST_PROTOTYPES) -> DataFrame:
    """(glyph_id, distance): least distance of each glyph to the prototypes of similar ink; glyphs without any are left out.

    As in ``class_minimum`` a kernel compares a batch with a part. Prototypes and glyphs are sorted by ink, so those of similar ink are one range.
    """
    kind = glyphs.schema["glyph_id"].dataType.simpleString()
    own, out = glyphs.where("bits IS NOT NULL").select("glyph_id", "bits", F.col("ink").cast("long").alias("ink")), None
    prototypes = prototypes.where("bits IS NOT NULL")
    for part in chunks(prototypes.select("char_id", "proto_id", "bits", F.col("ink").cast("long").alias("ink")), ["char_id", "proto_id"], rows):
        shared = glyphs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            part = shared.value.sort_by("ink")
            p_ink, words = part.column("ink").to_numpy(), matrix(part.column("bits").combine_chunks()).view(np.uint64)
            for batch in batches:
                ink, mine = batch.column(2).to_numpy(), matrix(batch.column(1)).view(np.uint64)
                reach = np.floor(INK_SHARE * ink).astype(np.int64) + INK_EXTRA
                low, high = np.searchsorted(p_ink, ink - reach, side="left"), np.searchsorted(p_ink, ink + reach, side="right")
                least = np.zeros(len(ink), np.int64)
                for level in np.unique(ink):  # glyphs of one ink share their range
                    some = np.flatnonzero(ink == level)
                    near = words[low[some[0]] : high[some[0]]]
                    step = max(1, AT_ONCE // max(1, near.size))
                    for at in range(0, len(some) if len(near) else 0, step):
                        few = mine[some[at : at + step]]
                        apart = sum(np.bitwise_count(few[:, k, None] ^ near[None, :, k]).astype(np.uint16) for k in range(words.shape[1]))
                        least[some[at : at + step]] = apart.min(1)
                found = high > low
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(found)), pa.array(least[found], pa.int64())], names=["glyph_id", "distance"])

        one = own.mapInArrow(run, f"glyph_id {kind}, distance long")
        out, many = (one, False) if out is None else (out.unionByName(one), True)
    return out.groupBy("glyph_id").agg(F.min("distance").alias("distance")) if many else out


def nearest(best: DataFrame) -> DataFrame:
    """The nearest prototype of each glyph, ties by class and prototype: a pre-aggregated minimum."""
    first = best.groupBy("glyph_id").agg(F.min(F.struct("distance", "char_id", "proto_id")).alias("b"))
    return first.select("glyph_id", "b.char_id", "b.proto_id", "b.distance")


def per_class_topk(best: DataFrame, k: int, size: int) -> DataFrame:
    """The k classes of smallest distance, with score 1 - distance / size and margin to the next. ``best``: a row for each glyph and class."""
    w = Window.partitionBy("glyph_id").orderBy("distance", "char_id")
    own = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k + 1)
    own = own.withColumn("score", 1 - F.col("distance") / float(size)).withColumn("margin", F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0)))
    return own.where(F.col("rank") <= k)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows less their mean, of length 1; a flat row is 0."""
    centred = rows - rows.mean(1, keepdims=True)
    norm = np.sqrt((centred * centred).sum(1, keepdims=True))
    return np.divide(centred, norm, out=np.zeros_like(centred), where=norm > 0)


def ncc_best(glyphs: DataFrame, bank: DataFrame, rows: int = BROADCAST_PROTOTYPES) -> DataFrame:
    """(glyph_id, char_id, ncc): largest correlation of each glyph with each class of the bank, 0 at least; a matrix product for each batch and part."""
    kind = glyphs.schema["glyph_id"].dataType.simpleString()
    own, out = glyphs.select("glyph_id", "vec"), None
    for part in chunks(bank.select("char_id", "vec"), ["char_id", "vec"], rows):
        shared = glyphs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            classes, first, _, vectors = by_class(shared.value, "vec")
            vectors = unit(vectors.astype(np.float64))
            for batch in batches:
                step = max(1, AT_ONCE // max(1, len(vectors)))
                for at in range(0, batch.num_rows if len(classes) else 0, step):
                    some = batch.slice(at, step)
                    best = np.maximum.reduceat(unit(matrix(some.column(1)).astype(np.float64)) @ vectors.T, first, axis=1)
                    yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(np.repeat(np.arange(some.num_rows), len(classes)))), pa.array(np.tile(classes, some.num_rows), pa.int64()), pa.array(np.maximum(best, 0.0).ravel())], names=["glyph_id", "char_id", "ncc"])

        one = own.mapInArrow(run, f"glyph_id {kind}, char_id long, ncc double")
        out, many = (one, False) if out is None else (out.unionByName(one), True)
    return out.groupBy("glyph_id", "char_id").agg(F.max("ncc").alias("ncc")) if many else out


#: Fixed value: the way of shrinking whose prototypes stand for a clean line.
CLEAN_MODE = 2


def char_evidence(wanted: DataFrame, glyphs: DataFrame, prototypes: DataFrame, size: int, rows: int = BROADCAST_PROTOTYPES) -> DataFrame:
    """What templates say of single characters: best distance, score and prototype, whether any has a similar ink, and the best score of each render state.

    ``wanted``: glyph_id, char_id; ``glyphs``: glyph_id, bits, ink; ``prototypes``: char_id, proto_id, render_size, mode, bits, ink. A character without prototypes has
    the score 0. Only a character's own prototypes are looked at: they go to the tasks in parts, and a kernel keeps the least of each render state, so no pair becomes a row.
    """
    state = F.when(F.col("mode") == CLEAN_MODE, "clean").otherwise(F.concat_ws("_", "render_size", "mode"))
    kind, char = glyphs.schema["glyph_id"].dataType.simpleString(), wanted.schema["char_id"].dataType.simpleString()
    prototypes = prototypes.where("bits IS NOT NULL AND char_id IS NOT NULL")
    asked, each = wanted.where("char_id IS NOT NULL").join(glyphs.where("bits IS NOT NULL").select("glyph_id", "bits", F.col("ink").cast("long").alias("ink")), "glyph_id").select("glyph_id", F.col("char_id").cast("long").alias("char_id"), "bits", "ink"), None
    for part in chunks(prototypes.select(F.col("char_id").cast("long").alias("char_id"), F.col("proto_id").cast("long").alias("proto_id"), state.alias("state"), "bits", F.col("ink").cast("long").alias("ink")), ["char_id", "proto_id"], rows):
        shared = glyphs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            part = shared.value.sort_by([("char_id", "ascending"), ("state", "ascending"), ("proto_id", "ascending")])
            names = part.column("state").combine_chunks().dictionary_encode()
            p_char, p_state, proto, p_ink = part.column("char_id").to_numpy(), names.indices.to_numpy(), part.column("proto_id").to_numpy(), part.column("ink").to_numpy()
            words = matrix(part.column("bits").combine_chunks()).view(np.uint64)
            for batch in batches:
                chars, ink, mine = batch.column(1).to_numpy(), batch.column(3).to_numpy(), matrix(batch.column(2)).view(np.uint64)
                for c in np.unique(chars):
                    some, low, high = np.flatnonzero(chars == c), np.searchsorted(p_char, c, side="left"), np.searchsorted(p_char, c, side="right")
                    if low == high:
                        continue
                    first = np.flatnonzero(np.diff(p_state[low:high], prepend=-1))
                    step = max(1, AT_ONCE // ((high - low) * words.shape[1]))
                    for at in range(0, len(some), step):
                        few = some[at : at + step]
                        apart = sum(np.bitwise_count(mine[few, k, None] ^ words[None, low:high, k]).astype(np.int64) for k in range(words.shape[1]))
                        least = np.minimum.reduceat(apart * (high - low) + np.arange(high - low), first, axis=1)
                        near = np.logical_or.reduceat(np.abs(ink[few, None] - p_ink[None, low:high]) <= (np.floor(INK_SHARE * ink[few]) + INK_EXTRA)[:, None], first, axis=1)
                        ids = batch.column(0).take(pa.array(np.repeat(few, len(first))))
                        states = names.dictionary.take(pa.array(np.tile(p_state[low + first], len(few))))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(ids), c), pa.int64()), states.cast(pa.string()), pa.array((least // (high - low)).ravel(), pa.int64()), pa.array(proto[low + least % (high - low)].ravel(), pa.int64()), pa.array(near.ravel())], names=["glyph_id", "char_id", "state", "distance", "proto_id", "near"])

        one = asked.mapInArrow(run, f"glyph_id {kind}, char_id long, state string, distance long, proto_id long, near boolean")
        each = one if each is None else each.unionByName(one)
    each = each.withColumn("char_id", F.col("char_id").cast(char)).groupBy("glyph_id", "char_id", "state").agg(F.min(F.struct("distance", F.col("proto_id").cast(prototypes.schema["proto_id"].dataType).alias("proto_id"))).alias("b"), F.max("near").alias("near"))
    best = each.groupBy("glyph_id", "char_id").agg(F.min("b").alias("b"), F.max("near").alias("coarse_hit"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("state", (1 - F.col("b.distance") / float(size)).alias("score"))))).alias("states"))
    found = wanted.join(best, ["glyph_id", "char_id"], "left")
    distance = F.coalesce("b.distance", F.lit(size).cast("long"))
    return found.select("glyph_id", "char_id", distance.alias("distance"), (1 - distance / float(size)).alias("score"), F.coalesce("b.proto_id", F.lit(-1)).alias("proto_id"), F.coalesce("coarse_hit", F.lit(False)).alias("coarse_hit"), "states")
