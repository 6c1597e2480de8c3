"""Binary template sets, network weights, geometry and model folders, on any file system Spark reads."""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The file format's magic number and its narrow class.
MAGIC = int.from_bytes(b"TPL2", "little")
NARROW_BELOW = 0.8
PROTOTYPE = "char_id int, proto_id int, render_size int, dx int, dy int, mode int, bits array<bigint>"
#: Tensors of the network in file order, for a number of classes.
TENSORS = (
    ("conv1_w", (8, 1, 3, 3)), ("conv1_b", (8,)), ("dw1_w", (8, 3, 3)), ("dw1_b", (8,)), ("pw1_w", (16, 8)), ("pw1_b", (16,)),
    ("dw2_w", (16, 3, 3)), ("dw2_b", (16,)), ("pw2_w", (32, 16)), ("pw2_b", (32,)),
)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file's bytes, by Spark's own reader."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first().content)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def words_of(bits: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of signed 64-bit words, padded with zeros."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 8) * 8), np.uint8)
    wide[:, : bits.shape[1]] = bits
    return wide.view("<i8")


def parse_templates(raw: bytes, size: int = 24) -> pd.DataFrame:
    """A template set: header of four words, four bytes of metadata and the packed bits of each prototype."""
    if len(raw) < 16:
        raise ValueError("the file is too small")
    magic, classes, per_class, width = struct.unpack("<IIII", raw[:16])
    if magic != MAGIC:
        raise ValueError("the file is no template set")
    n = classes * per_class
    if width != (size * size + 7) // 8 or len(raw) != 16 + n * (4 + width):
        raise ValueError("the file's length doesn't match its header")
    meta = np.frombuffer(raw, np.uint8, n * 4, 16).reshape(n, 4)
    bits = np.frombuffer(raw, np.uint8, n * width, 16 + n * 4).reshape(n, width)
    out = pd.DataFrame(meta.astype(np.int32), columns=["render_size", "dx", "dy", "mode"])
    out.insert(0, "char_id", np.repeat(np.arange(classes, dtype=np.int32), per_class))
    out.insert(1, "proto_id", np.tile(np.arange(per_class, dtype=np.int32), classes))
    return out.assign(bits=list(words_of(bits)))


def read_templates(spark: SparkSession, path: str, size: int = 24) -> DataFrame:
    """Prototype rows of one or many template files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["content"]:
                yield parse_templates(bytes(raw), size)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, PROTOTYPE)


def write_templates(prototypes: DataFrame, path: str, size: int = 24) -> None:
    """One template file. A set is bounded by its charset; it is gathered in order on the driver."""
    rows = prototypes.orderBy("char_id", "proto_id").toPandas()
    classes, width = int(rows["char_id"].max()) + 1, (size * size + 7) // 8
    per_class = len(rows) // classes
    if per_class * classes != len(rows):
        raise ValueError("each class needs as many prototypes")
    meta = rows[["render_size", "dx", "dy", "mode"]].to_numpy(np.uint8)
    bits = np.stack([np.asarray(b, "<i8") for b in rows["bits"]]).view(np.uint8)[:, :width]
    write_bytes(prototypes.sparkSession, path, struct.pack("<IIII", MAGIC, classes, per_class, width) + meta.tobytes() + np.ascontiguousarray(bits).tobytes())


def tensor_shapes(classes: int) -> list[tuple[str, tuple[int, ...]]]:
    return [*TENSORS, ("fc_w", (classes, 32)), ("fc_b", (classes,))]


def read_weights(spark: SparkSession, path: str, classes: int) -> dict[str, np.ndarray]:
    values, out, at = np.frombuffer(read_bytes(spark, path), "<f4"), {}, 0
    shapes = tensor_shapes(classes)
    if len(values) != sum(int(np.prod(s)) for _, s in shapes):
        raise ValueError("the file's length doesn't match the network")
    for name, shape in shapes:
        out[name] = values[at : at + int(np.prod(shape))].reshape(shape)
        at += int(np.prod(shape))
    return out


def write_weights(spark: SparkSession, path: str, weights: dict[str, np.ndarray], classes: int) -> None:
    for name, shape in tensor_shapes(classes):
        if weights[name].shape != shape:
            raise ValueError(f"{name} must have the shape {shape}")
    write_bytes(spark, path, b"".join(np.ascontiguousarray(weights[n], "<f4").tobytes() for n, _ in tensor_shapes(classes)))


GEOMETRY = "format string, entries array<struct<char_id:int,advance:double,bbox_width:double,bbox_height:double,aspect_ratio:double,ink_count:int,component_count:int,baseline:double,baseline_ratio:double,ink_ratio:double>>"


def read_geometry(spark: SparkSession, path: str) -> DataFrame:
    """(char_id, metrics…) of a geometry file."""
    return spark.read.schema(GEOMETRY).json(path, multiLine=True).select(F.explode("entries").alias("e")).select("e.*")


def write_geometry(entries: DataFrame, path: str, tag: str = "geometry-v1") -> None:
    rows = [r.asDict() for r in entries.orderBy("char_id").collect()]  # one row for each character of a charset
    write_bytes(entries.sparkSession, path, json.dumps({"format": tag, "entries": rows}).encode())


def geometry_classes(entries: DataFrame) -> DataFrame:
    """Median, least and most of width and height to advance, of narrow and full characters."""
    own = entries.withColumn("narrow", F.col("aspect_ratio") < NARROW_BELOW)
    width, height = F.col("bbox_width") / F.col("advance"), F.col("bbox_height") / F.col("advance")
    return own.where("advance > 0").groupBy("narrow").agg(F.median(width).alias("width_ratio"), F.min(width).alias("width_min"), F.max(width).alias("width_max"), F.median(height).alias("height_ratio"), F.max("advance").alias("advance_max"), F.count("*").alias("n"))


def registered_hash(spark: SparkSession, path: str, registry: dict[str, str]) -> str:
    """SHA-256 of a file that the registry lists; raises where they differ."""
    found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("sha")).first().sha
    if registry.get(path.rsplit("/", 1)[-1]) != found:
        raise ValueError("the file isn't the registered one")
    return found


def read_glyph_bank(spark: SparkSession, path: str) -> DataFrame:
    """(char, proto_id, vec) of an archive with the arrays ``labels`` and ``data``; patches keep their order by character."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["content"]:
                with np.load(io.BytesIO(bytes(raw)), allow_pickle=False) as bank:
                    out = pd.DataFrame({"char": bank["labels"].astype(str), "vec": [v.ravel().astype(np.float64) for v in bank["data"]]})
                yield out.assign(proto_id=out.groupby("char").cumcount())[["char", "proto_id", "vec"]]

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "char string, proto_id int, vec array<double>")


def union_datasets(parts: list[DataFrame]) -> DataFrame:
    """Labelled samples (label, font_sha256, …) of several sources as one, with class ids by first appearance; one font only."""
    from ..operators.lexicon import first_seen

    own = [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    both = own[0]
    for p in own[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    if both.select("font_sha256").distinct().limit(2).count() > 1:
        raise ValueError("all samples must be of one font")
    seen = first_seen(both.select("label", "part").distinct(), ["label"], ["part"])
    everything = seen.agg(F.sort_array(F.collect_list(F.struct("part", "label"))).alias("all"))  # a charset bounds it
    ids = everything.select(F.posexplode("all").alias("char_id", "c")).select("char_id", "c.label")
    return both.join(ids, "label").drop("part")
