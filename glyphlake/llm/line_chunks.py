"""Line deduplication by content-defined chunks, in DataFrame operations only.

A rolling hash over the hashes of ``WINDOW`` = 2 successive lines chooses where chunks begin, so an insertion moves no
boundary beyond the next line. Chunks of at least ``LEAST_LINES`` lines that stand elsewhere in the corpus too are removed, but
for their first place by (doc_id, row, place). Chunks are brought together by a 64-bit hash and told apart by their bytes.

Skew: the first place of a chunk is a minimum that each task finds for itself first, together with the least and the greatest bytes of the
hash, so a chunk that a third of the corpus has is one row a task. Only if two contents share a hash are that hash's chunks told apart by their bytes.
Places, not chunks, are then joined with the first ones (``naming.attach``); texts are moved once, to lose lines. Nothing but numbers is broadcast.

A chunk's cut depends on the line before it, so this finds only a part of short repeated passages. ``deduplicate_passages`` leaves
the chunks out and looks at every two successive lines and every long line, so it finds all passages of ``LEAST_LINES`` lines or more.

Defined results: a null or empty text is one empty line; repeated rows are told apart by their place in the scan (see
``naming``); null ids come first; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text
from .naming import attach

#: A chunk begins where the rolling hash is divisible by this.
DIVISOR = 4
LEAST_LINES = 2
MULTIPLIER, MODULUS = 31, 1 << 32
#: A single line of more bytes is a passage of its own; every line of over 50 words has more.
LONG_LINE = 100


def line_hash(line):
    """32 bits of a digest that other engines have too."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def chunks_of(docs: DataFrame, divisor: int = DIVISOR, carried: list[str] | None = None) -> tuple[DataFrame, Column]:
    """One row per document with the lines and the starts of its chunks, after row number and id or the carried columns; and the column of its chunks: number of lines, and the lines.

    The column is to be exploded as it is: a name for it would let the optimizer test its size below the scan, hashing all lines anew for each.
    """
    hashed = lines_of(docs, carried).withColumn("hashes", F.transform("lines", line_hash))
    rolled = lambda i: (F.element_at("hashes", i) * MULTIPLIER + F.element_at("hashes", i + 1)) % MODULUS % divisor == 0
    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.when(i == 0, True).otherwise(rolled(F.greatest(i, F.lit(1)))))
    marked = hashed.select("row", "doc_id", *(carried or []), "lines", starts.alias("starts"))
    following = lambda k: F.coalesce(F.try_element_at("starts", k + 2), F.size("lines"))
    chunk = lambda s, k: F.struct((following(k) - s).alias("n_lines"), F.array_join(F.slice("lines", s + 1, following(k) - s), "\n").alias("chunk"))
    return marked, F.transform("starts", chunk)


def repeats(marked: DataFrame, chunks: Column, least_lines: int = LEAST_LINES, hashed=F.xxhash64) -> DataFrame:
    """(row, gone): the places of chunks that stand earlier in the corpus."""
    many = marked.select("row", "doc_id", F.posexplode(chunks).alias("pos", "c")).select("row", "doc_id", "pos", "c.*").where(F.col("n_lines") >= least_lines).withColumn("h", hashed("chunk"))
    place = F.struct("doc_id", "row", "pos")
    groups = many.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.min("chunk").alias("least"), F.max("chunk").alias("most"))
    groups = cut(groups.where("n > 1").select("h", "n", "first", (F.col("least") != F.col("most")).alias("shared")), "chunk-groups")
    later = attach(many.select("row", "doc_id", "pos", "h"), groups.where("not shared"), ["h"], "n").where(~place.eqNullSafe(F.col("first"))).select("row", "pos")
    if not groups.where("shared").isEmpty():
        own = many.join(groups.where("shared").select("h"), "h", "left_semi")
        first = own.groupBy("h", "chunk").agg(F.min(place).alias("first"))
        later = later.unionByName(own.join(first, ["h", "chunk"]).where(~place.eqNullSafe(F.col("first"))).select("row", "pos"))
    return later.groupBy("row").agg(F.collect_set("pos").alias("gone"))


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR, least_lines: int = LEAST_LINES, hashed=F.xxhash64) -> DataFrame:
    """One row per document: its lines and chunks, how many were removed, and the text that is left."""
    docs = id_and_text(docs, id_col, text_col)
    gone = cut(repeats(*chunks_of(docs, divisor), least_lines, hashed), "chunk-gone")
    own = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = own.join(gone.hint("merge"), "row", "left")  # the same plan at every size: its list grows with the corpus
    own, chunks = chunks_of(own, divisor, carried=["text", "gone"])
    own = own.select("doc_id", "text", "gone", chunks.alias("chunks"))
    lost = lambda c, k: F.array_contains("gone", k)
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(F.filter("chunks", lambda c, k: ~lost(c, k)), lambda c: c["chunk"]), "\n"))
    lines = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda n, c: n + c["n_lines"])
    removed = F.when(F.col("gone").isNull(), 0).otherwise(lines(F.filter("chunks", lost)))
    return own.select("doc_id", lines(F.col("chunks")).alias("n_lines"), F.size("chunks").cast("long").alias("n_chunks"), removed.cast("long").alias("n_removed_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed_chunks"), text.alias("text"))


def lines_of(docs: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """The lines of each text. Rows are numbered by their place in the scan, unless they have been."""
    own = [F.monotonically_increasing_id().alias("row"), "doc_id"] if carried is None else ["row", "doc_id", *carried]
    return docs.select(*own, F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))


def name_line(line):
    return F.xxhash64(line)


def clashing(docs: DataFrame) -> list[int]:
    """Hashes that stand for lines of different bytes: none but by chance or intent. Copies of a line meet in each task first."""
    each = lines_of(docs).select(F.explode("lines").alias("line")).select(name_line(F.col("line")).alias("h"), "line").distinct()
    return [x.h for x in each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h").collect()]


def passages(docs: DataFrame, clash: list[int], long_line: int = LONG_LINE) -> DataFrame:
    """One row per two successive lines and per long line: row, id, place, number of lines, their hashes, and their bytes where a hash clashes."""
    hashed = lines_of(docs).withColumn("hashes", F.transform("lines", name_line))
    line, h = lambda i: F.element_at("lines", i), lambda i: F.element_at("hashes", i)
    told = lambda i, n: F.when(F.arrays_overlap(F.slice("hashes", i, n), F.array(*map(F.lit, clash))), F.array_join(F.slice("lines", i, n), "\n")).otherwise("") if clash else F.lit("")
    part = lambda i, n, b: F.struct((i - 1).alias("pos"), F.lit(n).alias("n"), h(i).alias("a"), b.alias("b"), told(i, n).alias("c"))
    every = F.sequence(F.lit(1), F.size("lines"))
    pairs = F.transform(F.filter(every, lambda i: i < F.size("lines")), lambda i: part(i, 2, h(i + 1)))
    singles = F.transform(F.filter(every, lambda i: F.octet_length(line(i)) > long_line), lambda i: part(i, 1, F.lit(0).cast("long")))
    return hashed.select("row", "doc_id", F.explode(F.concat(pairs, singles)).alias("p")).select("row", "doc_id", "p.*")


def removed_lines(docs: DataFrame, long_line: int = LONG_LINE) -> DataFrame:
    """(row, gone): the places of lines in a passage that stands earlier in the corpus without overlapping, after a -1."""
    keys, place = ["n", "a", "b", "c"], F.struct("doc_id", "row", "pos")
    own = cut(passages(docs, clashing(docs), long_line), "passages")
    groups = cut(own.groupBy(*keys).agg(F.min(place).alias("first"), F.count("*").alias("rows")).where("rows > 1"), "passage-groups")
    later = attach(own, groups, keys, "rows").where((F.col("row") != F.col("first.row")) | (F.col("pos") >= F.col("first.pos") + F.col("n")))
    gone = later.select("row", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)).alias("at"))
    return gone.groupBy("row").agg(F.array_sort(F.concat(F.array(F.lit(-1)), F.collect_set("at"))).alias("gone"))


def deduplicate_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_line: int = LONG_LINE) -> DataFrame:
    """One row per document: its lines, how many were removed, and the text that is left.

    A line goes if it and a neighbour, or it alone if it is long, stand earlier by (doc_id, row, place) too. The first place of
    a line's bytes never goes. Only hashes and places are grouped; bytes are shuffled once to tell hashes apart, texts once to lose lines.
    """
    docs = id_and_text(docs, id_col, text_col)
    gone = cut(removed_lines(docs, long_line), "passage-lines")
    own = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = own.join(gone.hint("merge"), "row", "left")  # the same plan at every size: its list grows with the corpus
    own = own.withColumn("lines", F.split("text", "\n", -1))
    until = lambda k: F.coalesce(F.try_element_at("gone", k + 2), F.size("lines"))
    kept = F.transform("gone", lambda g, k: F.slice("lines", g + 2, until(k) - g - 1))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(kept), "\n"))
    n_removed = F.coalesce(F.size("gone") - 1, F.lit(0))
    return own.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(n_removed).cast("long").alias("n_removed_lines"), text.alias("text"))
