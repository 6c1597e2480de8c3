"""Exact deduplication by deterministic block naming, in DataFrame operations only.

A text's UTF-8 bytes are cut into blocks of ``BLOCK`` bytes. Equal blocks get one name and different blocks different names: blocks are
sorted by a 64-bit hash and then by content, and a name is (hash, rank of the content among those of that hash), so two
blocks that share a hash still differ. Adjacent names are then paired and the pairs named in the same way, level by level, until a
document has one name. With the number of blocks it is the document's identity, free of collisions.

Ranks are found without bringing a name's rows together: each task sends the least and the greatest content of a hash, which are the
same unless contents share the hash. Only then are the few distinct contents of these hashes sorted and joined with their rows; all others have rank 1. So
a block that fills a third of the corpus is one row a task, at any size.

Defined results: null counts as empty; of equal texts the row of the largest doc_id stays, and of rows repeated with that
id one; null ids are the smallest; an empty table gives an empty table; other columns are ignored, and kept by ``keep_one`` whatever they are called. ``docs`` has to be a
scan that gives the same rows in the same order when read again (a table in files), since rows are told apart by their place in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, id_and_text

BLOCK = 16_384
HOT = 1 / 2000
#: Groups up to this size are never hot.
LEAST_HOT = 64


def hot_share(stats: DataFrame, count: str = "n") -> float:
    """The number of rows above which a group is hot."""
    return max(LEAST_HOT, (stats.agg(F.sum(count)).first()[0] or 0) * HOT)


def name_rows(rows: DataFrame, content: list[str], table: str) -> DataFrame:
    """Put the rank r of the content among those of its hash h in the place of the content."""
    key = F.struct(*content)
    ends = rows.groupBy("h").agg(F.min(key).alias("least"), F.max(key).alias("most"))
    shared = cut(ends.where("least <> most").select("h"), f"{table}-shared")
    first = F.lit(1).alias("r")
    others = [c for c in rows.columns if c not in content]
    if shared.isEmpty():  # the rule: 64-bit hashes hardly ever meet
        return rows.select(*others, first)
    ranks = rows.join(shared, "h", "left_semi").select("h", *content).distinct()
    ranks = ranks.withColumn("r", F.dense_rank().over(Window.partitionBy("h").orderBy(*content)))
    told = rows.join(shared, "h", "left_semi").join(ranks, ["h", *content]).select(*others, "r")
    return rows.join(shared, "h", "left_anti").select(*others, first).unionByName(told)


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Join each row with its group. Hot groups, at most 1 / HOT rows, are broadcast; the others are joined by shuffle."""
    limit = hot_share(groups, size)
    hot, cold = groups.where(F.col(size) > limit), groups.where(F.col(size) <= limit)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(cold, keys))


def blocks_of(docs: DataFrame, block: int, hashed=F.xxhash64) -> DataFrame:
    """One row per block: row number, id, digest of the text (at its first block), place, number of blocks, bytes and their hash."""
    text = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))
    text = text.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / block)).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.substring("bytes", i * block + 1, F.lit(block)))
    out = text.select("row", "doc_id", F.sha2("bytes", 256).alias("sha"), "blocks", F.posexplode(parts).alias("pos", "block"))
    return out.withColumns({"sha": F.when(F.col("pos") == 0, F.col("sha")), "h": hashed("block")})


def identities(docs: DataFrame, block: int = BLOCK, hashed=F.xxhash64) -> DataFrame:
    """One row per document with its identity (blocks, h, r)."""
    blocks = blocks_of(docs, block, hashed)
    level = cut(name_rows(blocks, ["block"], "names-0").withColumn("width", F.col("blocks")), "names-0")
    width, done, k = level.agg(F.max("blocks")).first()[0] or 1, [level.where("width = 1")], 0
    while width > 1:
        side = lambda c, s: F.coalesce(F.max(F.when(F.col("pos") % 2 == s, F.col(c))), F.lit(0))
        pairs = level.where("width > 1").groupBy("row", (F.col("pos") / 2).cast("int").alias("pos"))
        pairs = pairs.agg(F.max("doc_id").alias("doc_id"), F.max("sha").alias("sha"), F.max("blocks").alias("blocks"), F.ceil(F.max("width") / 2).cast("int").alias("width"), side("h", 0).alias("h0"), side("r", 0).alias("r0"), side("h", 1).alias("h1"), side("r", 1).alias("r1"))
        content, k, width = ["h0", "r0", "h1", "r1"], k + 1, -(-width // 2)
        pairs = cut(pairs.withColumn("h", hashed(*content)), f"pairs-{k}")
        level = cut(name_rows(pairs, content, f"names-{k}"), f"names-{k}")
        discard(pairs)
        done.append(level.where("width = 1"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("row", "doc_id", "sha", "blocks", "h", "r")


def exact_rows(docs: DataFrame, block: int = BLOCK, hashed=F.xxhash64) -> DataFrame:
    """Each row of (doc_id, text) by its place in the scan, with its group."""
    rows, keys = cut(identities(docs, block, hashed), "identities"), ["blocks", "h", "r"]
    groups = cut(rows.groupBy(*keys).agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size")), "groups")
    return attach(rows, groups, keys, "group_size")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, hashed=F.xxhash64) -> DataFrame:
    """One row per document: the id that stays for its text, the group's size, whether this row stays, the text's digest."""
    out = exact_rows(id_and_text(docs, id_col, text_col), block, hashed)
    return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("keep.row") == F.col("row")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns. Rows that go are known by their place in the scan; texts are moved once at most."""
    gone = cut(exact_rows(id_and_text(docs)).where("keep.row <> row").select("row"), "gone")
    own = docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row"))
    return own.join(gone, "row", "left_anti").select("doc.*")
