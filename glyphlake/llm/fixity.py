"""Merkle fixity audit of WARC replicas.

Every record is hashed where it is read. The tree stands over the records' ids in order: a leaf is one id, a node is
``FANOUT`` neighbouring nodes, and each carries the bytes it spans, so nodes are ordered offset ranges of the archive. Two replicas
are compared from the root, and only children of nodes that differ are looked at; offsets are added up on the way down.

An id may have several records, up to a third of all: a leaf's hash therefore sums the words of its records' digests,
which is pre-aggregated in each task and doesn't depend on their order. ``audit_records`` goes on below the differing ids, to single records
by their digest and count. The order of the records within an id is not audited: two that change places are no difference. Nothing larger than ``FANOUT`` rows is gathered into one row.

Ids may span all 64 bits: nodes are numbered from the level above the leaves on, by the id's high bits.

Defined results: a null id is a leaf of its own before all others; a null url or body counts as empty; repeated records
count; an empty replica against a full one reports every leaf; two empty ones report none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard
from .naming import attach

FANOUT = 16
WORDS = 8


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(id, record): each page as the bytes of a WARC response record."""
    url, body = F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(body_col), F.lit(""))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), name, F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.col(id_col).cast("long").alias("id"), F.concat(head, body, F.lit("\r\n\r\n")).alias("record"))


def shift_of(fanout: int) -> int:
    shift = fanout.bit_length() - 1
    if shift < 2 or fanout != 1 << shift:
        raise ValueError("fanout is a power of two, 4 at least")
    return shift


def leaves(records: DataFrame, least: int, shift: int) -> DataFrame:
    """(up, slot, bytes, hash) of each id. ``up`` is its node of the level above, 0 for the null id, others counted from that of the smallest id of both replicas."""
    one = records.select("id", F.octet_length("record").cast("long").alias("bytes"), F.sha2("record", 256).alias("sha"))
    word = lambda k: F.conv(F.substring("sha", 8 * k + 1, 8), 16, 10).cast("long")
    out = one.groupBy("id").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), *(F.sum(word(k)).alias(f"w{k}") for k in range(WORDS)))
    up = F.coalesce(F.shiftright("id", shift) - F.lit((least >> shift) - 1), F.lit(0))
    return out.select(up.alias("up"), F.coalesce("id", F.lit(0)).alias("slot"), "bytes", F.sha2(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), "n", "bytes", *(f"w{k}" for k in range(WORDS))).cast("binary"), 256).alias("hash"))


def parents(nodes: DataFrame, shift: int) -> DataFrame:
    """The level above: at most as many children each as the fan-out is."""
    out = nodes.groupBy(F.col("up").alias("slot")).agg(F.sum("bytes").alias("bytes"), F.sort_array(F.collect_list(F.struct("slot", "hash"))).alias("below"))
    return out.select(F.shiftright("slot", shift).alias("up"), "slot", "bytes", F.sha2(F.array_join(F.transform("below", lambda x: F.concat_ws("=", x["slot"], x["hash"])), ",").cast("binary"), 256).alias("hash"))


def tree(records: DataFrame, least: int, depth: int, shift: int) -> list[DataFrame]:
    """Levels from the leaves to the root."""
    levels = [cut(leaves(records, least, shift), "fixity-0")]
    for k in range(depth):
        levels.append(cut(parents(levels[-1], shift), f"fixity-{k + 1}"))
    return levels


def depth_of(least: int, most: int, shift: int) -> int:
    """Levels above the leaves, up to the one node 0."""
    depth, slot = 1, (most >> shift) - (least >> shift) + 1
    while slot:
        depth, slot = depth + 1, slot >> shift
    return depth


def audit(primary: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """One row per differing id: where its records lie in the primary, bytes in both, and ``corrupt``, ``missing`` or ``extra``."""
    shift = shift_of(fanout)
    ends = [x.agg(F.min("id"), F.max("id")).first() for x in (primary, replica)]
    known = [v for e in ends for v in e if v is not None]
    least, most = (min(known), max(known)) if known else (0, 0)
    depth = depth_of(least, most, shift)
    ours, theirs = tree(primary, least, depth, shift), tree(replica, least, depth, shift)
    open_ = None
    for k in range(depth, -1, -1):
        a = ours[k].select("up", "slot", F.col("bytes").alias("expected_bytes"), F.col("hash").alias("expected"))
        b = theirs[k].select("up", "slot", F.col("bytes").alias("actual_bytes"), F.col("hash").alias("actual"))
        if open_ is None:
            pairs = a.join(b, ["up", "slot"], "full").withColumn("base", F.lit(0).cast("long"))
        else:
            above = open_.select(F.col("slot").alias("up"), F.col("offset").alias("base"))
            pairs = a.join(above, "up").join(b.join(above, "up"), ["up", "base", "slot"], "full")
        # Bytes of the siblings before it: at most ``fanout`` rows in a window.
        before = Window.partitionBy("up").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
        pairs = pairs.withColumn("offset", (F.col("base") + F.coalesce(F.sum(F.coalesce("expected_bytes", F.lit(0))).over(before), F.lit(0))).cast("long"))
        old, open_ = open_, cut(pairs.where(~F.col("expected").eqNullSafe(F.col("actual"))), f"fixity-open-{k}")
        discard(ours[k], theirs[k], *([old] if old is not None else []))
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("corrupt")
    own_id = F.when(F.col("up") > 0, F.col("slot"))
    return open_.select(own_id.alias("id"), "offset", F.coalesce("expected_bytes", F.lit(0)).cast("long").alias("expected_bytes"), F.coalesce("actual_bytes", F.lit(0)).cast("long").alias("actual_bytes"), status.alias("status"))


def audit_records(primary: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """One row per differing record, (id, digest): its bytes and how often it stands in both. A rotten record is one that is gone and one that is new.

    Digests of the differing ids only are compared. They meet by id and digest, so an id of many records fills no task.
    """
    key = F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("key")
    side = lambda x, ours: x.select(key, "id", F.sha2("record", 256).alias("sha256"), F.octet_length("record").cast("long").alias("bytes"), F.lit(ours).alias("ours"))
    open_ = cut(audit(primary, replica, fanout).select(key), "fixity-ids")
    both = cut(side(primary, True).unionByName(side(replica, False)).groupBy("key", "id", "sha256", "bytes").agg(F.count_if("ours").alias("expected_n"), F.count_if(~F.col("ours")).alias("actual_n")), "fixity-records")
    sizes = cut(both.groupBy("key").agg(F.count("*").alias("size")).join(open_, "key", "left_semi"), "fixity-sizes")
    return attach(both, sizes, ["key"], "size").where("expected_n <> actual_n").select("id", "sha256", "bytes", "expected_n", "actual_n")
