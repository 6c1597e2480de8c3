"""Runs, lines, components, candidate ranges and paths over ordered atoms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .segmentation import ahead, ranges_of


#: Bytes of edges, as Spark estimates them, for each partition of a shuffle; and partitions at most, each of which is a file of a shuffle's map task.
PART_BYTES, MOST_PARTS = 1_000_000, 4096


def runs(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Runs of equal neighbours: (key, run, value, length)."""
    w = Window.partitionBy(key).orderBy(*order)
    own = df.withColumn("_new", F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    own = own.withColumn("run", F.sum("_new").over(w))
    return own.groupBy(key, "run").agg(F.first(value).alias(value), F.count("*").alias("length"))


def line_groups(df: DataFrame, key: str, position: str, gap: float, least: float = 0) -> DataFrame:
    """Groups of positions whose neighbours lie at most ``gap`` apart, of a span of ``least`` or more."""
    w = Window.partitionBy(key).orderBy(position)
    own = df.withColumn("line", F.sum(F.when(F.col(position) - F.lag(position).over(w) <= gap, 0).otherwise(1)).over(w))
    out = own.groupBy(key, "line").agg(F.min(position).alias("y0"), F.max(position).alias("y1"), F.count("*").alias("n"))
    return out.where(F.col("y1") - F.col("y0") >= least)


def connected_components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component) by smallest reachable node. Labels jump through their own labels, so a chain takes log rounds; raises if the rounds don't suffice.

    Each round is a written table, which keeps plans short and survives lost executors. Shuffles get a partition for every PART_BYTES of the
    edges' files at least, so what a task sorts does not grow with the table.
    """
    spark = edges.sparkSession
    before = spark.conf.get("spark.sql.shuffle.partitions")
    size = int(str(edges._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    spark.conf.set("spark.sql.shuffle.partitions", str(max(int(before), min(MOST_PARTS, size // PART_BYTES))))
    try:
        return settled(edges, rounds)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def settled(edges: DataFrame, rounds: int) -> DataFrame:
    """The rounds of ``connected_components``."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = written(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = written(both.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        least = labels.join(near, "node", "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = least.alias("l").join(least.select(F.col("node").alias("component"), F.col("component").alias("further")), "component", "left")
        after = written(jump.select("node", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        changed = not after.join(labels.withColumnRenamed("component", "old"), "node").where("component <> old").isEmpty()
        labels = after
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def ordered_atoms(df: DataFrame, line: str, order: list[str]) -> DataFrame:
    return df.withColumn("atom_idx", F.row_number().over(Window.partitionBy(line).orderBy(*order)) - 1)


def candidate_ranges(atoms: DataFrame, longest: int, first: list[str] = []) -> DataFrame:  # noqa: B006
    """All ranges of up to ``longest`` neighbouring atoms with their bounding boxes, and the columns ``first`` of the atom each begins with.

    The next atoms are offsets in a window: one shuffle on the line, no self-join.
    """
    at = lambda k, f: F.col(f"_{k}_{f}")
    own = ahead(atoms.select("line_id", "atom_idx", "x", "w", "h", *first), ["x", "w", "h"], longest)

    def one(n: int) -> Column:
        ends = [F.greatest(*c) if n > 1 else c[0] for c in ([at(k, "x") + at(k, "w") for k in range(n)], [at(k, "h") for k in range(n)])]
        left = F.least(*(at(k, "x") for k in range(n))) if n > 1 else at(0, "x")
        return F.struct(F.col("atom_idx").alias("start"), (F.col("atom_idx") + n).alias("end"), left.alias("x"), (ends[0] - left).alias("w"), ends[1].alias("h"))

    return ranges_of(own, longest, one, ["line_id", *first])


def coverage(segments: DataFrame, boxes: DataFrame, bucket: float, threshold: float = 0.9) -> DataFrame:
    """Best-covering box of each segment: overlap over the longer of both, by an equi-join on buckets of x.

    A pair meets in the bucket of the larger of both starts only, so no duplicates need removing.
    """
    spread = lambda d, a, b: d.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket))))
    s, b = spread(segments, "x0", "x1"), spread(boxes, "b0", "b1")
    both = s.join(b, ["line_id", "bucket"]).where((F.col("x0") < F.col("b1")) & (F.col("b0") < F.col("x1")) & (F.floor(F.greatest("x0", "b0") / bucket) == F.col("bucket")))
    share = (F.least("x1", "b1") - F.greatest("x0", "b0")) / F.greatest(F.col("x1") - F.col("x0"), F.col("b1") - F.col("b0"))
    best = both.withColumn("coverage", share).groupBy("line_id", "seg_id").agg(F.max(F.struct("coverage", (-F.col("box_id")).alias("k"))).alias("b"))
    return best.select("line_id", "seg_id", (-F.col("b.k")).alias("box_id"), F.col("b.coverage").alias("coverage"), (F.col("b.coverage") >= threshold).alias("assigned"))


def path_scores(paths: DataFrame, w_visual: float = 1.0, w_geometry: float = 1.0, w_lexicon: float = 0.2, w_prior: float = 0.15, penalty: float = 0.005) -> DataFrame:
    """Score of each path over its candidates' means: the lexicon term counts where vision is unsure."""
    own = paths.groupBy("line_id", "path_id").agg(F.avg("visual").alias("v"), F.avg("geometry").alias("g"), F.avg("lexicon").alias("l"), F.avg("prior").alias("p"), F.count("*").alias("n"))
    total = w_visual * F.col("v") + w_geometry * F.col("g") + w_lexicon * F.col("l") * (1 - F.col("v")) + w_prior * F.col("p") - penalty * (F.col("n") - 1)
    return own.select("line_id", "path_id", "n", total.alias("score"))


def reachable_cover(candidates: DataFrame, truth: DataFrame, tolerance: float) -> DataFrame:
    """Whether the truth boxes of a line are covered exactly by a chain of candidates, one for each box in order.

    A box can end at an atom if it matches a candidate that starts where the box before could end. Lines are walked as arrays in one fold, so there is one
    shuffle on the line and no recursion.
    """
    matched = truth.join(candidates, "line_id").where((F.abs(F.col("x") - F.col("t0")) <= tolerance) & (F.abs(F.col("x") + F.col("w") - F.col("t1")) <= tolerance))
    steps = matched.groupBy("line_id", "idx").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    lines = steps.groupBy("line_id").agg(F.sort_array(F.collect_list(F.struct("idx", "spans"))).alias("steps"))
    size = truth.groupBy("line_id").agg(F.count("*").alias("n_boxes"))
    atoms = candidates.groupBy("line_id").agg(F.max("end").alias("n_atoms"))
    zero = F.array(F.lit(0)).cast("array<int>")

    def step(at, one):
        return F.array_distinct(F.transform(F.filter(one["spans"], lambda s: F.array_contains(at, s["start"])), lambda s: s["end"].cast("int")))

    out = size.join(atoms, "line_id").join(lines, "line_id", "left")
    last = F.aggregate("steps", zero, step)
    ok = (F.size(F.coalesce("steps", F.array().cast(lines.schema["steps"].dataType))) == F.col("n_boxes")) & F.array_contains(last, F.col("n_atoms").cast("int"))
    return out.select("line_id", "n_boxes", F.coalesce(ok, F.lit(False)).alias("recalled"))
