"""Merkle manifest of a dataset: one root for all rows, a proof per row, and checks of rows against it.

Every row is a leaf: the SHA-256 of its columns. Leaves of a group (say a language) are numbered in
order of their ids, by ranges, so that no task holds a whole group. At every level the slot-zero
node of each run computes the indices of its siblings (its own plus 0 to arity - 1), an equijoin by
(group, index) fetches their digests, and the run emits its parent. Keys are spread evenly however
large a group is. Each level is written once; its runs are what proofs are made of. The
groups' roots are the leaves of one more tree of the same kind.

Proofs are made from the top: a node's path is its siblings in its run, then its parent's path, so
each level is joined once, with a table an arity-th of the size. A path holds (left, right) digests of
siblings per level, and folding it over a leaf gives the root again, if the row is unchanged.

Defined results: null columns are told from empty ones; null ids come first, equal ids in order of
their leaves, and rows equal in all are leaves of their own; a null group is a group that comes
first; a group of one has its leaf as root; an empty table has no root and gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import plain, sided, written

ARITY = 8


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts' concatenation, in hexadecimal."""
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """A value so that no two rows of fields read alike: '-' for null, else its UTF-8 length, ':' and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_of(values: list[Column]) -> Column:
    return digest(*[field(c) for c in values])


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows (g, id, digest and others) written with idx, their place in the group, and n, the group's rows."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["id", "digest", "r"]
    # rows that agree in all but r are alike, so r may be any number; it keeps copies from sharing a range
    rows = written(rows.withColumn("r", F.monotonically_increasing_id()), f"{name}-rows")  # ranges are sampled first, which reads rows once more
    ranged = written(rows.repartitionByRange(n, "g", *order).withColumn("part", F.spark_partition_id()), f"{name}-ranges")
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # at most a row per range and one per group
    counts = ranged.groupBy("g", "part").agg(F.count(F.lit(1)).alias("n_here"))
    counts = written(counts.select("g", "part", F.coalesce(F.sum("n_here").over(before), F.lit(0)).alias("first"), F.sum("n_here").over(Window.partitionBy("g")).alias("n")), f"{name}-counts")
    here = F.row_number().over(Window.partitionBy("g", "part").orderBy(*order)) - 1
    return written(ranged.withColumn("here", here).join(sided(counts, F.octet_length("g") + 24), ["g", "part"]).withColumn("idx", F.col("first") + F.col("here")).drop("here", "first", "part", "r"), f"{name}-nodes")


def _runs(nodes: DataFrame, arity: int) -> DataFrame:
    """g, run, n, digests (in order of slots) of the runs of groups with more than one node."""
    nodes = nodes.where("n > 1")
    slots = F.sequence(F.lit(0), F.least(F.lit(arity - 1), (F.col("n") - 1 - F.col("idx")).cast("int")))
    siblings = nodes.where(F.col("idx") % arity == 0).select("g", "n", F.floor(F.col("idx") / arity).alias("run"), "idx", F.explode(slots).alias("slot"))
    siblings = siblings.select("g", "n", "run", (F.col("idx") + F.col("slot")).alias("idx"))
    met = siblings.join(nodes.select("g", "idx", "digest"), ["g", "idx"])
    # arity rows at most
    digests = F.transform(F.sort_array(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"])
    return met.groupBy("g", "run").agg(F.max("n").alias("n"), digests.alias("digests"))


def _parents(runs: DataFrame, arity: int) -> DataFrame:
    return runs.select("g", F.col("run").alias("idx"), F.ceil(F.col("n") / arity).alias("n"), F.sha2(F.array_join("digests", ""), 256).alias("digest"))


def _levels(nodes: DataFrame, arity: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The runs of every level, and the roots: g, digest, height."""
    most, runs, roots, height = nodes.agg(F.max("n")).first()[0] or 0, [], [], 0
    while True:
        roots.append(nodes.where("n = 1").select("g", "digest", F.lit(height).alias("height")))
        if most <= 1:
            return runs, reduce(DataFrame.unionByName, roots)
        runs.append(written(_runs(nodes, arity), f"{name}-runs{height}"))
        nodes, most, height = _parents(runs[-1], arity), -(-most // arity), height + 1


def _beside(slot: Column) -> Column:
    """left and right digests of a node's siblings."""
    side = lambda d: F.array_join(d, "")
    return F.struct(side(F.slice("digests", F.lit(1), slot)).alias("left"), side(F.slice("digests", slot + 2, F.size("digests"))).alias("right"))


_PATH = "array<struct<left:string,right:string>>"


def _paths(runs: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """g, run, digests, path, top of the lowest runs: path and top of their parents, from the roots' (tops: g, height, path, top) down."""
    at = lambda height: tops.where(F.col("height") == height).select("g", F.lit(0).cast("long").alias("run"), "path", "top")
    parents = at(len(runs))
    for height in range(len(runs) - 1, -1, -1):
        met = runs[height].select("g", "run", "digests").join(parents, ["g", "run"])
        if height == 0:
            return met
        nodes = met.select("g", "run", "path", "top", "digests", F.explode(F.sequence(F.lit(0), F.size("digests") - 1)).alias("slot"))
        below = nodes.select("g", (F.col("run") * arity + F.col("slot")).alias("run"), F.concat(F.array(_beside(F.col("slot"))), "path").alias("path"), "top")
        parents = below.unionByName(at(height))


def _with_paths(nodes: DataFrame, runs: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """nodes with path, from the node to what stands above its group's root, and top, which is carried down from it."""
    lone = nodes.where("n = 1").join(tops.where("height = 0").drop("height"), "g")
    if not runs:
        return lone
    slot = (F.col("idx") % arity).cast("int")
    many = nodes.where("n > 1").withColumn("run", F.floor(F.col("idx") / arity)).join(_paths(runs, tops, arity), ["g", "run"])
    return many.withColumn("path", F.concat(F.array(_beside(slot)), "path")).select(*lone.columns).unionByName(lone)


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda at, s: digest(s["left"], at, s["right"]))


def proof(path: Column) -> Column:
    """SHA-256 of a path's sibling digests, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(df: DataFrame, id_col: str, group_col: str, columns: list[str], now: dict[str, Column] | None = None, arity: int = ARITY) -> DataFrame:
    """A row per row of df: id, leaf, subroot (its group's root), root, path, and found, the leaf of its present values.

    now gives, by column, the value found at a later check where it may differ from the one that
    was put on record; fold(path, found) equals root for rows that are unchanged.
    """
    seen = {c: plain(c) for c in columns} | (now or {})
    group = plain(group_col).cast("string")
    leaves = df.select(
        F.when(group.isNull(), "-").otherwise(F.concat(F.lit("="), group)).alias("g"),  # '-' sorts before '='
        plain(id_col).alias("id"), leaf_of([plain(c) for c in columns]).alias("digest"), leaf_of([seen[c] for c in columns]).alias("found"),
    )
    leaves = _numbered(leaves, "leaves")
    runs, subroots = _levels(leaves, arity, "leaves")
    groups = _numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("id"), "digest", "height"), "groups")
    group_runs, roots = _levels(groups, arity, "groups")
    over = _with_paths(groups, group_runs, roots.select("g", "height", F.array().cast(_PATH).alias("path"), F.struct(F.col("digest").alias("root")).alias("top")), arity)
    tops = written(over.select(F.col("id").alias("g"), "height", "path", F.struct(F.col("top.root").alias("root"), F.col("digest").alias("subroot")).alias("top")), "tops")
    rows = _with_paths(leaves, runs, tops, arity)
    return rows.select("id", F.col("digest").alias("leaf"), "top.subroot", "top.root", "path", "found")
