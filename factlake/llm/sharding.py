"""K-d tree partitioning of documents into shards of nearly equal bytes, by DataFrame operations only.

A node is split at the weighted median along its widest metadata dimension (its range of
values against the whole table's) until every leaf holds one shard's bytes. Strings are measured
by their rank among the distinct values. Medians are exact and distributed: at each level all
nodes' units are range-partitioned by node and coordinate at once, the ranges' sums are summed up
along each node, and a running sum inside each range says on which side of the median a unit
lies. Nothing is collected on the driver, so the number of shards is free.

Rows with equal texts are a unit with one place in metadata space and a hash that breaks ties,
so they share a shard. Only units larger than a whole shard have pieces by row (of `piece_share`
of a shard), as equal bytes would be impossible otherwise; pieces are neighbours in the order.
Among equal coordinates small units come last, so that a median among them is nearly even.
A side gets at least as many units as shards, if the node has them.

Defined results: a null text has no bytes and counts 1; a null or non-numeric dimension value
lies at 0; a null string is an empty one; repeated rows are rows of their own; an empty table gives
an empty result; shards may be empty if there are fewer units than shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free, live, plain, sided, text_of, written

#: Units below this share of a shard come after larger ones of the same coordinate.
SMALL_UNIT = 0.001
#: Rows that share one bucket when slots are numbered.
SLOT_ROWS = 20_000
_UNIT = ("h", "size", "piece")


def metadata_value(df: DataFrame, name: str) -> Column:
    """A dimension's value: strings as they are, all else as a number."""
    kind, c = dict(df.dtypes)[name], plain(name)
    if kind == "string":
        return F.coalesce(c, F.lit(""))
    if kind in ("date", "timestamp", "timestamp_ntz"):
        c = F.unix_timestamp(c.cast("timestamp"))
    elif kind.startswith(("array", "map", "struct", "binary")):
        c = F.lit(0)
    value = c.cast("double")
    return F.coalesce(F.when(F.isnan(value), F.lit(0.0)).otherwise(value), F.lit(0.0))


def _in_ranges(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df written with a column part that numbers ranges of the keys in order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *keys).withColumn("part", F.spark_partition_id()), name)


def ranks(values: DataFrame) -> DataFrame:
    """v, rank (from 0, double) of the distinct values of a column v, in order."""
    parts = _in_ranges(values.select("v").distinct(), ["v"], "ranks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row per range
    first = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    here = F.row_number().over(Window.partitionBy("part").orderBy("v")) - 1
    return parts.withColumn("here", here).join(F.broadcast(first), "part").select("v", (F.col("first") + F.col("here")).cast("double").alias("rank"))


def _split(cells: DataFrame, extent: list[float]) -> DataFrame:
    """cells (units, bytes, small, dims, node, k): nodes that hold k > 1 shards are split in two; a node is numbered by its first shard."""
    spans = F.array(*[(F.max(F.col("dims")[i]) - F.min(F.col("dims")[i])) / (e or 1.0) for i, e in enumerate(extent)])
    # a row per node: at most one per shard
    nodes = written(cells.where("k > 1").groupBy("node").agg(spans.alias("spans"), F.sum("bytes").alias("node_bytes"), F.count(F.lit(1)).alias("node_n")).select("node", (F.array_position("spans", F.array_max("spans")) - 1).cast("int").alias("dim"), "node_bytes", "node_n"), "nodes")
    placed = cells.join(sided(nodes, 64), "node", "left").withColumn("c", F.coalesce(F.get("dims", F.col("dim")), F.lit(0.0)))
    order = ["c", "small", *_UNIT]
    ordered = _in_ranges(placed, ["node", *order], "ordered")
    before = Window.partitionBy("node").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # at most a row per node and one per range
    sums = ordered.groupBy("node", "part").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).select("node", "part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("first_b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_n"))
    inside = Window.partitionBy("node", "part").orderBy(*order)
    run = ordered.withColumn("run_b", F.sum("bytes").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("run_n", F.row_number().over(inside))
    half = F.floor(F.col("k") / 2).cast("int")
    middle, i = F.col("first_b") + F.col("run_b") - F.col("bytes") / 2, F.col("first_n") + F.col("run_n")
    left = (i <= half) | ((middle < F.col("node_bytes") * half / F.col("k")) & (i <= F.col("node_n") - (F.col("k") - half)))
    right = (F.col("k") > 1) & ~left
    return run.join(sided(written(sums, "sums"), 64), ["node", "part"]).select(
        *_UNIT, "bytes", "small", "dims", (F.col("node") + F.when(right, half).otherwise(0)).alias("node"), F.when(right, F.col("k") - half).when(F.col("k") > 1, half).otherwise(F.col("k")).alias("k")
    )


def _numbered(spark: SparkSession, rows: DataFrame, count: int) -> DataFrame:
    """rows with slot: 0, 1, 2, ... in each shard, numbered bucket by bucket."""
    buckets = max(1, -(-count // SLOT_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("r", F.lit(11)), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    here = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("r")) - 1
    return rows.withColumn("here", here).join(first, ["shard", "bucket"]).withColumn("slot", F.col("first") + F.col("here"))


def kd_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims: list[str] = ("source", "lang"), n_shards: int | None = None, target_bytes: int | None = None, piece_share: float = 0.02) -> DataFrame:
    """A row per document: doc_id, size, text_crc32, shard, slot. Give n_shards or target_bytes.

    The size is a dimension too (its logarithm), after those named.
    """
    spark = df.sparkSession
    text = text_of(plain(text_col))
    size = (F.octet_length(text) + 1).cast("long")
    own = F.struct(*[metadata_value(df, d).alias(f"d{i}") for i, d in enumerate(dims)], F.log2(size.cast("double")).alias(f"d{len(dims)}"))
    rows = written(
        df.select(plain(id_col).alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), own.alias("own"), F.monotonically_increasing_id().alias("r")), "shardrows"
    )
    total = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    shards = n_shards or max(1, -(-(total.bytes or 0) // target_bytes))
    shard_bytes = max(1.0, (total.bytes or 0) / shards)
    units = written(rows.groupBy("h", "size").agg(F.sum("size").alias("bytes"), F.min("own").alias("own")), "shardtexts")
    # fewer rows than shards
    large = written(units.where(F.col("bytes") > F.lit(shard_bytes)).select("h", "size", F.ceil(F.col("bytes") / F.lit(shard_bytes * piece_share)).alias("pieces"), F.col("own").alias("unit_own")), "largetexts")
    piece = F.coalesce(F.pmod(F.xxhash64("r"), F.col("pieces")), F.lit(0)).cast("long")
    pieced = rows.join(sided(large, 256), ["h", "size"], "left").withColumn("piece", piece)
    cells = units.join(sided(large.select("h", "size"), 64), ["h", "size"], "left_anti").select("h", "size", F.lit(0).cast("long").alias("piece"), "bytes", "own").unionByName(
        pieced.where("pieces is not null").groupBy("h", "size", "piece").agg(F.sum("size").alias("bytes"), F.min("unit_own").alias("own"))
    )
    cells = written(cells.select(*_UNIT, "bytes", (F.col("bytes") < F.lit(SMALL_UNIT * shard_bytes)).alias("small"), "own"), "units")
    values = []
    for i, name in enumerate([*dims, None]):
        if name and dict(df.dtypes)[name] == "string":
            ranked = written(ranks(cells.select(F.col(f"own.d{i}").alias("v"))).select(F.col("v").alias(f"v{i}"), F.col("rank").alias(f"rank{i}")), "rank")
            cells = cells.join(sided(ranked, F.octet_length(f"v{i}") + 32), F.col(f"own.d{i}") == F.col(f"v{i}"))
            values.append(F.col(f"rank{i}"))
        else:
            values.append(F.col(f"own.d{i}"))
    cells = written(cells.select(*_UNIT, "bytes", "small", F.array(*values).alias("dims"), F.lit(0).alias("node"), F.lit(shards).alias("k")), "cells")
    ends = cells.agg(*[(F.max(F.col("dims")[i]) - F.min(F.col("dims")[i])).alias(f"e{i}") for i in range(len(values))]).first()
    kept = live()
    for _ in range((shards - 1).bit_length()):
        cells = written(_split(cells, list(ends)), "cells")
        made = [p for p in live() if p not in kept]
        free(spark, made[:-1])  # only the last level is read again
    shard_of = cells.select(*_UNIT, F.col("node").alias("shard"))
    return _numbered(spark, pieced.select("doc_id", "text_crc32", "r", *_UNIT).join(shard_of, list(_UNIT)), total.n).select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
