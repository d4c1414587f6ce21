"""Intervals and restatements that batches of facts keep up to date, in whatever order knowledge arrives.

Only keys of the batch are opened again. An interval needs its key's winners of each day, so a late
version closes the one before it and ends where the next begins; a restatement needs only a key's first and last
version, each the lesser or greater of what is stored and what comes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as X
from ..schemas import FACT_KEY, VERSION_ORDER
from ..sources.buckets import BUCKETS, merge_buckets, read_buckets
from .asof import with_validity


def merged_validity(rows: DataFrame, key: list[str] = FACT_KEY) -> DataFrame:
    """with_validity of all facts, from that of earlier ones and new ones (rows: both); repeated facts change nothing."""
    return with_validity(rows.drop("valid_from", "valid_to").distinct(), key)


def validity_schema(facts: DataFrame) -> T.StructType:
    known = facts.schema[VERSION_ORDER[0]].dataType
    return T.StructType([*[T.StructField(f.name, f.dataType) for f in facts.schema], T.StructField("valid_from", known), T.StructField("valid_to", known)])


def merge_validity(batch: DataFrame, path: str, key: list[str] = FACT_KEY, merge_id: str | None = None, buckets: int = BUCKETS, landed: bool = False) -> int:
    """Brings a table of intervals up to date; the number of buckets rewritten. landed: the batch is read from files."""
    return merge_buckets(batch, path, key, validity_schema(batch), lambda new: new, merged_validity, merge_id, buckets, (VERSION_ORDER[2],), landed)


def read_validity(spark: SparkSession, path: str, facts_schema: DataFrame) -> DataFrame:
    """The table of intervals; facts_schema: a frame with the facts' columns."""
    return read_buckets(spark, path, validity_schema(facts_schema))


def version_ends(facts: DataFrame, key: list[str] = FACT_KEY) -> DataFrame:
    """Per key the first and the last version, as structs that compare in the versions' order."""
    version = F.struct(*VERSION_ORDER, *[c for c in facts.columns if c not in (*VERSION_ORDER, *key)])
    return facts.groupBy(*key).agg(F.min(version).alias("original"), F.max(version).alias("revised"))


def _single_ends(facts: DataFrame, key: list[str]) -> DataFrame:
    """Facts in the shape of version_ends, each by itself; the last version is left out, as it is the first."""
    names = version_ends(facts, key).schema["original"].dataType.names
    return facts.select(*key, F.struct(*names).alias("original"))


def merged_ends(rows: DataFrame, key: list[str] = FACT_KEY) -> DataFrame:
    """First and last versions, from those of earlier facts and single facts (rows: both)."""
    return rows.groupBy(*key).agg(F.min("original").alias("original"), F.max(F.coalesce("revised", "original")).alias("revised"))


def merge_ends(batch: DataFrame, path: str, key: list[str] = FACT_KEY, merge_id: str | None = None, buckets: int = BUCKETS, landed: bool = False) -> int:
    """Brings a table of first and last versions up to date; the number of buckets rewritten. landed: the batch is read from files."""
    return merge_buckets(batch, path, key, version_ends(batch, key).schema, lambda new: _single_ends(new, key), merged_ends, merge_id, buckets, tuple(f"{end}.{VERSION_ORDER[2]}" for end in ("original", "revised")), landed)


def read_restatements(spark: SparkSession, path: str, facts_schema: DataFrame, key: list[str] = FACT_KEY, min_abs_pct: float | None = None) -> DataFrame:
    """Restatements from a table of first and last versions: key, original, revised, delta, delta_pct. No shuffle."""
    ends = read_buckets(spark, path, version_ends(facts_schema, key).schema)
    o, r = F.col("original.value"), F.col("revised.value")
    out = ends.where(o != r)
    if min_abs_pct is not None:
        out = out.where(X.at_least_pct(o, r, min_abs_pct))
    return out.withColumns({"delta": X.delta(o, r), "delta_pct": X.delta_pct(o, r)})
