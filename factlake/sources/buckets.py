"""Tables that batches keep up to date: rows of a key live in a bucket, and a merge rewrites only the buckets of its batch's keys.

A bucket's rows lie in a folder of their own for each generation, and a log tells the present
generation of every bucket. A merge writes the new generations of its buckets first and the log last, so readers
see the table before or after a merge, and one that is cut off leaves nothing but folders that no
log names; running it again gives the same table. One writer at a time; readers need no lock.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.expr import fresh
from .scratch import COMPRESSION, free, live, written
from .sinks import batch_identity, read_table

BUCKET, GENERATION = "bucket", "generation"
#: Buckets of a new table; a table keeps its number.
BUCKETS = 64
_LOG = f"{BUCKET} int, {GENERATION} int, merge_id string, buckets int"


def bucket_of(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _present(spark: SparkSession, path: str) -> tuple[dict[int, int], int, set[str]]:
    """Per bucket its present generation; the table's number of buckets (0: none yet); the merges that are done."""
    # a row per bucket and merge
    log = read_table(spark, f"{path}/_log", _LOG)
    latest = {r[0]: r[1] for r in log.groupBy(BUCKET).agg(F.max(GENERATION)).collect()}
    facts = log.agg(F.max("buckets"), F.collect_set("merge_id")).first()
    return {b: g for b, g in latest.items() if b >= 0}, facts[0] or 0, set(facts[1])


def _folder(path: str, bucket: int, generation: int) -> str:
    return f"{path}/{GENERATION}={generation}/{BUCKET}={bucket}"


def _read(spark: SparkSession, path: str, schema, present: dict[int, int]) -> DataFrame:
    if not present:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[_folder(path, b, g) for b, g in sorted(present.items())])


def read_buckets(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table's present rows."""
    return _read(spark, path, schema, _present(spark, path)[0])


def _recoded(df: DataFrame, names: tuple[str, ...], code: Callable[[Column], Column]) -> DataFrame:
    """df with code of the named columns, or fields of structs (struct.field)."""
    for name in names:
        top, _, field = name.partition(".")
        df = df.withColumn(top, F.col(top).withField(field, code(F.col(name))) if field else code(F.col(top)))
    return df


def merge_buckets(batch: DataFrame, path: str, key: list[str], schema, stored_form: Callable[[DataFrame], DataFrame], merged: Callable[[DataFrame, list[str]], DataFrame], merge_id: str | None = None, buckets: int = BUCKETS, packed: tuple[str, ...] = (), landed: bool = False) -> int:
    """Merges batch into the buckets of its keys; the number of buckets rewritten.

    stored_form turns the batch into rows that can be united with stored ones; merged(rows, key) makes
    the new rows of each key from both. It must leave a key's stored rows as they are when nothing is added to them or when
    what is added is in them already. Stored rows and batch are shuffled once, by bucket and a piece of it, and written as they then lie.

    merge_id: a merge that is in the log by this name is done already and changes nothing. Without one
    a batch is known by its rows, as in the ingest. packed names columns (or struct.field) of hexadecimal text that are shuffled in half their length.
    landed: the batch is read from files, so that reading it again costs less than writing it.
    Rows of a null key are kept like others.
    """
    spark, mine = batch.sparkSession, live()
    present, known, done = _present(spark, path)
    buckets = known or buckets
    if merge_id is not None and merge_id in done:
        return 0
    batch = batch if landed else written(batch, "merge-batch")
    if merge_id is None:
        merge_id = batch_identity(batch)
        if merge_id in done:
            free(spark, [p for p in live() if p not in mine])
            return 0
    place = bucket_of(key, buckets)
    touched = sorted(r[0] for r in batch.select(place.alias("b")).distinct().collect())  # at most one per bucket
    stored = _read(spark, path, schema, {b: g for b, g in present.items() if b in touched})
    if BUCKET in stored.columns:
        raise ValueError(f"a table of buckets has no column named {BUCKET}")
    both = stored.unionByName(stored_form(batch), allowMissingColumns=True)
    names = stored.columns
    piece = fresh(both, "piece")
    pieces = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // buckets))
    dealt = both.withColumns({BUCKET: place, piece: F.pmod(F.xxhash64(*key, F.lit(1)), F.lit(pieces)).cast("int")}).transform(_recoded, packed, X.packed).repartition(BUCKET, piece)
    rows = merged(_recoded(dealt, packed, X.unpacked), [BUCKET, piece, *key]).select(*names, BUCKET)
    generation = max(present.values(), default=0) + 1
    rows.write.mode("overwrite").option("compression", COMPRESSION).partitionBy(BUCKET).parquet(f"{path}/{GENERATION}={generation}")
    filled = {r[0] for r in spark.read.parquet(f"{path}/{GENERATION}={generation}").select(BUCKET).distinct().collect()} if touched else set()
    entries = [(b, generation, merge_id, buckets) for b in touched if b in filled] or [(-1, generation, merge_id, buckets)]
    spark.createDataFrame(entries, _LOG).coalesce(1).write.mode("append").parquet(f"{path}/_log")
    free(spark, [p for p in live() if p not in mine])
    return len(filled)
