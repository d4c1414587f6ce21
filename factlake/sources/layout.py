"""Facts laid out so that a read of one key, or of some days, opens few files.

Rows are ordered by interleaved bits of two coordinates: 16 bits of a hash of the key, and 16 bits of the day of knowledge
between fixed ends. A file of such an order covers a small box in both, and a table of one
row per file tells its box, so a read names the files it needs before it opens any.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import fresh
from ..schemas import VERSION_ORDER
from .sinks import read_table

BOXES = "_boxes"
_BOX = "file string, low_key int, high_key int, low_day date, high_day date, rows long"
BITS = 16
#: Days outside lie in the first or last place; any table's days are told apart as well as 44 a place allow at worst.
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2100, 1, 1)
ROWS_PER_FILE = 1_000_000
#: A task writes so many rows, in as many files as they need: tasks, and what they tell the driver, do not grow with small files.
ROWS_PER_TASK = 1_000_000


def key_place(columns: list[Column]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << BITS)).cast("int")


def day_place(day: Column, first: date, last: date) -> Column:
    """A day's place among 2^16 from first to last."""
    days = max(1, (last - first).days)
    return F.greatest(F.lit(0), F.least(F.lit((1 << BITS) - 1), (F.datediff(day, F.lit(first)).cast("long") * ((1 << BITS) - 1) / days).cast("int")))


def interleaved(x: Column, y: Column) -> Column:
    """The bits of two places in turn, those of x first."""
    bit = lambda c, i: F.shiftright(c, i).bitwiseAND(F.lit(1)).cast("long")
    parts = [F.shiftleft(bit(c, i), 2 * i + of) for i in range(BITS) for c, of in ((x, 1), (y, 0))]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def lay_out(facts: DataFrame, path: str, key: list[str], known: str = VERSION_ORDER[0], rows_per_file: int = ROWS_PER_FILE) -> int:
    """Appends facts in that order, and the new files' boxes; the number of files written. Null days lie in the first place and are in no box.

    One writer at a time. Files of an append that was cut off before its boxes were written are
    opened by every read, so nothing is lost.
    """
    spark = facts.sparkSession
    ends = facts.agg(F.min(known), F.max(known), F.count(F.lit(1))).first()
    if not ends[2]:
        return 0
    before = set(read_table(spark, path, facts.schema).inputFiles())
    order, tie = fresh(facts, "place"), [c for c in VERSION_ORDER if c in facts.columns]
    first, last = (ends[0] or FIRST_DAY, ends[1] or LAST_DAY)
    placed = facts.withColumn(order, interleaved(key_place([F.col(c) for c in key]), F.coalesce(day_place(F.col(known).cast("date"), first, last), F.lit(0))))
    n = min(-(-ends[2] // rows_per_file), max(-(-ends[2] // ROWS_PER_TASK), spark.sparkContext.defaultParallelism))
    placed.repartitionByRange(n, order, *tie).sortWithinPartitions(order, *tie).drop(order).write.option("maxRecordsPerFile", rows_per_file).mode("append").parquet(path)
    table = spark.read.schema(facts.schema).parquet(path)
    new = sorted(set(table.inputFiles()) - before)
    # a list of files is listed by tasks, a folder is not
    rows = (spark.read.schema(facts.schema).parquet(*new) if before else table).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), key_place([F.col(c) for c in key]).alias("k"), F.col(known).cast("date").alias("d"))
    boxes = rows.groupBy("file").agg(F.min("k").alias("low_key"), F.max("k").alias("high_key"), F.min(F.coalesce("d", F.lit(FIRST_DAY))).alias("low_day"), F.max(F.coalesce("d", F.lit(LAST_DAY))).alias("high_day"), F.count(F.lit(1)).alias("rows"))
    boxes.coalesce(1).write.mode("append").parquet(f"{path}/{BOXES}")
    return len(new)


def files_for(spark: SparkSession, path: str, schema, key: dict | None = None, since: date | None = None, until: date | None = None) -> list[str]:
    """Files that may hold rows of the key (values of all columns it was laid out by, in their order) known from since to until, both included."""
    every = read_table(spark, path, schema).inputFiles()
    boxes = read_table(spark, f"{path}/{BOXES}", _BOX)
    fits = F.lit(True)
    if key is not None:
        types = {f.name: f.dataType for f in schema}
        place = key_place([F.lit(v).cast(types[c]) for c, v in key.items()])
        fits = fits & F.col("low_key").__le__(place) & F.col("high_key").__ge__(place)
    fits = fits & (F.col("high_day") >= F.lit(since) if since else F.lit(True)) & (F.col("low_day") <= F.lit(until) if until else F.lit(True))
    boxes = boxes.select("file", fits.alias("fits"))
    name = lambda f: f.rsplit("/", 1)[-1]
    if boxes.count() == len(every):
        told = {r.file for r in boxes.where("fits").collect()}  # a row per file that is read
        return sorted(f for f in every if name(f) in told)
    told = {r.file: r.fits for r in boxes.collect()}  # a row per file
    return sorted(f for f in every if told.get(name(f), True))


def read_laid_out(spark: SparkSession, path: str, schema, key: dict | None = None, since: date | None = None, until: date | None = None, known: str = VERSION_ORDER[0]) -> DataFrame:
    """Rows of the key known from since to until; no other condition stands for none. A null in the key matches nothing."""
    files = files_for(spark, path, schema, key, since, until)
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    for c, v in (key or {}).items():
        rows = rows.where(F.col(c) == F.lit(v))
    if since:
        rows = rows.where(F.col(known) >= F.lit(since))
    return rows.where(F.col(known) <= F.lit(until)) if until else rows
