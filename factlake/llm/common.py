"""Helpers that several operators share: words, ASCII case, row keys and written intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import fresh
from ..sources.scratch import BROADCAST_BYTES, free, live, shared_dir, sided, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    """Words of a text in order, between white space (U+0020 and U+0009 to U+000D); null and blank texts have none."""
    text = text_of(text)
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z and nothing else.

    lower() is several times faster than translate() and does the same unless the text
    holds an upper-case letter outside ASCII, so translate() takes those texts only.
    """
    same = (F.octet_length(text) == F.char_length(text)) | ~text.rlike("[\\p{IsUppercase}\\p{Lt}&&[^A-Z]]")
    return F.when(same, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def plain(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits in hexadecimal, equal for equal (id, text); rows that agree in both are the same document."""
    i, t = plain(id_col).cast("string"), plain(text_col)
    return F.md5(F.concat(F.coalesce(F.char_length(i), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(i, F.lit("")), F.when(t.isNull(), "-").otherwise("+"), F.coalesce(t, F.lit(""))).cast("binary"))


__all__ = ["BROADCAST_BYTES", "ascii_lower", "free", "fresh", "kth_largest", "live", "plain", "row_key", "shared_dir", "sided", "table", "text_of", "words", "written"]

def kth_largest(values: DataFrame, k: int, bins: int = 1024) -> float:
    """The k-th largest of a column v; histograms narrow the range until its few values can be read."""
    ends = values.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("n")).first()
    if not ends.n or k <= 0:
        return float("inf")
    k, low, high, count = min(k, ends.n), ends.low, ends.high, ends.n
    while count > 2000 and high > low:
        width = (high - low) / bins
        inside = values.where((F.col("v") >= low) & (F.col("v") <= high))
        at = F.least(F.floor((F.col("v") - low) / F.lit(width)), F.lit(bins - 1))
        found = sorted(inside.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect(), reverse=True)
        for b in found:
            if k <= b.n:
                break
            k -= b.n
        low, high, count = b.low, b.high, b.n
    return values.where((F.col("v") >= low) & (F.col("v") <= high)).orderBy(F.col("v").desc()).limit(k).agg(F.min("v")).first()[0] if high > low else high
