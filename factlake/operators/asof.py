"""Point-in-time reads for all keys at once. A knowledge cutoff includes its own day."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.expr import fresh
from ..schemas import FACT_KEY, VERSION_ORDER, VIEW_COLUMNS
from ..sources.scratch import sided, written


def fact_view(facts: DataFrame) -> DataFrame:
    return facts.select(*VIEW_COLUMNS)


def fact_key_filter(facts: DataFrame, cod_cvm: int, cd_conta: str, period_end: date | None = None, statement: str = "DRE", consolidated: bool = True, coluna_df: str = "") -> DataFrame:
    """Facts of one logical key (of every period, if none is given)."""
    out = facts.where((F.col("cod_cvm") == cod_cvm) & (F.col("statement") == statement) & (F.col("consolidated") == consolidated) & (F.col("cd_conta") == cd_conta) & (F.col("coluna_df") == coluna_df))
    return out if period_end is None else out.where(F.col("period_end") == F.lit(period_end))


def known_as_of(facts: DataFrame, day: date | Column) -> DataFrame:
    return facts.where(F.col("knowledge_date") <= (day if isinstance(day, Column) else F.lit(day)))


def _latest_first() -> list[Column]:
    known, version, fact = VERSION_ORDER
    return [F.col(known).desc(), F.col(version).desc(), F.col(fact).asc()]


def as_of(facts: DataFrame, day: date | Column, key: list[str] = FACT_KEY) -> DataFrame:
    """Per key the value known at the day: latest knowledge, then highest version, then lowest id."""
    w = Window.partitionBy(*key).orderBy(*_latest_first())
    n = fresh(facts, "n")
    return known_as_of(facts, day).withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n)


def latest(facts: DataFrame, today: date | None = None, key: list[str] = FACT_KEY) -> DataFrame:
    return as_of(facts, F.current_date() if today is None else today, key)


def history(facts: DataFrame, key: list[str] = FACT_KEY) -> DataFrame:
    """Every version of every key with its ordinal, oldest first; full ties by id."""
    return facts.withColumn("version_no", F.row_number().over(Window.partitionBy(*key).orderBy(*VERSION_ORDER)))


def version_deltas(facts: DataFrame, key: list[str] = FACT_KEY) -> DataFrame:
    """Every version with the value before it and the step."""
    before = F.lag("value").over(Window.partitionBy(*key).orderBy(*VERSION_ORDER))
    return facts.withColumn("previous_value", before).withColumn("step", X.delta(F.col("previous_value"), F.col("value")))


def _spans(facts: DataFrame, key: list[str], since: str, until: str) -> DataFrame:
    """The day's winner per key and day, with the days it holds from and to (exclusive). One shuffle and one sort serve both windows.

    A fact without a day of knowledge holds at none and is left out.
    """
    known = VERSION_ORDER[0]
    facts = facts.where(F.col(known).isNotNull())
    by_key = Window.partitionBy(*key)
    before = fresh(facts, "before")
    marked = facts.withColumn(before, F.lag(known).over(by_key.orderBy(F.col(known).asc(), *_latest_first()[1:])))
    winners = marked.where(F.col(before).isNull() | (F.col(before) != F.col(known))).drop(before)
    return winners.withColumn(since, F.col(known)).withColumn(until, F.lead(known).over(by_key.orderBy(known)))


def with_validity(facts: DataFrame, key: list[str] = FACT_KEY) -> DataFrame:
    """One version per key and day, with valid_from and valid_to (exclusive; null while it holds): as-of becomes a range filter."""
    return _spans(facts, key, "valid_from", "valid_to")


def valid_at(intervals: DataFrame, day: date | Column) -> DataFrame:
    """as_of over a table of intervals: a filter, no shuffle."""
    at = day if isinstance(day, Column) else F.lit(day)
    return intervals.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))).drop("valid_from", "valid_to")


#: Rows of one key that a task merges; keys of more are dealt over tasks by time.
ROWS_PER_TASK = 1_000_000


def _named(taken: list[str], *wanted: str) -> list[str]:
    """Names that are not taken, one for each wanted."""
    taken, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def asof_join(probes: DataFrame, facts: DataFrame, key: list[str] = FACT_KEY, at: str = "as_of", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Each probe (key columns, at, and others) with `fact`: the fact known then, or null (fact_, if probes have a column fact).

    Probes and facts are merged by key and time and the last fact before each probe is carried
    on, so versions times probes never meet as pairs. Where a key has more than rows_per_task rows,
    the merge is by ranges of (key, time): each range is merged by itself, and the last fact of all ranges before it
    is carried over its border by a table of one row per range, so a key is dealt over as many tasks
    as its rows need. Equal probes stay separate rows; a null in a key or a day matches nothing.
    """
    known, version, fact_id = VERSION_ORDER
    others = [c for c in probes.columns if c not in (*key, at)]
    when, side, other, fact, ver, ident, part = _named(key, "at", "side", "other", "fact", "version", "ident", "part")
    values = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]) if others else F.lit(True)
    left = probes.select(*key, F.col(at).alias(when), F.lit(1).alias(side), values.alias(other))
    right = facts.dropna(subset=[*key, known]).select(*key, F.col(known).cast(probes.schema[at].dataType).alias(when), F.lit(0).alias(side), F.struct(*facts.columns).alias(fact), F.col(version).alias(ver), F.col(fact_id).alias(ident))
    merged = left.unionByName(right, allowMissingColumns=True)
    order = [F.col(when), F.col(side), F.col(ver), F.col(ident).desc()]
    here = lambda w: F.last(fact, ignorenulls=True).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    if (merged.groupBy(*key).count().agg(F.max("count")).first()[0] or 0) <= rows_per_task:
        carried = merged.withColumn(fact, here(Window.partitionBy(*key))).where(F.col(side) == 1)
    else:
        # of a key's facts of one time only the last can be the one known: the others go before the shuffle, which of hot keys are most
        (nth,) = _named(right.columns, "nth")
        one = Window.partitionBy(*key, when).orderBy(F.col(ver).desc(), F.col(ident).asc())
        merged = left.unionByName(right.withColumn(nth, F.row_number().over(one)).where(F.col(nth) == 1).drop(nth), allowMissingColumns=True)
        carried = _merged_by_ranges(merged, key, part, side, fact, order, here)
    (out,) = _named(probes.columns, "fact")
    return carried.select(*key, F.col(when).alias(at), *[F.col(f"{other}.c{i}").alias(c) for i, c in enumerate(others)], F.col(fact).alias(out))


def _merged_by_ranges(merged: DataFrame, key: list[str], part: str, side: str, fact: str, order: list[Column], here: Callable[[WindowSpec], Column]) -> DataFrame:
    """The probes of merged with their facts, by ranges of (key, order)."""
    spark, n = merged.sparkSession, int(merged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(merged.repartitionByRange(n, *key, *order).withColumn(part, F.spark_partition_id()), "asof")
    found, top, of_key = _named([*merged.columns, part], "found", "top", "of_key")
    when, _, ver, ident = order
    # the last fact of each range: the rest of a range is dropped before any shuffle
    last = Window.partitionBy(part).orderBy(*[F.col(k).desc() for k in key], when.desc(), F.col(merged.columns[-2]).desc(), F.col(merged.columns[-1]).asc())
    tops = ranged.where(F.col(side) == 0).withColumn(top, F.row_number().over(last)).where(F.col(top) == 1).select(part, F.struct(F.struct(*key).alias(of_key), fact).alias(top))
    # a row per range
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    borders = written(spark.range(n).select(F.col("id").cast("int").alias(part)).join(tops, part, "left").withColumn(top, F.last(top, ignorenulls=True).over(before)), "borders")
    inside = ranged.withColumn(found, here(Window.partitionBy(part, *key))).where(F.col(side) == 1).drop(fact)
    same_key = F.col(f"{top}.{of_key}") == F.struct(*key)
    return inside.join(sided(borders, F.octet_length(F.to_json(top)) * 2 + 64), part).withColumn(fact, F.coalesce(found, F.when(same_key, F.col(f"{top}.{fact}"))))


def _days_before(days: Column, n: int, c: Column) -> Column:
    """How many of n sorted days are before c, by binary search."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= n) & (F.get(days, low + step - 1) < c), low + step).otherwise(low))


def as_of_panel(facts: DataFrame, days: list[date], key: list[str] = FACT_KEY) -> DataFrame:
    """Each key's known value at each of the days (rows only where something is known).

    A version's days are those of the sorted list within its interval, found by binary search in
    the row; keys times days are never built. Repeated days count once; no days, no rows.
    """
    days = sorted(set(days))
    since, until, grid = _named(facts.columns, "since", "until", "days")
    if not days:
        return facts.limit(0).select(F.lit(None).cast("date").alias("as_of"), *facts.columns)
    spans = _spans(known_as_of(facts, days[-1]), key, since, until).withColumn(grid, F.lit(days))
    low, high = (_days_before(F.col(grid), len(days), F.col(c)) for c in (since, until))
    held = F.slice(F.col(grid), low + 1, F.when(F.col(until).isNull(), len(days)).otherwise(high) - low)
    return spans.select(F.explode(held).alias("as_of"), *facts.columns)


def as_of_diff(facts: DataFrame, early: date, late: date, key: list[str] = FACT_KEY) -> DataFrame:
    """Keys whose value differs between two as-of days: early_value, late_value."""
    a = as_of(facts, early, key).select(*key, F.col("value").alias("early_value"))
    b = as_of(facts, late, key).select(*key, F.col("value").alias("late_value"))
    return a.join(b, key, "full").where(~F.col("early_value").eqNullSafe(F.col("late_value")))
