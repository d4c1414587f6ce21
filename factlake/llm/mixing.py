"""Mixing sources to target weights by hash-random order and distributed prefix sums.

Every row gets a hash-random key. Within a source, rows lie in key order over ranges of equal
width (keys are uniform, so the ranges are even, whatever the source's size). Sums of the ranges
are summed up along each source; the one range in which a source's budget ends is cut into
ranges again, and at last sorted, and its running sum gives the key at which the budget is met
exactly. Budgets above the source's size take whole epochs first. No task holds more than 256
sums, or one of the 65,536 last ranges, of one source.

Defined results: a null text has size 0; null is a source of its own and comes last; rows
with equal (id, text) share a key and, if the budget ends within them, share what is left in
proportion to size, rounded down; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, plain, text_of, words, written

#: Hexadecimal digits of the key that number a range, level by level: 256 ranges a source, then 256 in the one with the cut.
RANGE_DIGITS = (2, 4)


def mix_key(id_col: str, text_col: str, seed: str) -> Column:
    """Hash-random sort key: 32 hexadecimal digits that depend on the seed, the id and the text."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(plain(id_col).cast("string"), F.lit("")), F.md5(text_of(plain(text_col)).cast("binary"))).cast("binary"))


def _narrow(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    return df.select(
        plain(id_col).alias("doc_id"), plain(source_col).alias("source"),
        F.size(words(plain(text_col))).cast("long").alias("size"), mix_key(id_col, text_col, seed).alias("key"),
    )


def source_targets(narrow: DataFrame, weights: list[float], share: float, max_epochs: int) -> DataFrame:
    """A row per source: source, source_size, target, epochs, rest.

    Targets are share * all sizes, dealt by weight; those above max_epochs times their source
    stop there and the excess is dealt to the others by weight. With sources in order of
    cap / weight the capped ones come first, so running sums over the sources (a row each)
    settle it at once.
    """
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, every = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    ranked = (
        sizes.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
    )
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    leveled = (
        ranked.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("place", F.row_number().over(order))
        .withColumn("free", F.col("cap") > F.col("level") * F.col("weight"))
        .withColumn("at", F.min(F.when(F.col("free"), F.struct("place", "level"))).over(every))
    )
    target = F.when(F.col("free"), F.col("weight") * F.col("at.level")).otherwise(F.col("cap"))
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(F.lit(0)).cast("long")
    return leveled.withColumn("target", target).withColumn("epochs", epochs).select(
        "source", "source_size", "target", "epochs",
        F.greatest(F.floor(F.col("target") - F.col("epochs") * F.col("source_size")), F.lit(0)).cast("long").alias("rest"),
    )


def _cuts(narrow: DataFrame, plan: DataFrame) -> DataFrame:
    """plan and, per source, cut_key: the key in whose rows the rest is used up; cut: what they may give; cut_size: what they have."""
    same_source = F.col("source").eqNullSafe(F.col("l_source"))
    passed = (F.col("upto") > F.col("left")) & (F.col("upto") - F.col("s") <= F.col("left"))
    last = plan.select(F.col("source").alias("l_source"), F.lit("").alias("l_range"), F.col("rest").alias("left"))
    for digits in RANGE_DIGITS:
        inside = narrow.join(last, same_source & F.col("key").startswith(F.col("l_range")))
        ranges = inside.groupBy("source", "left", F.substring("key", 1, digits).alias("range")).agg(F.sum("size").alias("s"))
        summed = ranges.withColumn("upto", F.sum("s").over(Window.partitionBy("source").orderBy("range")))
        last = written(
            summed.where(passed).select(F.col("source").alias("l_source"), F.col("range").alias("l_range"), (F.col("left") - F.col("upto") + F.col("s")).alias("left")), "mixranges"
        )
    inside = narrow.join(last, same_source & F.col("key").startswith(F.col("l_range")))
    keys = inside.groupBy("source", "key", "left").agg(F.sum("size").alias("cut_size")).withColumn("upto", F.sum("cut_size").over(Window.partitionBy("source").orderBy("key")))
    cut = keys.where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("cut_size") <= F.col("left"))).select(
        F.col("source").alias("c_source"), F.col("key").alias("cut_key"), (F.col("left") - F.col("upto") + F.col("cut_size")).alias("cut"), "cut_size",
    )
    return plan.join(cut, F.col("source").eqNullSafe(F.col("c_source")), "left").drop("c_source")


def _planned(df, id_col, text_col, source_col, weights, share, max_epochs, seed) -> tuple[DataFrame, DataFrame]:
    narrow = written(_narrow(df, id_col, text_col, source_col, seed), "mix")
    plan = written(source_targets(narrow, weights, share, max_epochs), "mixplan")
    return narrow, written(_cuts(narrow, plan), "mixcuts")


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: list[float] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: str = "mix") -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken, source, mix_key.

    taken counts words over all epochs; each source's sum is its target rounded down.
    """
    narrow, cuts = _planned(df, id_col, text_col, source_col, list(weights), share, max_epochs, seed)
    c = cuts.withColumnRenamed("source", "c_source")
    part = F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(F.col("key") == F.col("cut_key"), F.floor(F.col("cut") * F.col("size") / F.col("cut_size"))).otherwise(F.lit(0))
    return narrow.join(c, F.col("source").eqNullSafe(F.col("c_source"))).select(
        "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "source", F.col("key").alias("mix_key"),
    )


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: list[float] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: str = "mix") -> DataFrame:
    """The mix itself: df's rows, as often as the mix takes them, with df's columns.

    Texts stay whole: the document in which a budget ends is taken if at least half of it fits.
    Only the small table of cuts is joined; texts are not shuffled.
    """
    _, cuts = _planned(df, id_col, text_col, source_col, list(weights), share, max_epochs, seed)
    names = {n: fresh(df, f"mix_{n}") for n in ("source", "epochs", "cut_key", "half", "key", "copy")}
    c = cuts.select(*[x.alias(names[n]) for n, x in (("source", F.col("source")), ("epochs", F.col("epochs")), ("cut_key", F.col("cut_key")), ("half", F.col("cut") * 2 >= F.col("cut_size")))])
    key, cut_key = F.col(names["key"]), F.col(names["cut_key"])
    copies = F.col(names["epochs"]) + F.when((key < cut_key) | (key == cut_key) & F.col(names["half"]), 1).otherwise(0)
    return (
        df.withColumn(names["key"], mix_key(id_col, text_col, seed))
        .join(c, plain(source_col).eqNullSafe(F.col(names["source"])))
        .where(copies > 0)
        .withColumn(names["copy"], F.explode(F.sequence(F.lit(1).cast("long"), copies.cast("long"))))
        .select(*[plain(x) for x in df.columns])
    )
