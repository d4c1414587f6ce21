"""Audit of how filters interact: for every order of the filters, what each removes and what it would have shared with others.

Spark reduces the rows to cells: per part, one count for each of the 2^k patterns of failed filters,
with the counts of good and of toxic documents among them. The cells of a part are reshaped to a
2 x 2 x ... x 2 tensor, one axis a filter (0 passes, 1 fails), and every figure of every order and step is a
contraction of that tensor with, along each axis, the vector that selects pass, fail or all.
The tensors are of fixed size whatever the number of documents; parts are dealt over tasks.

Equal texts are found by a digest: each distinct text's smallest id meets, by a join of digests,
only texts that occur more than once, after counting within (digest, part, pattern), so a text that
a third of all documents share is a few rows.

Defined results: a null text is empty, a null part the empty string; a null id is never smaller
than another and has none that is smaller; of several labels of an id, any that says so counts;
rows with the same id and text are no copies of each other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain, text_of, words, written

#: Measures of a cell.
COUNTS = ["n", "good", "toxic"]
#: Parts whose tensors are contracted at once; bounds a task's memory.
PARTS_AT_ONCE = 64
_PASS, _FAIL, _ALL = (1, 0), (0, 1), (1, 1)


def text_filters(text: Column, found: Column) -> dict[str, Column]:
    """Whether a text, of which the words are found, fails: A short, B repetitive, C in capitals, D with symbols."""
    return {
        "A": F.size(found) < 200,
        "B": 100 * F.size(F.array_distinct(found)) < 50 * F.size(found),
        "C": 100 * F.char_length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _steps(k: int) -> tuple[list[tuple[int, ...]], dict[str, np.ndarray]]:
    """All orders of k filters, and per figure the selecting vectors: (order, step, axis, 2)."""
    orders = list(permutations(range(k)))
    out = {name: np.empty((len(orders), k, k, 2), dtype=np.int64) for name in ("kept", "removed", "failing", "unique")}
    for o, order in enumerate(orders):
        for step, own in enumerate(order):
            before = order[:step]
            for axis in range(k):
                mine, earlier = axis == own, axis in before
                out["kept"][o, step, axis] = _PASS if mine or earlier else _ALL
                out["removed"][o, step, axis] = _FAIL if mine else _PASS if earlier else _ALL
                out["failing"][o, step, axis] = _FAIL if mine else _ALL
                out["unique"][o, step, axis] = _FAIL if mine else _PASS
    return orders, out


def contract(tensors: np.ndarray, select: np.ndarray) -> np.ndarray:
    """(part, 2, ..., 2) tensors with (order, step, axis, 2) selections: (part, order, step) exact counts."""
    k = select.shape[2]
    axes = list(range(3, 3 + k))
    operands = [tensors, [0, *axes]]
    for i, axis in enumerate(axes):
        operands += [select[:, :, i], [1, 2, axis]]
    return np.einsum(*operands, [0, 1, 2], optimize=True)


def audit_tensors(tensors: np.ndarray, names: str) -> dict[str, np.ndarray]:
    """tensors: (part, measure, 2, ..., 2). The columns of the report, each (part, order, step)."""
    orders, select = _steps(len(names))
    all_docs, good, toxic = tensors[:, 0], tensors[:, 1], tensors[:, 2]
    removed = contract(all_docs, select["removed"])
    own = np.array(orders)  # the filter of (order, step)
    total = np.stack([removed[:, own == f].sum(axis=1) for f in range(len(names))], axis=1)
    return {
        "kept": contract(all_docs, select["kept"]), "removed": removed, "redundant": contract(all_docs, select["failing"]) - removed, "unique_fails": contract(all_docs, select["unique"]),
        "good_lost": contract(good, select["removed"]), "toxic_lost": contract(toxic, select["removed"]), "shapley": total[:, own],
    }


def failure_cells(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, pattern (bit i set: fails filter i; the last one is E, equal to the text of a smaller id), n, good, toxic."""
    texts = documents.select(plain(id_col).alias("id"), F.coalesce(plain(part_col).cast("string"), F.lit("")).alias("part"), text_of(plain(text_col)).alias("text"))
    flags = text_filters(F.col("text"), F.col("found"))
    pattern = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(flags.values())), F.lit(0))
    # the texts once; what follows reads a few bytes a document
    rows = written(texts.withColumn("found", words(F.col("text"))).select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), pattern.alias("pattern")), "failures")
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counts = [F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in COUNTS[1:]]]
    by_id = rows.join(said, "id", "left").groupBy("id", "digest", "part", "pattern").agg(*counts)
    # copies become one row per digest, part and pattern, with those of the smallest id apart
    least = F.min(F.struct("id", *COUNTS)).alias("least")
    groups = by_id.groupBy("digest", "part", "pattern", F.col("id").isNull().alias("no_id")).agg(*[F.sum(c).alias(c) for c in COUNTS], least)
    first = rows.groupBy("digest").agg(F.min("id").alias("smallest"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    met = groups.join(first, "digest", "left")
    alone = F.col("no_id") | F.col("smallest").isNull()
    passing = {c: F.when(alone, F.col(c)).when(F.col("least.id") == F.col("smallest"), F.col(f"least.{c}")).otherwise(0) for c in COUNTS}
    cells = F.array(F.struct(F.col("pattern"), *[v.alias(c) for c, v in passing.items()]), F.struct((F.col("pattern") + (1 << len(flags))).alias("pattern"), *[(F.col(c) - v).alias(c) for c, v in passing.items()]))
    return met.select("part", F.explode(cells).alias("cell")).where("cell.n > 0").groupBy("part", "cell.pattern").agg(*[F.sum(f"cell.{c}").alias(c) for c in COUNTS])


def audit_filters(cells: DataFrame, names: str) -> DataFrame:
    """A row per part, filter_order and step with kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    k = len(names)
    orders = ["".join(names[f] for f in order) for order in permutations(range(k))]
    # 2^k rows at most
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("pattern", *COUNTS)).alias("cells"))
    figures = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PARTS_AT_ONCE):
                batch = whole.slice(at, PARTS_AT_ONCE)
                n = batch.num_rows
                flat = np.zeros((n, len(COUNTS), 1 << k), dtype=np.int64)
                for i, found in enumerate(batch.column("cells").to_pylist()):
                    for cell in found:
                        flat[i, :, cell["pattern"]] = [cell[c] for c in COUNTS]
                # bit i of a pattern is axis i
                tensors = flat.reshape(n, len(COUNTS), *[2] * k).transpose(0, 1, *range(k + 1, 1, -1))
                report = audit_tensors(tensors, names)
                yield pa.RecordBatch.from_pydict({
                    "part": np.repeat(np.array(batch.column("part").to_pylist(), dtype=object), len(orders) * k), "filter_order": np.tile(np.repeat(np.array(orders, dtype=object), k), n),
                    "step": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n * len(orders))), **{f: np.ascontiguousarray(report[f]).ravel() for f in figures},
                })

    return parts.mapInArrow(run, f"part string, filter_order string, step int, {', '.join(f'{f} long' for f in figures)}")
