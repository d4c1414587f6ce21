"""Quality classifier by importance resampling with hashed n-gram models.

Three generative models of a text:

* raw: a multinomial over hashed token unigrams and bigrams, counted over every document;
* target: the same over trusted documents (labelled of quality and not toxic; at most MAX_TARGET, drawn by hash);
* toxic: the target model, tilted where labelled toxic rows hold a word far more often
  (`quality_rules.toxic_model`: words and their first letters, counted once per following word, so copies carry no weight).

The corpus is taken for a mixture of raw and toxic text, toxic with its share of the labelled rows.
A document's log importance weight is the log ratio of its probability as target to that as
corpus. Neighbouring n-grams depend on each other: with a correlation of CORRELATION between any
two of a text, n of them say as much as n / (1 + (n - 1) * CORRELATION) independent ones.

Documents are drawn without replacement by Gumbel top-k: hash-seeded Gumbel noise is added to
the log weight and the k largest are kept. k is a budget: given, or the expected number of target
documents, which is the sum over all documents of the probability of being trusted, a logistic function
of the log weight that is fit on labelled rows (at most MAX_CURVE of each kind, drawn by hash), each weighed by a model
whose target lacks its half of the texts. The k-th largest
value is found exactly by narrowing histograms, so nothing is sorted in one place.

Defined results: a null or token-free text has weight 0 and is never kept; rows with equal (id,
text) get equal noise and verdict; values that tie with the k-th are kept; with no labels
every weight is zero, and unless k is given every text with tokens is kept, as where labels are of one kind;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, kth_largest, plain, text_of, written
from .quality_rules import STEM, TOXIC_WORD, toxic_model

#: Hash buckets of the unigrams, and as many of the bigrams.
BUCKETS = 1 << 16
#: Trusted rows that the target model is fit on, and toxic ones of the toxic model, at most.
MAX_TARGET = 50_000
#: Labelled rows of a kind that the budget is fit on, at most.
MAX_CURVE = 10_000
#: Pseudo-count of every bucket, in target counts: rare words that the target happens to lack weigh little.
SMOOTHING = 5.0
#: Correlation between two n-grams of a text.
CORRELATION = 0.02
_TRUSTED = "quality = 1 and toxic = 0"
_OTHER = "quality = 0 or toxic = 1"
_TOKEN = re.compile(rb"[0-9a-z_\x80-\xff]+|[^0-9a-z_\x80-\xff\s]+")

#: Log ratios per bucket (target to raw; toxic to target) and the share of toxic text.
Model = tuple[np.ndarray, np.ndarray, float]


def features(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket numbers of a text's unigrams (from 0) and bigrams (from buckets on)."""
    tokens = _TOKEN.findall((text or "").encode("utf-8", "surrogatepass").lower())
    h = np.fromiter(map(zlib.crc32, tokens), np.uint64, len(tokens))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
    return np.concatenate((h % np.uint64(buckets), np.uint64(buckets) + pairs % np.uint64(buckets))).astype(np.int64)


def word_buckets(word: str, buckets: int) -> list[int]:
    """Buckets of a lower-case word and of its first letters in the toxic model: the engine's XXH64, cut to so many (a power of two)."""
    return [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 42) & (buckets - 1) for x in (word, "^" + word[:STEM])]


class ToxicRatios(dict):
    """Log ratio, toxic to target, of lower-case words (UTF-8); worked out once a word while there is room."""

    def __init__(self, toxic: np.ndarray) -> None:
        super().__init__()
        self.toxic = toxic

    def __missing__(self, word: bytes) -> float:
        value = float(self.toxic[word_buckets(word.decode("utf-8", "surrogatepass"), len(self.toxic))].max())
        if len(self) < 300_000:
            self[word] = value
        return value


def toxic_evidence(text: str | None, ratios: ToxicRatios) -> float:
    """Log ratio of a text's probability as toxic to that as target."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()  # bytes part at the white space that words are learnt with, and at no other
    return sum(map(ratios.__getitem__, words)) - TOXIC_WORD * len(words)


def labelled_ids(labels: DataFrame, rule: str, limit: int, id_col: str = "doc_id") -> DataFrame:
    """Ids whose label meets the rule, at most limit of them, drawn by hash."""
    found = labels.where(rule).select(plain(id_col).alias("doc_id")).where("doc_id is not null").distinct()
    return found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def _ratio(target: np.ndarray, raw: np.ndarray, smoothing: float) -> np.ndarray:
    """Log ratio of target to raw, raw scaled to the target's total and both with the same pseudo-count."""
    return np.log(target + smoothing) - np.log(raw * (target.sum() / max(raw.sum(), 1.0)) + smoothing)


def _fold(text: Column) -> Column:
    """Half of the texts, by hash, so that copies are in one half."""
    return F.pmod(F.xxhash64(text_of(text), F.lit(7)), F.lit(2)).cast("int")


def log_ratios(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, smoothing: float = SMOOTHING, limit: int = MAX_TARGET) -> np.ndarray:
    """The log ratio of target to raw probability per bucket. Two more rows: the same without the trusted rows of either fold.

    Counts come from every document. Raw counts are scaled to the target's total and both get
    the same pseudo-count, so a bucket says as much as it has seen: rare words that the target
    happens to lack weigh little.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((3, 2 * buckets), np.int64)  # raw, target by fold
        for b in batches:
            for text, fold in zip(b["text"], b["fold"], strict=True):
                found = features(text, buckets)
                np.add.at(counts[0], found, 1)
                if fold >= 0:
                    np.add.at(counts[1 + fold], found, 1)
        at = np.flatnonzero(counts[0])
        yield pd.DataFrame({"bucket": at.astype(np.int32)} | {c: counts[i, at] for i, c in enumerate(names)})

    names = ("raw", "target0", "target1")
    # at most `limit` ids, so small enough to broadcast
    trusted = F.broadcast(labelled_ids(labels, _TRUSTED, limit).withColumn("trusted", F.lit(1)))
    docs = documents.select(plain(id_col).alias("doc_id"), plain(text_col).alias("text")).join(trusted, "doc_id", "left").select("text", F.when(F.col("trusted") == 1, _fold(F.col("text"))).otherwise(-1).alias("fold"))
    sums = docs.mapInPandas(count, "bucket int, raw long, target0 long, target1 long").groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names])
    counts = np.zeros((3, 2 * buckets))
    for r in sums.collect():  # a row per bucket
        counts[:, r.bucket] = r[1:]
    targets = np.stack((counts[1] + counts[2], counts[2], counts[1]))
    return np.stack([np.concatenate([_ratio(t[part], counts[0, part], smoothing) for part in (slice(0, buckets), slice(buckets, None))]) for t in targets])


def fit_model(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_TARGET, **options) -> list[Model]:
    """The model, and for either fold of the texts one whose target has no row of that fold."""
    ratios = log_ratios(documents, labels, id_col, text_col, limit=limit, **options)
    toxic = np.array(toxic_model(documents, labels, id_col, text_col, limit=limit).first()[0])
    known = labels.agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("toxic"), F.count("toxic").alias("n")).first()
    return [(r, toxic, (known.toxic + 1) / (known.n + 2) if toxic.any() else 0.0) for r in ratios]


def weight_of(at: np.ndarray, evidence: float, model: Model) -> float:
    """Log importance weight of a text's features and toxic evidence."""
    ratios, _, share = model
    independent = 1 + max(len(at) - 1, 0) * CORRELATION
    to_raw = float(ratios[at].sum()) / independent
    return to_raw if not share else -float(np.logaddexp(math.log(1 - share) - to_raw, math.log(share) + evidence))


def with_weight(df: DataFrame, model: Model, text_col: str, to: str) -> DataFrame:
    """df with a struct column: weight (log importance weight) and n (features)."""
    shared, buckets = df.sparkSession.sparkContext.broadcast(model), len(model[0]) // 2

    @F.pandas_udf("weight double, n long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        ratios = ToxicRatios(model[1])
        for texts in parts:
            weights, sizes = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for i, t in enumerate(texts):
                at = features(t, buckets)
                sizes[i] = len(at)
                if len(at):
                    weights[i] = weight_of(at, toxic_evidence(t, ratios) if model[2] else 0.0, model)
            yield pd.DataFrame({"weight": weights, "n": sizes})

    return df.withColumn(to, run(plain(text_col)))


def gumbel(id_col: str, text_col: str, seed: int) -> Column:
    """Standard Gumbel noise from a hash of the row's id and text."""
    u = (F.xxhash64(F.lit(seed), plain(id_col), F.xxhash64(text_of(plain(text_col)))).cast("double") + F.lit(2.0**63 + 1024.0)) / F.lit(2.0**64 + 4096.0)
    return -F.log(-F.log(u))


def fit_logistic(x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """a, b of the probability 1 / (1 + exp(-a - b * x)) for counts of good and bad rows at x, with one row of each added to either kind."""
    high, low = (good.sum() + 1) / (good.sum() + 2), 1 / (bad.sum() + 2)
    n, wanted = good + bad, good * high + bad * low
    beta = np.array([math.log((good.sum() + 1) / (bad.sum() + 1)), 0.0])
    design = np.stack((np.ones(len(x)), x))

    def loss(beta: np.ndarray) -> float:
        z = beta @ design
        return float((n * np.logaddexp(0, z) - wanted * z).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(beta @ design, -500, 500)))
        step = np.linalg.solve((design * (n * p * (1 - p))) @ design.T + 1e-9 * np.eye(2), design @ (wanted - n * p))
        size = 1.0
        while size > 1e-6 and loss(beta + size * step) > loss(beta):
            size /= 2
        beta = beta + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def budget_curve(documents: DataFrame, labels: DataFrame, models: list[Model], id_col: str, text_col: str, limit: int = MAX_CURVE) -> tuple[float, float] | None:
    """a, b of the probability of being trusted, from labelled rows weighed by the models that did not see them; None if labels are of one kind."""
    known = labelled_ids(labels, _TRUSTED, limit).withColumn("good", F.lit(1)).unionByName(labelled_ids(labels, _OTHER, limit).withColumn("good", F.lit(0)))
    rows = documents.select(plain(id_col).alias("doc_id"), plain(text_col).alias("text")).join(F.broadcast(known), "doc_id").select("text", "good", _fold(F.col("text")).alias("fold"))
    x, good, bad = [], [], []
    for i, model in enumerate(models[1:]):
        w = with_weight(rows.where(F.col("fold") == i), model, "text", "w")
        # 6,001 values at most; texts without features are left out below: as a filter, their weights would be asked for before the join, of all documents
        tenth = F.when(F.col("w.n") > 0, F.round(F.greatest(F.least(F.col("w.weight"), F.lit(300.0)), F.lit(-300.0)), 1)).alias("x")
        for r in w.groupBy(tenth).agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")).collect():
            if r.x is not None:
                x.append(r.x)
                good.append(r.good)
                bad.append(r.bad)
    return fit_logistic(np.array(x), np.array(good, float), np.array(bad, float)) if sum(good) and sum(bad) else None


def _cut(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, seed: int, k: int | None, options: dict) -> tuple[Model, float, DataFrame]:
    models = fit_model(documents, labels, id_col, text_col, **options)
    docs = documents.select(plain(id_col).alias("doc_id"), plain(text_col).alias("text"))
    weighed = with_weight(docs, models[0], "text", "w").select("doc_id", F.col("w.weight").alias("weight"), F.col("w.n").alias("n_features"), (F.col("w.weight") + gumbel("doc_id", "text", seed)).alias("v"))
    scored = written(weighed, "weights")
    able = scored.where("n_features > 0")
    if k is None:
        curve, each = budget_curve(documents, labels, models, id_col, text_col), F.lit(1.0)
        if curve:
            each = 1 / (1 + F.exp(F.greatest(F.least(-F.lit(curve[0]) - F.lit(curve[1]) * F.col("weight"), F.lit(500.0)), F.lit(-500.0))))
        k = round(able.agg(F.sum(each)).first()[0] or 0)
    return models[0], kth_largest(able.select("v"), k), scored


def resample(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 10, k: int | None = None, **options) -> DataFrame:
    """A row per document: doc_id, n_features, log_weight, kept."""
    _, cut, scored = _cut(documents, labels, id_col, text_col, seed, k, options)
    return scored.select("doc_id", "n_features", F.col("weight").alias("log_weight"), ((F.col("n_features") > 0) & (F.col("v") >= cut)).alias("kept"))


def resampled_documents(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 10, k: int | None = None, **options) -> DataFrame:
    """The kept documents with their columns; weights are computed again in place of a shuffle of texts."""
    model, cut, _ = _cut(documents, labels, id_col, text_col, seed, k, options)
    to = fresh(documents, "weighed")
    scored = with_weight(documents, model, text_col, to)
    return scored.where((F.col(f"{to}.n") > 0) & (F.col(f"{to}.weight") + gumbel(id_col, text_col, seed) >= F.lit(cut))).select(*[plain(c) for c in documents.columns])
