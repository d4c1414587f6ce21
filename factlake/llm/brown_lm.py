"""Language-model scoring with Brown classes: class transitions times word emissions.

Exchange clustering in two steps. The commonest words (`paired`; their pairs' exact counts are a
table of bounded size) move one by one to the class that most raises the mutual information of
adjacent classes, round by round until nothing moves. Then every other word of the training texts is moved once, out of the class of rare words to
the one that its neighbours among the common words speak for; for a rare word, the gain in mutual
information is linear in its neighbour counts. Their classes are kept by hash bucket (at least two buckets
a word, up to MAX_BUCKETS; words that share a bucket move together), a table of bounded size. The
number of classes grows with the cube root of the vocabulary, up to MAX_CLASSES. Words
with few such neighbours, and unseen ones in empty buckets, stay in the class of rare words; the text's end has
a class of its own. Classes' transitions are counted again over all training texts.

With N(w) a word's training count, a token's probability is

    (N(w) + 1) * (a * P(class | class before) / (N(class) + V(class) + 1) + (1 - a) / (N + V + classes)),

which sums to one over the training words and one unknown word per class. The count is a common
factor, so log10 splits into a sum over words and a sum over class pairs.

Counts are exact over all training documents. The head's counts and classes are a table of
bounded size and go to every task; the words outside it are counted, and met with the documents
they occur in, by one shuffle keyed by their hash, already summed per document. No word
outside the head is common, so no key is hot.

Defined results: a null or wordless text is its end alone; a null id trains; repeated rows are
scored alike and each counts; without training documents every count is zero; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kth_largest, plain, text_of, written

#: Words of the head at most: their counts and classes are in every task's memory.
HEAD = 1 << 16
#: Of them, the words that are clustered round by round: exact counts of their pairs are one table.
PAIRED = 1024
#: Classes of words, and hash buckets of the classes of all other words, at most.
MAX_CLASSES = 512
MAX_BUCKETS = 1 << 24
#: Rounds at most; they end when one moves nothing.
ROUNDS = 12
#: Neighbours among the common words that a bucket needs to leave the class of rare words.
MIN_NEIGHBOURS = 3
#: Weight of the class part in the mixture, and of a class's overall share in its transitions.
CLASS_SHARE = 0.8
PRIOR = 20.0
#: Distinct words or keys that a task holds at once, and texts that it works on at once.
_FLUSH = 150_000
_TEXTS = 512


def held_out(id_col: Column) -> Column:
    """Whether crc32(id as text) mod 7 is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tokens_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_hash(word: bytes) -> int:
    """A word's number: XXH64 as a signed long."""
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(plain(id_col).alias("doc_id"), text_of(plain(text_col)).alias("text"), held_out(plain(id_col)).alias("held_out"))


def word_counts(texts: DataFrame) -> DataFrame:
    """word (binary), n: every word's count in the training texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                seen.update(tokens_of(t))
                if len(seen) > _FLUSH:
                    yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
                    seen.clear()
        yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    return texts.where(~F.col("held_out")).select("text").mapInPandas(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _codes(known: dict[bytes, int], other: int, buckets: int) -> dict[bytes, int]:
    """Codes of words: those known, and other + hash bucket for the rest, computed once while there is room."""

    class Codes(dict):
        def __missing__(self, word: bytes) -> int:
            u = other + (xxhash.xxh64_intdigest(word) & (buckets - 1))
            if len(self) < len(known) + _FLUSH:
                self[word] = u
            return u

    return Codes(known)


def _paths(batches: Iterator[pd.DataFrame], codes: dict[bytes, int], end: int) -> Iterator[list[np.ndarray]]:
    """Codes of the texts' words in order, the end before and after, some texts at a time."""
    for b in batches:
        for i in range(0, len(b), _TEXTS):
            yield [np.array([end, *map(codes.__getitem__, tokens_of(t)), end], np.int64) for t in b["text"].iloc[i : i + _TEXTS]]


def pair_counts(texts: DataFrame, known: dict[bytes, int], rest: np.ndarray, width: int, end: int) -> DataFrame:
    """a, b, n: how often unit b follows unit a in the training texts. Units are numbers below width; rest is that of a word not known, by bucket."""
    shared = texts.sparkSession.sparkContext.broadcast((known, rest))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, rest = shared.value
        unit = np.concatenate((np.arange(width), rest)).astype(np.int64)
        sums = np.zeros(width * width, np.int32)
        for paths in _paths(batches, _codes(known, width, len(rest)), end):
            units = [unit[p] for p in paths]
            at, n = np.unique(np.concatenate([u[:-1] * width + u[1:] for u in units]), return_counts=True)
            sums[at] += n.astype(np.int32)
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"a": (at // width).astype(np.int32), "b": (at % width).astype(np.int32), "n": sums[at].astype(np.int64)})

    return texts.where(~F.col("held_out")).select("text").mapInPandas(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def information(table: np.ndarray) -> float:
    """Mutual information of adjacent classes, but for terms that no move changes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=0)).sum() - _xlogx(table.sum(axis=1)).sum())


def _best_class(now: int, right: np.ndarray, left: np.ndarray, own: float, table: np.ndarray) -> int:
    """Class to which a word should move. right, left: its counts by neighbour class, without itself; own: with itself; table: class pairs, the last two classes fixed."""
    t, n = table.copy(), len(table) - 2
    t[now, :] -= right
    t[:, now] -= left
    t[now, now] -= own
    # its neighbours keep their row and column sums, wherever it goes
    rows, cols = (t.sum(axis=1) + left)[:n], (t.sum(axis=0) + right)[:n]
    # moving to class c changes row c, column c and their sums only
    row, col, c = t[:n] + right, t[:, :n] + left[:, None], np.arange(n)
    corner = t[c, c] + right[:n] + left[:n] + own
    gains = (_xlogx(row) - _xlogx(t[:n])).sum(axis=1) + (_xlogx(col) - _xlogx(t[:, :n])).sum(axis=0)
    gains += _xlogx(corner) - _xlogx(row[c, c]) - _xlogx(col[c, c]) + _xlogx(t[c, c])
    gains -= _xlogx(rows + right.sum() + own) - _xlogx(rows) + _xlogx(cols + left.sum() + own) - _xlogx(cols)
    return int(gains.argmax()) if gains.max() > gains[now] + 1e-9 else now


def exchange_clusters(pairs: np.ndarray, k: int, n_classes: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Class of every unit, the class pairs' counts, and the objective round by round.

    pairs: counts of adjacent units: k words, the text's end, all other words. Words start dealt
    in turn by rank over n_classes classes; the two last units keep the two last classes.
    """
    classes = np.concatenate((np.arange(k) % n_classes, [n_classes, n_classes + 1]))
    width = n_classes + 2
    member = np.eye(width)[classes]
    table = member.T @ pairs @ member
    course = [information(table)]
    for _ in range(rounds):
        moved = 0
        for w in range(k):
            now, own = classes[w], float(pairs[w, w])
            right, left = (np.bincount(classes, weights=x, minlength=width) for x in (pairs[w], pairs[:, w]))
            right[now] -= own
            left[now] -= own
            to = _best_class(now, right, left, own, table)
            if to != now:
                for c, sign in ((now, -1), (to, 1)):
                    table[c, :] += sign * right
                    table[:, c] += sign * left
                    table[c, c] += sign * own
                classes[w] = to
                moved += 1
        course.append(information(table))
        if not moved:
            break
    return classes, table, course


def move_gains(table: np.ndarray) -> np.ndarray:
    """Gain in mutual information per neighbour: a row per neighbour's class before (then: after) the word, a column per class to move to."""
    n, t = len(table) - 2, table + 0.5
    before = np.log(t / (t.sum(axis=1, keepdims=True) * t.sum(axis=0)))
    return np.concatenate((before[:, :n], before.T[:, :n]))


def bucket_classes(texts: DataFrame, known: dict[bytes, int], table: np.ndarray, buckets: int) -> np.ndarray:
    """Class of every hash bucket of words: the one that most raises the mutual information, given the classes of its known neighbours."""
    width, end, rare = len(table), len(table) - 2, len(table) - 1
    shared = texts.sparkSession.sparkContext.broadcast((known, move_gains(table)))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """bucket, code (neighbour's side and class) and count, summed over some texts at a time."""
        held, size = [], 0

        def summed() -> pd.DataFrame:
            key, n = np.unique(np.concatenate(held or [np.zeros(0, np.int64)]), return_counts=True)
            return pd.DataFrame({"bucket": (key // (2 * width)).astype(np.int32), "code": (key % (2 * width)).astype(np.int16), "n": n.astype(np.int32)})

        for paths in _paths(batches, _codes(shared.value[0], width, buckets), end):
            p = np.concatenate(paths)  # ends lie side by side and are no words
            at = np.flatnonzero(p >= width)
            for side, to in ((0, -1), (1, 1)):
                near = p[at + to]
                mine = near < width
                held.append((p[at[mine]] - width) * (2 * width) + side * width + near[mine])
                size += len(held[-1])
            if size > 2_000_000:
                yield summed()
                held, size = [], 0
        yield summed()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by bucket; the last bucket of a batch waits for the next one."""
        gains, rest = shared.value[1], None

        def best(b: pd.DataFrame) -> pd.DataFrame:
            bucket, code, n = (b[c].to_numpy() for c in ("bucket", "code", "n"))
            starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            total = np.add.reduceat(gains[code] * n[:, None], starts)
            enough = np.add.reduceat(n, starts) >= MIN_NEIGHBOURS
            return pd.DataFrame({"bucket": bucket[starts[enough]], "class": total[enough].argmax(axis=1).astype(np.int16)})

        for batch in batches:
            b = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if len(b):
                whole = b["bucket"] != b["bucket"].iloc[-1]
                rest = b[~whole]
                if whole.any():
                    yield best(b[whole])
        if rest is not None and len(rest):
            yield best(rest)

    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = texts.where(~F.col("held_out")).select("text").mapInPandas(gather, "bucket int, code short, n int")
    judged = met.repartition(n, "bucket").sortWithinPartitions("bucket").mapInPandas(judge, "bucket int, class short")
    out = np.full(buckets, rare, np.int16)
    packed = judged.mapInPandas(lambda bs: (pd.DataFrame({"b": [b["bucket"].to_numpy()], "c": [b["class"].to_numpy()]}) for b in bs if len(b)), "b array<int>, c array<short>")
    for r in packed.toLocalIterator():  # at most MAX_BUCKETS numbers in all
        out[r.b] = r.c
    return out


def class_model(table: np.ndarray, counts: np.ndarray, sizes: np.ndarray, n_all: int, v_all: int) -> np.ndarray:
    """log10 of the bracket for every (class before, class). table: class pairs; counts, sizes: training tokens and distinct words per class."""
    share = (counts + 1) / (counts.sum() + len(table))
    transition = (table + PRIOR * share) / (table.sum(axis=1, keepdims=True) + PRIOR)
    return np.log10(CLASS_SHARE * transition / (counts + sizes + 1) + (1 - CLASS_SHARE) / (n_all + v_all + len(table)))


def score_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, paired: int = PAIRED, rounds: int = ROUNDS) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    spark = documents.sparkSession
    texts = _texts(documents, id_col, text_col)
    counts = written(word_counts(texts), "wordcounts")
    n_docs = texts.where(~F.col("held_out")).count()
    totals = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, v_all = (totals.n or 0) + n_docs, totals.v + (n_docs > 0)
    # the head: words above the count of the one after it, so at most `head`
    cut = int(kth_largest(counts.select(F.col("n").alias("v")), head + 1)) if totals.v > head else 0
    top = sorted(((bytes(r.word), r.n) for r in counts.where(F.col("n") > cut).collect()), key=lambda x: (-x[1], x[0]))
    n_classes = int(np.clip(round(totals.v ** (1 / 3)), 2, MAX_CLASSES))
    buckets = int(np.clip(1 << (2 * totals.v).bit_length(), 1 << 10, MAX_BUCKETS))
    end, rare = n_classes, n_classes + 1

    numbers = {w: i for i, (w, _) in enumerate(top[:paired])}
    k = len(numbers)
    pairs = np.zeros((k + 2, k + 2))
    for r in written(pair_counts(texts, numbers, np.full(1, k + 1), k + 2, k).groupBy("a").agg(F.collect_list("b").alias("b"), F.collect_list("n").alias("n")), "pairs").toLocalIterator():
        pairs[r.a, r.b] = r.n  # a row per unit, and a number per two units: bounded by PAIRED
    classes, table, _ = exchange_clusters(pairs, k, n_classes, rounds)
    known = {w: int(classes[i]) for w, i in numbers.items()}
    of_bucket = bucket_classes(texts, known, table, buckets)
    class_of = {w: known[w] if w in known else int(of_bucket[xxhash.xxh64_intdigest(w) & (buckets - 1)]) for w, _ in top}
    table = np.zeros_like(table)
    for r in written(pair_counts(texts, known, of_bucket, rare + 1, end), "transitions").collect():  # a row per two classes
        table[r.a, r.b] = r.n

    # training tokens and distinct words per class
    tokens, sizes = np.zeros(rare + 1), np.zeros(rare + 1)
    tokens[end], sizes[end] = n_docs, n_docs > 0
    for w, n in top:
        tokens[class_of[w]] += n
        sizes[class_of[w]] += 1
    shared = spark.sparkContext.broadcast(({w: (class_of[w], math.log10(n + 1)) for w, n in top}, of_bucket))
    of_word = F.pandas_udf(lambda ws: pd.Series([shared.value[1][xxhash.xxh64_intdigest(bytes(w)) & (buckets - 1)] for w in ws], dtype="int32"), "int")
    for x in counts.where(F.col("n") <= cut).groupBy(of_word("word").alias("class")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        tokens[x["class"]] += x.n
        sizes[x["class"]] += x.v
    brackets, end_value = class_model(table, tokens, sizes, n_all, v_all), math.log10(n_docs + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head_words, of_bucket = shared.value
        for b in (whole.iloc[i : i + _TEXTS] for whole in batches for i in range(0, len(whole), _TEXTS)):
            out: dict[str, list] = {c: [] for c in ("n_tokens", "n_head", "head_sum", "pairs_sum", "words", "times")}
            for t in b["text"]:
                total, n_head, tail, tail_times, cls = 0.0, 0, [], [], {}
                words = tokens_of(t)
                for w, times in Counter(words).items():
                    if (x := head_words.get(w)) is None:
                        h = xxhash.xxh64_intdigest(w)
                        tail.append(h)
                        tail_times.append(times)
                        cls[w] = of_bucket[h & (buckets - 1)]
                    else:
                        cls[w] = x[0]
                        total += times * x[1]
                        n_head += times
                p = np.array([end, *map(cls.__getitem__, words), end], np.int64)
                out["n_tokens"].append(len(words) + 1)
                out["n_head"].append(n_head + (end_value > 0))
                out["head_sum"].append(total + end_value)
                out["pairs_sum"].append(float(brackets[p[:-1], p[1:]].sum()))
                out["words"].append(np.array(tail, np.uint64).view(np.int64))
                out["times"].append(np.array(tail_times, np.int32))
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "held_out": b["held_out"].to_numpy()} | out)

    kind = dict(texts.dtypes)["doc_id"]
    scored = written(
        texts.mapInPandas(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_head long, head_sum double, pairs_sum double, words array<long>, times array<int>").withColumn("row", F.monotonically_increasing_id()), "scored"
    )
    hashed = F.pandas_udf(lambda ws: pd.Series([word_hash(bytes(w)) for w in ws], dtype="int64"), "long")
    vocabulary = counts.where(F.col("n") <= cut).select(hashed("word").alias("word"), "n")
    met = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times")).join(vocabulary, "word")
    tails = met.select("row", (F.col("times") * F.log10(F.col("n") + 1)).alias("part"), F.col("times").cast("long").alias("known"))
    base = scored.select("row", "doc_id", "held_out", "n_tokens", "n_head", "head_sum", "pairs_sum")
    sums = tails.groupBy("row").agg(F.sum("part").alias("part"), F.sum("known").alias("known"))
    total = F.col("head_sum") + F.coalesce("part", F.lit(0.0))
    return base.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (total - F.col("n_tokens") * F.lit(math.log10(n_all + v_all + 1))).alias("base_score"), (total + F.col("pairs_sum")).alias("score"),
        F.pow(F.lit(10.0), -(total + F.col("pairs_sum")) / F.col("n_tokens")).alias("perplexity"),
    )
