"""Quality rules: text statistics and hashed n-gram log-likelihood ratios, by DataFrame operations only.

Word unigrams and bigrams are hashed into two multinomials: one counted over every document
(raw), one over trusted documents (labelled of quality and not toxic; at most MAX_TARGET, drawn
by hash). Hashes are the engine's XXH64. A document's score is the sum of its n-grams' log
ratios, target to raw, divided by their number; it is held against a fixed threshold.

A few toxic words would drown in that mean, so a second pair of multinomials tells them apart:
lower-case words, and words' first letters, of labelled toxic rows (at most MAX_TOXIC) against those of
trusted rows, each counted once per following word. Only buckets that toxic rows hold far more often
(MARK_TIMES as often, MARK_Z standard errors apart) have a ratio, all others are alike. A document's
toxic score is the sum of its words' ratios (the larger of a word's two) less TOXIC_WORD for
every word, so that length alone proves nothing; above TOXIC_THRESHOLD the document is not kept.

The models are arrays of fixed size, handed to the tasks as scalar subqueries. A document's words
are exploded and summed up again in the task that reads it: one row a document is shuffled.

Defined results: a null or wordless text has no words, fails the base rules and is not kept;
repeated rows are judged alike; with no labels every ratio is zero and only the base rules
count; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain, text_of, words, written

#: Hash buckets of the unigrams, and as many of the bigrams.
BUCKETS = 1 << 16
#: Hash buckets of the lower-case words, and their first letters, of the toxic model.
TOXIC_BUCKETS = 1 << 18
STEM = 5
#: Trusted rows that the target model is fit on, and toxic rows that the toxic model is fit on, at most.
MAX_TARGET = 50_000
MAX_TOXIC = 50_000
#: Pseudo-count of every bucket, in target counts: rare words that the target happens to lack weigh little.
SMOOTHING = 5.0
#: Mean log ratio per n-gram from which a document is kept.
THRESHOLD = -0.15
#: When toxic rows tell a bucket apart: so many times the trusted rows' share, so many standard errors above it.
MARK_TIMES, MARK_Z = 8, 4.0
#: What a word takes off the toxic score, and the score above which a document is toxic.
TOXIC_WORD, TOXIC_THRESHOLD = 0.01, 5.0
_ESTIMATE = 16
# Fixed values of the base rules.
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50


def _left(a: Column, n: Column) -> Column:
    return F.call_function("shiftleft", a, n)


def _right(a: Column, n: Column) -> Column:
    return F.call_function("shiftright", a, n)


def with_repeated_words(df: DataFrame) -> DataFrame:
    """df (tokens) with n_repeat_words: words in three-word windows found twice or more, their first occurrence included.

    A window's hash gives its last bits to its position; sorted as plain numbers, windows with
    equal hashes are neighbours, and are compared by their full hashes. The positions, sorted
    again, cover min(3, distance to the next) words each. Every step is a projection of its own
    whose columns the next one reads more than once, so that nothing is computed twice.
    """
    n = F.greatest(F.size("tokens") - 2, F.lit(0))
    windows = F.transform(F.arrays_zip(*[F.slice("tokens", i + 1, n).alias(f"w{i}") for i in range(3)]), lambda z: F.xxhash64(z["w0"], z["w1"], z["w2"]))
    bits = F.ceil(F.log2(F.size("windows") + 1.0)).cast("int")
    placed = F.transform("windows", lambda h, i: _left(_right(h, F.col("bits")), F.col("bits")).bitwiseOR(i.cast("long")))
    none = F.array().cast("array<bigint>")

    def position(x: Column) -> Column:
        return x.bitwiseAND(F.bitwise_not(_left(F.lit(-1).cast("long"), F.col("bits"))))

    def same(x: Column, y: Column) -> Column:
        near = _right(x.bitwiseXOR(y), F.col("bits")) == 0
        return F.coalesce(near & (F.get("windows", position(x).cast("int")) == F.get("windows", position(y).cast("int"))), F.lit(False))

    twice = F.filter("placed", lambda x, i: same(x, F.get("placed", i + 1)) | same(x, F.get("placed", i - 1)))
    covered = F.aggregate(
        "repeated", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3).cast("long"), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"],
    )
    return (
        df.withColumn("windows", windows).withColumn("bits", bits)
        # most texts repeat no window and need no sort
        .withColumn("placed", F.sort_array(F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed).otherwise(none)))
        .withColumn("repeated", F.sort_array(F.transform(twice, position)))
        .withColumn("n_repeat_words", covered).drop("windows", "bits", "placed", "repeated")
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs (text, tokens) with the base columns but word_chars."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counted = docs.withColumns({"n_words": F.size("tokens").cast("long"), "n_symbols": F.regexp_count("text", F.lit(SYMBOLS)).cast("long"), "lines": lines})
    return with_repeated_words(counted.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines"))


def _pairs(tokens: Column) -> Column:
    """Each word with the one that follows it; the last with null."""
    return F.arrays_zip(tokens.alias("a"), F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))).alias("b"))


def _buckets(a: Column, b: Column, buckets: int) -> tuple[Column, Column]:
    return F.pmod(F.xxhash64(a), F.lit(buckets)).cast("int"), (F.pmod(F.xxhash64(a, b), F.lit(buckets)) + buckets).cast("int")


def _toxic_buckets(word: Column, buckets: int) -> tuple[Column, Column]:
    """Buckets of a lower-case word and of its first STEM letters, so that inflected forms share one."""
    word = F.lower(word)
    return tuple(F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int") for x in (word, F.concat(F.lit("^"), F.substring(word, 1, STEM))))


def _drawn(labels: DataFrame, rule: str, limit: int) -> DataFrame:
    """t_id: ids whose label meets the rule; if more than limit, those whose hashes come first."""
    return labels.where(rule).where("doc_id is not null").select(F.col("doc_id").alias("t_id")).distinct().orderBy(F.xxhash64("t_id"), "t_id").limit(limit)


def _as_array(values: DataFrame, size: int) -> DataFrame:
    """One row: values (bucket, v; a row per bucket at most) as an array of that size, 0 where there is none."""
    every = values.sparkSession.range(size).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(values), "bucket", "left")
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("v", F.lit(0.0)).alias("v")))), lambda x: x["v"]).alias("ratios"))


def ngram_model(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, smoothing: float = SMOOTHING, limit: int = MAX_TARGET) -> DataFrame:
    """One row, ratios: the log ratio per bucket, unigrams first."""
    docs = documents.select(plain(id_col).alias("doc_id"), words(plain(text_col)).alias("tokens"))
    # at most `limit` ids, so small enough to broadcast
    marked = docs.join(F.broadcast(_drawn(labels, "quality = 1 and toxic = 0", limit)), F.col("doc_id") == F.col("t_id"), "left").select(F.col("t_id").isNotNull().cast("int").alias("trusted"), F.explode(_pairs(F.col("tokens"))).alias("z"))
    ngrams = marked.select("trusted", F.explode(F.array(*_buckets(F.col("z.a"), F.col("z.b"), buckets))).alias("bucket"))
    # at most 2 * buckets rows from here on
    counts = ngrams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("trusted").alias("target")).withColumn("kind", F.col("bucket") >= buckets)
    totals = counts.groupBy("kind").agg(F.sum("raw").alias("raw_all"), F.sum("target").alias("target_all"))
    # raw counts on the target's scale; a bucket says as much as it has seen
    raw = F.col("raw") * F.col("target_all") / F.greatest("raw_all", F.lit(1))
    ratio = F.log(F.col("target") + F.lit(smoothing)) - F.log(raw + F.lit(smoothing))
    return _as_array(counts.join(F.broadcast(totals), "kind").select("bucket", ratio.alias("v")), 2 * buckets)


def toxic_model(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = TOXIC_BUCKETS, limit: int = MAX_TARGET, toxic_limit: int = MAX_TOXIC) -> DataFrame:
    """One row, ratios: per bucket of lower-case words and of their first letters the log ratio of toxic to trusted rows where marked, else 0.

    A word counts once for each word that follows it, so that copies and near copies of a row
    carry no weight. Contexts are gathered only for words whose plain counts can still be marked.
    """
    known = _drawn(labels, "quality = 1 and toxic = 0", limit).withColumn("toxic", F.lit(0)).unionByName(_drawn(labels, "toxic = 1", toxic_limit).withColumn("toxic", F.lit(1)))
    # an id with labels of both kinds is toxic; at most limit + toxic_limit ids
    known = F.broadcast(known.groupBy("t_id").agg(F.max("toxic").alias("toxic")))
    rows = documents.select(plain(id_col).alias("doc_id"), plain(text_col).alias("text")).join(known, F.col("doc_id") == F.col("t_id"))
    pairs = rows.select("toxic", F.explode(_pairs(words(F.col("text")))).alias("z")).select("toxic", F.xxhash64("z.a", "z.b").alias("context"), F.explode(F.array(*_toxic_buckets(F.col("z.a"), buckets))).alias("bucket"))
    counts = written(pairs.groupBy("bucket").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")), "toxicwords")
    whole = counts.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    if not whole.t or not whole.c:
        return _as_array(documents.sparkSession.createDataFrame([], "bucket int, v double"), buckets)
    # at most `buckets` rows
    able = F.broadcast(counts.where((F.col("t") >= MARK_Z**2 / 2) & (F.col("t") / whole.t >= 2 * F.col("c") / whole.c)).select("bucket", F.lit(1).alias("able")))
    # all contexts are counted by the share of them whose hash is divisible by _ESTIMATE
    dealt = F.pmod("context", F.lit(_ESTIMATE)) == 0
    once = written(pairs.join(able, "bucket", "left").where(F.col("able").isNotNull() | dealt).distinct(), "toxicpairs")
    n0, n1 = (_ESTIMATE * max(1, once.where(dealt & (F.col("toxic") == i)).count()) for i in (0, 1))
    once = once.where("able = 1").groupBy("bucket").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    shares = once.select("bucket", (F.col("c") / n0).alias("p"), (F.col("t") / n1).alias("q"), ((F.col("c") + F.col("t")) / (n0 + n1)).alias("pooled"))
    error = F.sqrt(F.col("pooled") * (1 - F.col("pooled")) * (1 / n0 + 1 / n1))
    base = F.col("p") + 0.25 / n0
    marked = shares.where((F.col("q") - F.col("p") >= MARK_Z * error) & (F.col("q") >= MARK_TIMES * base))
    return _as_array(marked.select("bucket", F.log(F.col("q") / base).alias("v")), buckets)


def quality(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD, toxic_buckets: int = TOXIC_BUCKETS, toxic_threshold: float = TOXIC_THRESHOLD, **options) -> DataFrame:
    """A row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score, toxic_score."""
    ratios = ngram_model(documents, labels, id_col, text_col, buckets, **options).scalar()
    toxic = toxic_model(documents, labels, id_col, text_col, toxic_buckets, options.get("limit", MAX_TARGET)).scalar()
    docs = documents.select(plain(id_col).alias("doc_id"), text_of(plain(text_col)).alias("text"), F.monotonically_increasing_id().alias("r")).withColumn("tokens", words(F.col("text")))
    statistics = ("n_words", "n_symbols", "n_dup_lines", "n_repeat_words")
    apart = with_statistics(docs).select("r", "doc_id", *statistics, F.explode_outer(_pairs(F.col("tokens"))).alias("z")).withColumns({"ratios": ratios, "toxic": toxic})
    uni, bi = _buckets(F.col("z.a"), F.col("z.b"), buckets)
    each = apart.select("r", "doc_id", *statistics, F.char_length("z.a").alias("chars"), (F.element_at("ratios", uni + 1) + F.element_at("ratios", bi + 1)).alias("lr"), F.greatest(*[F.element_at("toxic", b + 1) for b in _toxic_buckets(F.col("z.a"), toxic_buckets)]).alias("tr"))
    # whole in one task each: a row per document is left before the shuffle
    found = each.groupBy("r", "doc_id").agg(*[F.first(c).alias(c) for c in statistics], F.coalesce(F.sum("chars"), F.lit(0)).alias("word_chars"), F.sum(F.when(F.col("chars").isNotNull(), F.col("lr"))).alias("lr"), F.sum(F.when(F.col("chars").isNotNull(), F.col("tr"))).alias("tr"))
    n = F.col("n_words")
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * n)
    judged = found.withColumns({"score": F.coalesce(F.col("lr") / (2 * n), F.lit(0.0)), "toxic_score": F.coalesce(F.col("tr") - TOXIC_WORD * n, F.lit(0.0)), "base_failed": failed})
    kept = ~F.col("base_failed") & (F.col("score") >= threshold) & (F.col("toxic_score") <= toxic_threshold)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "score", "toxic_score")
