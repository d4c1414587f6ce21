"""Benchmark decontamination by a prefix-filtered join on word shingles, by DataFrame operations only.

A window is `window` consecutive words of a benchmark item, or the whole item if it is shorter.
A window that occurs in a document brings all its shingles, so one of them is enough to find
it: the necessary prefix at full containment is a single shingle, and the rarest one (counted
over all documents) gives the fewest candidates. Documents' shingles meet only those prefix
shingles; a candidate must fit between the document's ends at the shingle's offset (length and
positional bounds) and is then verified word by word.

Documents are taken apart twice for shingles, each time by one explode whose rows end at the
join, and once to count their words. The benchmark's tables, and the candidates, are broadcast
while they have at most `broadcast_bytes`, else joined by shuffle; the results are the same.
What is shuffled then is a key, a position and a hash per word, never a text.

Defined results: null and wordless texts have no words, no hits and are clean; null and
wordless items have no windows; rows with equal (id, text) get equal results; repeated items
count once per item_id; a null item_id is left out of the item list; empty tables give an
empty result, or clean documents if only the benchmark is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, ascii_lower, fresh, plain, row_key, sided, text_of, written

#: What lies between words once A-Z are lower-case: every ASCII character but digits and letters, listed one by one,
#: as the engine looks single characters up in a table.
_BETWEEN = "[" + "".join(f"\\x{c:02X}" for c in range(0x80) if not (chr(c).isdigit() or chr(c).islower())) + "]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text_of(text)), _BETWEEN), "")


def _occurrences(docs: DataFrame, lengths: list[int], keep: list[str]) -> DataFrame:
    """A row (keep..., pos, shingle) per shingle of a document's words, for all the shingle lengths."""
    following = F.arrays_zip(*[F.slice("words", i + 1, F.size("words")).alias(f"w{i}") for i in range(lengths[-1])])
    placed = docs.select(*keep, F.posexplode(following).alias("pos", "z"))

    def shingle(k: int) -> Column:
        return F.xxhash64(F.lit(k), *[F.col(f"z.w{i}") for i in range(k)])

    if len(lengths) == 1:  # no shingle begins where fewer words follow
        return placed.where(F.col(f"z.w{lengths[0] - 1}").isNotNull()).select(*keep, "pos", shingle(lengths[0]).alias("shingle"))
    every = F.array(*[F.when(F.col(f"z.w{k - 1}").isNotNull(), shingle(k)) for k in lengths])
    return placed.select(*keep, "pos", F.explode(every).alias("shingle")).where("shingle is not null")


def _windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """item_id, wid, w: every window of every item."""
    items = benchmark.select(plain(item_col).cast("string").alias("item_id"), _words(plain(text_col)).alias("words")).where("size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    return items.select("item_id", "words", F.explode(starts).alias("s")).select("item_id", F.slice("words", F.col("s"), window).alias("w")).select("item_id", F.md5(F.array_join("w", " ").cast("binary")).alias("wid"), "w").distinct()


def window_hits(docs: DataFrame, windows: DataFrame, shingle: int = 5, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs: dk, text. windows: item_id, wid, w. A row (dk, start, length, wid) per occurrence of a window."""
    own = written(windows.select("wid", "w").distinct().withColumn("k", F.least(F.size("w"), F.lit(shingle))), "windows")
    lengths = sorted(r.k for r in own.select("k").distinct().collect())  # at most `shingle` values
    if not lengths:
        return docs.select("dk", F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("wid")).where("false")
    parts = None
    for k in lengths:
        part = _occurrences(own.where(F.col("k") == k).withColumnRenamed("w", "words"), [k], ["wid"]).withColumnRenamed("pos", "off")
        parts = part if parts is None else parts.unionByName(part)
    parts = written(parts, "shingles")
    distinct = written(parts.select("shingle").distinct(), "distinct")
    texts = docs.select("dk", _words(F.col("text")).alias("words"))
    # rarity over all documents; shingles that no document has can't bring a window
    counts = written(_occurrences(texts, lengths, []).join(sided(distinct, 24, broadcast_bytes), "shingle").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")), "rarity")
    # a window all of whose shingles occur is looked for by the rarest of them
    needed = parts.groupBy("wid").agg(F.count(F.lit(1)).alias("needs"))
    ranked = parts.join(counts, "shingle").groupBy("wid").agg(F.min(F.struct("n", "shingle", "off")).alias("rare"), F.count(F.lit(1)).alias("has"))
    sizes = own.select("wid", F.size("w").alias("length"))
    prefix = written(ranked.join(needed, "wid").where("has = needs").join(sizes, "wid").select("wid", F.col("rare.shingle").alias("shingle"), F.col("rare.off").alias("off"), "length"), "prefix")
    start = F.col("pos") - F.col("off")
    candidates = written(
        _occurrences(texts.withColumn("n", F.size("words")), lengths, ["dk", "n"]).join(sided(prefix, 96, broadcast_bytes), "shingle")
        .where((start >= 0) & (start + F.col("length") <= F.col("n"))).select("dk", start.alias("start"), "length", "wid"), "candidates"
    )
    # the few documents with candidates are read once more; equal documents give equal rows
    keys = written(candidates.select("dk").distinct(), "candidatekeys")
    found = docs.join(sided(keys, 64, broadcast_bytes), "dk", "left_semi").select("dk", "text").withColumn("words", _words(F.col("text"))).select("dk", "words")
    spots = candidates.join(own.select("wid", "w"), "wid")
    return found.join(spots, "dk").where(F.slice("words", F.col("start") + 1, F.col("length")) == F.col("w")).select("dk", "start", "length", "wid")


def contamination(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, shingle: int = 5, share: int = 20, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, row_key.

    A document is contaminated if it has a hit word and share * hits reach its words.
    """
    windows = written(_windows(benchmark, item_col, item_text_col, window), "items")
    docs = documents.select(row_key(id_col, text_col).alias("dk"), plain(text_col).alias("text"))
    hits = written(window_hits(docs, windows, shingle, broadcast_bytes).distinct(), "hits")
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))))
    per_doc = hits.groupBy("dk").agg(F.collect_set(F.struct("start", "length")).alias("spans")).select("dk", covered.cast("long").alias("n_hit"))
    found = hits.select("dk", "wid").distinct().join(windows.select("wid", "item_id").distinct(), "wid").select("dk", "item_id").distinct()
    items = found.groupBy("dk").agg(F.sort_array(F.collect_set("item_id")).alias("ids")).select("dk", F.size("ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"))
    marked = written(per_doc.join(items, "dk").select(F.col("dk").alias("hit_key"), "n_hit", "n_items", "items_sha256"), "marked")
    counted = documents.select(plain(id_col).alias("doc_id"), row_key(id_col, text_col).alias("row_key"), F.size(_words(plain(text_col))).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return counted.join(sided(marked, 192, broadcast_bytes), F.col("row_key") == F.col("hit_key"), "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"), "row_key",
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with their columns; only the keys of contaminated ones are shuffled against them."""
    key = fresh(documents, "row_key")
    bad = written(contamination(documents, benchmark, id_col, text_col, **options).where("contaminated").select(F.col("row_key").alias(key)).distinct(), "contaminated")
    return documents.withColumn(key, row_key(id_col, text_col)).join(sided(bad, 64), key, "left_anti").select(*[plain(c) for c in documents.columns])
