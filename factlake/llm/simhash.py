"""Near-duplicates by 64-bit SimHash, pigeonhole blocks and verified Hamming distances.

Fingerprints are those of word shingles. Only distinct fingerprints are compared, so copies
cost nothing. They are split into `blocks` blocks; two within `distance` bits agree on at least
blocks - distance of them, so each fingerprint is dealt once for every such choice of blocks
and meets its partners under at least one common key. Keys with one member end there. Keys
with up to BUCKET members are compared in one place; larger ones are cut into chunks and every
two chunks meet in a task of their own, so that no group, however large, is gathered. Within
a chunk pair a spanning forest of the links is returned, not all pairs: it has the same
components, and rows stay in proportion to members.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any
other; texts with fewer words than a shingle are one shingle; rows with equal ids are separate
rows of one component; a null id has its group's component (null if all its ids are null); an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, plain, row_key, sided, written
from .components import connected_components

SEED = 42
#: Members of a key that are compared in one place; beyond, chunks of this size meet pair by pair.
BUCKET = 2048
#: Keys with at most so many members return each verified pair.
_SMALL = 24


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash over XXH64 of the shingles; a bit is set if it is in over half of the hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-shingle] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[i : i + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def with_fingerprint(df: DataFrame, text_col: str = "text", to: str = "fingerprint", shingle: int = 4) -> DataFrame:
    """df with a long column of fingerprints (two's complement)."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return df.withColumn(to, run(plain(text_col)))


def _block_masks(blocks: int, distance: int) -> list[int]:
    """A bit mask for every choice of blocks - distance blocks out of blocks of nearly equal width."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    widths = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(widths, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, side: np.ndarray, distance: int, within: bool) -> list[tuple[int, int]]:
    """Links that span the components of fps. If not within, only links between the two sides count."""
    left, out = np.arange(len(fps)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[i]) <= distance
            if not within:
                near &= side[left] != side[i]
            out += [(i, j) for j in left[near]]
            queue += list(left[near])
            left = left[~near]
    return out


def _links(distance: int):
    def of(keys: np.ndarray, fps: np.ndarray, side: np.ndarray, within: np.ndarray) -> pd.DataFrame:
        """Rows sorted by key, whole keys only."""
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, int)
        sizes = np.diff(np.append(starts, len(keys)))
        us, vs = [], []
        size_of = np.repeat(sizes, sizes)
        for s in range(1, int(min(_SMALL, sizes.max(initial=0)))):
            a = np.flatnonzero((keys[:-s] == keys[s:]) & (size_of[:-s] <= _SMALL))
            a = a[(np.bitwise_count(fps[a] ^ fps[a + s]) <= distance) & (within[a] | (side[a] != side[a + s]))]
            us.append(fps[a])
            vs.append(fps[a + s])
        for k in np.flatnonzero(sizes > _SMALL):
            g = slice(starts[k], starts[k] + sizes[k])
            pairs = np.array(_forest(fps[g], side[g], distance, bool(within[starts[k]])), int).reshape(-1, 2)
            us.append(fps[g][pairs[:, 0]])
            vs.append(fps[g][pairs[:, 1]])
        u, v = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (us, vs))
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)}).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by key; a batch's last key waits for the next batch."""
        rest = None
        for batch in batches:
            b = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = b["key"].iloc[-1] if len(b) else None
            whole = b["key"] != last
            rest = b[~whole]
            if whole.any():
                w = b[whole]
                yield of(w["key"].to_numpy(), w["fp"].to_numpy().view(np.uint64), w["side"].to_numpy(), w["within"].to_numpy())
        if rest is not None and len(rest):
            yield of(rest["key"].to_numpy(), rest["fp"].to_numpy().view(np.uint64), rest["side"].to_numpy(), rest["within"].to_numpy())

    return run


def fingerprint_links(fps: DataFrame, distance: int = 4, blocks: int = 6, bucket: int = BUCKET) -> DataFrame:
    """fps: fp, distinct. Links (u, v) between fingerprints within distance; they span every component."""
    masks = F.array(*[F.lit(_signed(m)) for m in _block_masks(blocks, distance)])
    keyed = fps.select("fp", F.posexplode(masks).alias("choice", "mask")).select("fp", F.xxhash64("choice", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    # written, so that the join reads both sides as they were dealt and a hot key's rows can be split
    sizes = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "keysizes")
    met = keyed.join(sizes, "key").withColumn("chunks", F.ceil(F.col("n") / bucket)).withColumn("chunk", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")))
    # a chunk goes to the pair (smaller, larger) with each chunk, itself included
    dealt = (
        met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other"))
        .select(F.when(F.col("chunks") == 1, F.col("key")).otherwise(F.xxhash64("key", "low", "high")).alias("key"), "fp", (F.col("chunk") == F.col("high")).alias("side"), (F.col("low") == F.col("high")).alias("within"))
    )
    return dealt.repartition("key").sortWithinPartitions("key").mapInPandas(_links(distance), "u long, v long").distinct()


def fingerprint_roots(fps: DataFrame, distance: int = 4, blocks: int = 6, bucket: int = BUCKET) -> DataFrame:
    """fp, root for the fingerprints that have a link; root numbers the component."""
    return connected_components(fingerprint_links(fps, distance, blocks, bucket)).select(F.col("node").alias("fp"), "root")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, blocks: int = 6, bucket: int = BUCKET) -> DataFrame:
    """A row per document: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable), root (the component), row_key."""
    texts = df.select(plain(id_col).alias("doc_id"), plain(text_col).alias("text"))
    rows = written(with_fingerprint(texts, "text", "fp", shingle).select("doc_id", "fp", row_key("doc_id", "text").alias("row_key")), "fingerprints")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = written(fingerprint_roots(fps.select("fp"), distance, blocks, bucket), "roots")
    rooted = fps.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    # written, so that the join reads both sides as they were dealt and a large component's rows can be split
    smallest = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    found = rooted.join(smallest, "root").select("fp", "root", "component_id")
    return rows.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", "row_key")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df with one document of each group: the one with the smallest id, a null id last; of repeated rows one.

    Only the keys of rows that go are held against df; texts are not shuffled while those keys fit a broadcast.
    """
    groups = near_duplicates(df, id_col, text_col, **options)
    keys = written(groups.groupBy("root", "row_key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")), "keys")
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_key"))
    kept = written(keys.groupBy("root").agg(F.min(first)["row_key"].alias("kept")), "keptkeys")
    key = fresh(df, "row_key")
    marked = keys.join(kept, "root").select(F.col("row_key").alias(key), (F.col("row_key") == F.col("kept")).alias("stays"), "n").where("not stays or n > 1")
    gone = written(marked, "gone")  # repeated rows go too, and one of each comes back
    keyed = df.withColumn(key, row_key(id_col, text_col))
    rest = keyed.join(sided(gone.select(key), 64), key, "left_anti")
    one = keyed.join(sided(gone.where("stays").select(key), 64), key, "left_semi").dropDuplicates([key])
    return rest.unionByName(one).select(*[plain(c) for c in df.columns])
