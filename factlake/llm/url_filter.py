"""URL filters by a sort-merge range join with a stack of active nested rules.

A rule (host, path) becomes an interval of canonical keys: the host's labels reversed, a
separator, then the path; all urls under the rule at that host level lie between the key and
the key followed by the largest character. A url probes once for each suffix of its host, so
subdomains meet the rules of their parents. Distinct (host, path) pairs are probed, so a url
or host that holds a third of the rows costs no more than any other.

Keys are dealt to ranges by split keys taken from a hash sample of bounded size; a rule is
copied to every range that its interval meets. Within a range a sorted sweep pushes rules as
their intervals begin and pops them as they end; the top of the stack is the longest rule.
Memory per task: the stack, which is as deep as rules are nested, and one Arrow batch.

Defined results: a null url and one without :// have empty host and path and meet no rule; of
rules with equal host and path the blocking one counts; an empty table gives an empty result;
without rules every verdict is the default.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, plain, written

#: Follows the reversed host in a key; sorts before every character that a host label holds.
_SEPARATOR = "\x01"
#: At most so many split keys are drawn from the hash sample.
MAX_SPLITS = 4096

RULES = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("verdict", T.StringType())])


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Columns host and path of a url: the host follows the first ://, A-Z lower-cased; the path ends before ? or #."""
    at = F.locate("://", url)
    tail = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(tail, "^[^/?#]*", 0)
    path = F.regexp_extract(tail, "^[^/?#]*(/[^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def _reversed(labels):
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit(_SEPARATOR))


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (part, key, rules first): each probe gets the rule on top of the stack."""
    part, stack = None, []
    for batch in batches:
        hosts, paths, rules = [], [], []
        for p, key, rule, host, path in zip(batch["part"], batch["key"], batch["rule"], batch["host"], batch["path"], strict=True):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if rule is not None:
                if not stack or stack[-1][0] != key:
                    stack.append((key, rule))
            elif stack:
                hosts.append(host)
                paths.append(path)
                rules.append(stack[-1][1])
        yield pd.DataFrame({"host": hosts, "path": paths, "rule": rules}, dtype=object)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", partitions: int | None = None) -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict, rule_verdict.

    rules: host, path, verdict. The longest rule that fits wins: the one with most characters,
    then the longer host. partitions defaults to spark.sql.shuffle.partitions.
    """
    spark = pages.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col("url"))
    urls = pages.select(plain(id_col).alias("page_id"), plain(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    given = rules.groupBy("host", "path").agg(F.max(F.struct(F.col("verdict") == "block", "verdict"))["verdict"].alias("rule_verdict"))
    starts = given.select(F.concat(_reversed(F.split("host", "\\.")), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"))
    labels = F.split("host", "\\.")
    probes = (
        urls.where((F.col("host") != "") | (F.col("path") != "")).groupBy("host", "path").agg(F.lit(1).alias("one")).drop("one")
        .withColumn("from", F.explode(F.sequence(F.lit(1), F.size(labels))))
        .select(F.concat(_reversed(F.slice(labels, F.col("from"), F.size(labels) - F.col("from") + 1)), F.col("path")).alias("key"), "host", "path")
    )
    probes = written(probes, "probes")
    sample = [r.key for r in probes.select("key").orderBy(F.xxhash64("key"), "key").limit(min(MAX_SPLITS, 16 * n)).collect()]
    sample.sort()
    splits = sorted({sample[i * len(sample) // n] for i in range(1, n)}) if sample else []
    of = F.udf(lambda key: bisect.bisect_right(splits, key), "int")  # rules only
    to = F.pandas_udf(lambda keys: pd.Series([bisect.bisect_right(splits, k) for k in keys], dtype="int32"), "int")
    dealt = probes.select(to("key").alias("part"), "key", F.lit(None).cast("string").alias("rule"), "host", "path")
    copied = starts.withColumn("part", F.explode(F.sequence(of("key"), of(F.concat("key", F.lit("\U0010ffff")))))).select(
        "part", "key", "rule", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path")
    )
    sorted_ = dealt.unionByName(copied).repartition(n, "part").sortWithinPartitions("part", "key", F.col("rule").isNull())
    met = sorted_.mapInPandas(_sweep, "host string, path string, rule string")
    longest = met.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), F.instr("rule", "/").alias("host_n"), F.col("rule")))["rule"].alias("rule"))
    verdicts = longest.join(given.select(F.concat("host", "path").alias("rule"), "rule_verdict"), "rule")
    return urls.join(verdicts, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"), "rule_verdict"
    )
