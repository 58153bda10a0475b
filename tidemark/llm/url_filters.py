"""URL filters: host-and-path rules looked up through a blocked Bloom filter, then joined exactly.

A rule is a canonical key ``host + path`` with a verdict. It fits its host and all subdomains if the url's path starts
with the rule's path; the longest fitting rule wins (then the longer host). A url that no rule fits gets the default
verdict. Every distinct url gives its candidate keys (host suffixes at label borders x path prefixes of the lengths
that rules have). The keys probe a Bloom filter whose bits for one key all lie in one block of ``WORDS`` longs; those
that pass go to an exact equi-join with the rules, which removes false positives.

Scale: the filter is a table of blocks. It has at most ``max_blocks`` rows (64 bytes each), and its size is known from
the number of rules before anything is sent: up to ``broadcast_bytes`` it is broadcast, beyond that the same join
shuffles. The exact join is broadcast under the same test. Urls are made distinct before the lookup, so a url or host
that holds a third of all rows is judged once; the join back is a left outer equi-join that AQE may split.

Null urls and urls without ``://`` have empty host and path and get the default verdict; repeated rows stay repeated;
empty tables (of pages or rules) work; only ``page_id`` and ``url`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
PROBES = 6
BITS_PER_KEY = 16


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


def _bits(key: Column) -> Column:
    """PROBES positions within a block, from a second hash."""
    other = F.xxhash64(F.lit("bits"), key)
    return F.array(*[F.shiftrightunsigned(other, 9 * i).bitwiseAND(F.lit(WORDS * 64 - 1)).cast("int") for i in range(PROBES)])


def blocked_filter(keys: DataFrame, n_blocks: int) -> DataFrame:
    """``keys`` (key) to the non-empty blocks: block, word_0 .. word_7."""
    bit = keys.select(_block(F.col("key"), n_blocks).alias("block"), F.explode(_bits(F.col("key"))).alias("bit"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit") % 64)
    return bit.groupBy("block").agg(*[F.bit_or(F.when(F.floor(F.col("bit") / 64) == i, mask).otherwise(F.lit(0).cast("long"))).alias(f"word_{i}") for i in range(WORDS)])


def _may_hold(key: Column) -> Column:
    words = F.array(*[F.col(f"word_{i}") for i in range(WORDS)])
    one = F.lit(1).cast("long")
    return F.forall(_bits(key), lambda b: F.getbit(F.get(words, F.floor(b / 64).cast("int")), b % 64) == one.cast("tinyint"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", max_blocks: int = 1 << 20, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """``pages`` (page_id, url) under ``rules`` (host, path, verdict): page_id, url, host, path, rule, verdict."""
    clean = rules.select(F.coalesce("host", F.lit("")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    listed = clean.groupBy("rule_host", "rule_path").agg(F.min("rule_verdict").alias("rule_verdict")).withColumn("key", F.concat("rule_host", F.lit("\n"), "rule_path"))
    # Bounded: one row with the number of rules and the distinct lengths of their paths.
    known = listed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("key") + 32), F.lit(0)).alias("size"), F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths")).first()
    n_blocks = max(1, min(max_blocks, -(-known["n"] * BITS_PER_KEY // (WORDS * 64))))
    small = lambda df, size: F.broadcast(df) if size <= broadcast_bytes else df

    urls = pages.select("url").where(F.col("url").isNotNull()).distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in known["lengths"]] or [F.lit(None).cast("string")]
    key = (
        urls.select("url", F.explode(suffixes).alias("suffix"), "path")
        .select("url", "suffix", F.explode(F.array_compact(F.array(*prefixes))).alias("prefix"))
        .select("url", F.concat("suffix", F.lit("\n"), "prefix").alias("key"))
        .withColumn("block", _block(F.col("key"), n_blocks))
    )
    possible = key.join(small(blocked_filter(listed, n_blocks), n_blocks * WORDS * 8), "block").where(_may_hold(F.col("key"))).select("url", "key")
    order = F.struct((F.length("rule_host") + F.length("rule_path")).alias("a"), F.length("rule_host").alias("b"))
    found = possible.join(small(listed, known["size"]), "key").groupBy("url").agg(F.max_by(F.struct("rule_host", "rule_path", "rule_verdict"), order).alias("best"))
    page = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return page.join(found, "url", "left").select(
        "page_id", "url", "host", "path",
        F.concat("best.rule_host", "best.rule_path").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
    )
