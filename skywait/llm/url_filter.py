"""URL filter: host rules, then a blocked Bloom filter of listed URLs before an exact hash join.

A Bloom block is eight 64-bit words; a URL falls into one block and sets a bit in each of its
words. Blocks are built by an aggregate and tested by a broadcast join on the block's number.
What passes meets the list itself in a hash join, so no false positive is left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (action, host, path): a rule holds for its host and all subdomains where the path starts so.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Query parameters that only track where a visit came from.
TRACKING = r"^(utm_[^=]*|gclid|fbclid|ref)(=|$)"
WORDS = 8  # 64-bit words of a Bloom block
BITS_PER_URL = 16
MOST_BLOCKS = 1 << 19  # 32 MB of words: the filter never grows past it, longer lists only pass more to the exact join


def parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query) of a URL: empty texts where it is null or has no "://".

    The host is what follows the first "://" up to "/", "?", "#" or the end, A-Z in lower
    case; the path goes on to "?", "#" or the end; the query follows a "?" up to "#".
    """
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    rest = F.substr(after, F.length(host) + 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, "^[^?#]*", 0), F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)


def canonical(url: Column) -> Column:
    """One spelling of a URL's page, without scheme; null where the URL has no host.

    User name, default port, leading "www.", fragment, closing slashes and tracking parameters
    go; the other parameters are sorted. Percent codes and the path's case stay as they are.
    """
    host, path, query = parts(url)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":(80|443)?$", ""), r"^www\.", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.regexp_like(p, F.lit(TRACKING))))
    page = F.concat(host, F.regexp_replace(path, "/+$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(host != "", page)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, action) of the longest rule (host and path together) that fits, or null. No two rules may be alike."""
    texts = [h + p for _, h, p in rules]
    if len(set(texts)) < len(texts):
        raise ValueError("two rules are for the same host and path")
    fits = [
        F.when(
            ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)),
            F.struct(F.lit(len(h) + len(p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(action).alias("action")),
        )
        for action, h, p in rules
    ]
    none = F.lit(None).cast("struct<length:int,rule:string,action:string>")
    return F.greatest(none, none, *fits)


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks)).cast("long")


def _bits(url: Column) -> list[Column]:
    """The bit that a URL has in each word of its block."""
    h = F.xxhash64(F.lit(1), url)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(WORDS)]


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7): the blocks that hold a URL of listed (column canonical)."""
    url = F.col("canonical")
    keyed = listed.select(_block(url, blocks).alias("block"), *[b.alias(f"b{k}") for k, b in enumerate(_bits(url))])
    return keyed.groupBy("block").agg(*[F.bit_or(f"b{k}").alias(f"w{k}") for k in range(WORDS)])


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, bits_per_url: int = BITS_PER_URL, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, canonical, listed.

    listed has a column url (nulls and URLs without a host in it list nothing, repeats count
    once). The longest rule decides; without one, a page whose canonical URL is listed is
    blocked and any other allowed. `listed` tells of every page, whatever its rule. Null
    urls, and those without "://", have empty host and path, no canonical URL, and are
    allowed; repeated rows are judged alike; urls of any length count whole; other columns
    stay out; empty tables give an empty result, and an empty list blocks nothing.
    """
    names = settle(listed.select(canonical(F.col("url")).alias("canonical")).where("canonical is not null").distinct())
    blocks = min(most_blocks, max(1, -(-names.count() * bits_per_url // (64 * WORDS))))
    bloom = F.broadcast(bloom_blocks(names, blocks))  # at most most_blocks rows
    host, path, _ = parts(F.col("url"))
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path"), canonical(F.col("url")).alias("canonical"))
    ruled = split.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("block", _block(F.col("canonical"), blocks))
    passes = F.col("w0").isNotNull() & F.col("canonical").isNotNull()
    for k, bit in enumerate(_bits(F.col("canonical"))):
        passes = passes & (F.col(f"w{k}").bitwiseAND(bit) != 0)
    tested = settle(
        ruled.join(bloom, "block", "left").select("page_id", "host", "path", "canonical", F.col("fit.rule").alias("rule"), F.col("fit.action").alias("action"), F.coalesce(passes, F.lit(False)).alias("possible"))
    )
    exact = names.select("canonical", F.lit(True).alias("listed")).hint("shuffle_hash")
    hits = tested.where("possible").join(exact, "canonical", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    both = tested.where("not possible").withColumn("listed", F.lit(False)).unionByName(hits)
    verdict = F.coalesce("action", F.when(F.col("listed"), "block").otherwise("allow"))
    return both.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "canonical", "listed")


def pages_of_toxic_documents(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url of the pages that show a document labelled toxic: the number in a page's path is its document's."""
    _, path, _ = parts(F.col("url"))
    shown = pages.select("url", F.regexp_extract(path, "/([0-9]{1,18})(?:/|[.]|$)", 1).try_cast("bigint").alias("doc_id"))
    return shown.join(labels.where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi").select("url")
