"""URL filter: rules first, then a blocked Bloom filter in front of an exact join.

``filter_urls`` judges each url.  The longest rule that fits the host (or a parent domain) and the
start of the path decides.  Other urls are put to the listed canonical urls: a split-block Bloom
filter (eight 32-bit lanes per block, one bit per lane and key) passes possible hits only, and an
exact join on the canonical url removes the false positives, so the verdict is exact.

The filter is a table with one row per block, built by one ``bit_or`` aggregate.  It is broadcast
only while its size, known from the count of listed urls, is within ``broadcast_bytes``; beyond
that the probe is a join on the block number.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and
is never listed (verdict ``allow``); listed nulls are ignored; repeated urls are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import all_of, ascii_lower

LANES = 8
BITS_PER_KEY = 16
BLOCK_BITS = 32 * LANES


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without a final ``/``, and the query without tracking parameters."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|ref)(=|$)")))
    return F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), r"/+$", ""),
                    F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def rule_fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def _masks(key: Column) -> list[Column]:
    """One 32-bit lane mask per lane, from five bits of a second hash each."""
    h = F.xxhash64(key, F.lit(0x5B1F))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), (F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(31))).cast("int"))
            for i in range(LANES)]


def bloom_blocks(listed: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """One row per used block: ``_block`` and its eight lanes."""
    masks = [m.alias(f"_m{i}") for i, m in enumerate(_masks(F.col(key)))]
    return (listed.select(F.pmod(F.xxhash64(key), F.lit(n_blocks)).alias("_block"), *masks)
            .groupBy("_block").agg(*[F.bit_or(f"_m{i}").alias(f"_l{i}") for i in range(LANES)]))


def filter_urls(urls: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id",
                url_col: str = "url", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(id, url) -> id, host, path, rule, verdict, bloom_hit.

    ``listed`` has one column ``canonical``; ``rules`` are (``host``, ``path``, verdict) triples.
    """
    listed = listed.select(F.col("canonical").alias("_listed")).where(F.col("_listed").isNotNull()).distinct()
    n_blocks = max(1, -(-listed.count() * BITS_PER_KEY // BLOCK_BITS))
    blocks = bloom_blocks(listed, "_listed", n_blocks)
    if n_blocks * 8 * (LANES + 1) <= broadcast_bytes:
        blocks = F.broadcast(blocks)
    u = F.col(url_col)
    fits = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for host, path, say in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):  # the longest is tested first
        hit = rule_fits(F.col("host"), F.col("path"), host, path)
        fits, verdict = F.when(hit, host + path).otherwise(fits), F.when(hit, say).otherwise(verdict)
    judged = (urls.select(F.col(id_col).alias(id_col), host_of(u).alias("host"), path_of(u).alias("path"), canonical(u).alias("_canon"))
              .withColumns({"rule": fits, "_verdict": verdict, "_block": F.pmod(F.xxhash64("_canon"), F.lit(n_blocks))}))
    probe = all_of(F.col(f"_l{i}").bitwiseAND(m) == m for i, m in enumerate(_masks(F.col("_canon"))))
    probed = judged.join(blocks, "_block", "left").withColumn("bloom_hit", F.coalesce(probe, F.lit(False)) & (F.col("host") != ""))
    out = [id_col, "host", "path", "rule"]
    rest = probed.where(~F.col("bloom_hit")).select(*out, F.coalesce("_verdict", F.lit("allow")).alias("verdict"), "bloom_hit")
    hits = (probed.where("bloom_hit").join(listed, F.col("_canon") == F.col("_listed"), "left")
            .select(*out, F.coalesce("_verdict", F.when(F.col("_listed").isNotNull(), "block").otherwise("allow")).alias("verdict"), "bloom_hit"))
    return rest.unionByName(hits)
