"""The registered queries ``opN_<name>`` with production parameters, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.driver import read_table
from . import chat, decontaminate, fingerprint, lang_id, licenses, mixing, order_minhash, prefix_trie, quality, substring_dedup, toxicity, url_filter, whitening
from .common import crc_mod, written
from .oracles import CHAT_SQL, LEAK_SQL, LICENSE_SQL, REPEAT_SQL, TRIE_SQL, URL_SQL

# The rules that the url query judges by.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Sites whose pages are listed, beside copied articles.
LISTED_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(read_table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digest(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    said = lang_id.predict_language(read_table(spark, sf_dir, "documents"), ~held_out)
    return said.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    # the list: urls of the listed sites, and urls whose article pages of other hosts carry too, but for the first page with it
    site = rf"(^|\.)({'|'.join(LISTED_SITES)})\."
    url = F.col("url")
    body = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?s)<article>(.*)</article>", 1)
    seen = written(pages.select("page_id", url_filter.host_of(url).alias("host"), url_filter.canonical(url).alias("canonical"),
                                F.when(body != "", F.md5(body)).alias("body")))
    copied = written(seen.where("body is not null").groupBy("body").agg(F.min("page_id").alias("first"), F.min("host").alias("a"), F.max("host").alias("b"))
                     .where("a <> b").select("body", "first"))
    listed = (seen.where(F.col("host").rlike(site)).select("canonical")
              .unionByName(seen.join(copied, "body").where(F.col("page_id") > F.col("first")).select("canonical")))
    return url_filter.filter_urls(pages, listed, URL_RULES).drop("bloom_hit")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    docs = read_table(spark, sf_dir, "documents")
    return (toxicity.score_toxicity(docs, read_table(spark, sf_dir, "labels"), ~held_out)
            .select("doc_id", held_out.alias("held_out"), "score", "predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    docs = read_table(spark, sf_dir, "documents")
    return (quality.score_quality(docs, read_table(spark, sf_dir, "labels"), ~held_out)
            .select("doc_id", held_out.alias("held_out"), "score", "predicted"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contained(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(read_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = written(prefix_trie.sequences(read_table(spark, sf_dir, "conversations")))
    # the stand-in input: every conversation c starts with the first h turns of conversation c - c % 20
    c, h = F.col("conv_id"), F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4)).cast("int")
    heads = own.select(c.alias("_head"), F.slice("turns", 1, 3).alias("_first"))
    rebuilt = own.join(heads, c - c % 20 == F.col("_head"), "left").select("conv_id", F.when(
        F.col("_head").isNull(), F.expr("slice(turns, 1, 0)")).otherwise(F.slice("_first", F.lit(1), h)).alias("_start"), F.slice("turns", h + 1, F.size("turns")).alias("_rest"))
    return prefix_trie.prefix_trie(rebuilt.select("conv_id", F.concat("_start", "_rest").alias("turns")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.usable(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    # the stand-in input: entries as longs
    longs = F.transform("embedding", lambda c: F.floor(F.lit(1024.0) * c.cast("double")) + F.lit(100_000))
    return whitening.whiten(rows.select("vec_id", longs.alias("x")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_near_duplicates, op2_mix_sources, op3_fingerprint, op4_chat_format, op5_language_id, op6_url_filter, op7_toxicity, op8_quality, op9_license_scan,
                              op10_decontaminate, op11_substring_dedup, op12_prefix_trie, op13_whitening)}
ORACLES: dict[str, str] = {"op4_chat_format": CHAT_SQL, "op6_url_filter": URL_SQL, "op9_license_scan": LICENSE_SQL,
                           "op10_decontaminate": LEAK_SQL, "op11_substring_dedup": REPEAT_SQL, "op12_prefix_trie": TRIE_SQL}
