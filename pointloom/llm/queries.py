"""The queries of this subpackage, one per operator, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, divergence, filters, hmm, jaccard, licenses, packing, quality, tokenscan, urls, warc
from .frames import table
from .oracle import ORACLE  # noqa: F401


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents")))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.link_edges(pages).unionByName(urls.variant_edges(pages)))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-7, i, r, "\\### Assistant: </turn> ok") for i, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digest(chat.format_paths(chat.linear_tree(rows)))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenscan.document_counts(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encode(table(spark, sf_dir, "documents")))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# Aliases that decide: the given pages name no other page, so their addresses are given tags of every kind.


def linked_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, html: pages with a redirect or canonical tag, by eight kinds of page.

    A redirect to the next page's address, a page for each host, a hub by a target without a
    scheme, a query alone, a place below and one beside the page's folder, a hub for each
    top-level domain by an attribute without quotes, and no tag.
    """
    after = pages.groupBy((F.col("page_id") - 1).alias("page_id")).agg(F.min("url").alias("next_url"))
    host = F.regexp_extract(F.substring_index("url", "://", -1), r"^([^/?#]*)", 1)
    domain = F.lower(F.regexp_extract(host, r"([^.]*)$", 1))
    tags = [
        F.concat(F.lit('<meta http-equiv="refresh" content="0; url='), F.replace("next_url", F.lit("&"), F.lit("&amp;")), F.lit('">')),
        F.lit('<link rel="canonical" href="/hub/index.html">'),
        F.lit('<LINK href="//www.example.com/en/start" rel="canonical">'),
        F.lit("<link rel='canonical' href='?print=1&#38;all=2'>"),
        F.lit("<meta content='1;url=sub/page.html' http-equiv='refresh'>"),
        F.lit('<link rel="alternate canonical" href="../es/list.html#part">'),
        F.concat(F.lit("<p>to</p><link rel=canonical href=http://news.example.net/es/"), domain, F.lit(">")),
        F.lit("<p>no tag</p>"),
    ]
    kind = F.pmod(F.col("page_id"), F.lit(len(tags)))
    html = F.coalesce(*(F.when(kind == i, F.concat(F.lit("<html><head>"), t, F.lit("</head></html>"))) for i, t in enumerate(tags)), F.lit(""))
    return pages.select("page_id", "url").join(after, "page_id", "left").select("page_id", "url", html.alias("html"))


def url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = linked_pages(table(spark, sf_dir, "pages"))
    return urls.judge(pages, urls.link_edges(pages))


# What SQL can express of op1, op5 and op10, whose own rows hold hashes or a model's scores.


def base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def unigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = F.floor(F.col("base_score") * 10000 + 0.5) / 10000
    return op5_language_model(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", rounded.alias("base_score"))


def license_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_license_scans(spark, sf_dir).select("doc_id", "license").distinct()


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_packing": op3_packing,
    "op4_url_filters": op4_url_filters,
    "op5_language_model": op5_language_model,
    "op6_warc": op6_warc,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_token_counts": op8_token_counts,
    "op9_decontamination": op9_decontamination,
    "op10_license_scans": op10_license_scans,
    "op11_source_divergence": op11_source_divergence,
    "op12_bpe_encoding": op12_bpe_encoding,
    "op13_filter_interactions": op13_filter_interactions,
    "url_aliases": url_aliases,
    "base_rules": base_rules,
    "unigram_scores": unigram_scores,
    "license_hits": license_hits,
}
