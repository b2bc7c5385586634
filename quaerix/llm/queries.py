"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaerix.llm import embedding_dedup, exact_dedup, langid, mixing, near_dedup, packing, quality, quotes, secrets, warc
from quaerix.llm.common import materialize, table
from quaerix.session import ship

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_string_kernel_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.predict(docs, langid.fit(docs))


def op2_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op3_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op4_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op5_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The messages are made by two joins, and read several times.
    return quotes.link_quotes(materialize(quotes.quoted_replies(table(spark, sf_dir, "conversations")), "messages"))


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY)


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve_revisits(warc.page_records(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    pair = F.transform(F.array_sort(F.map_entries("merged_headers")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.withColumn("merged_headers", F.when(F.col("merged_headers").isNotNull(), F.concat_ws(";", pair)))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan(docs, secrets.fit(docs))


def _shipped(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return functools.wraps(f)(lambda spark, sf_dir: f(ship(spark), sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _shipped(f)
    for f in (
        op1_string_kernel_langid, op2_subword_quality, op3_setsketch_dedup, op4_itq_dedup, op5_quote_links,
        op6_harmonic_packing, op7_warc_revisits, op8_exact_dedup, op9_entropy_mix, op10_secret_scan,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_setsketch_dedup": near_dedup.ORACLE, "op4_itq_dedup": embedding_dedup.ORACLE, "op5_quote_links": quotes.ORACLE, "op7_warc_revisits": warc.ORACLE, "op8_exact_dedup": exact_dedup.ORACLE,
}
