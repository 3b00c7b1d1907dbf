"""The queries of this package over the driver tables, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loci.llm import bpe, conversation_trie, html_extract, language_id, mixing, order_minhash, packing, quality_rules, resampling, simhash, site_quality, substring_dedup, url_filter
from loci.llm.common import prepare, table

TOKENIZER = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(prepare(spark), folder)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


@query
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents"))


@query
def op2_pack_documents(spark: SparkSession, folder: str) -> DataFrame:
    return packing.digested(packing.packed(table(spark, folder, "documents"), tokenizer_path()))


@query
def op3_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extracted(table(spark, folder, "pages"))


@query
def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judged(table(spark, folder, "pages"))


@query
def op5_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(table(spark, folder, "documents"))


SQL["op5_mix_sources"] = mixing.SQL


@query
def op6_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.neighbours(table(spark, folder, "documents"))


@query
def op7_site_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The source is the host; its part in one language stands for a path."""
    host, path = F.col("source"), F.concat_ws("/", F.col("source"), F.col("lang"))
    return site_quality.judged(table(spark, folder, "documents"), table(spark, folder, "labels"), host, path)


@query
def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.removed(table(spark, folder, "documents"))


SQL["op8_substring_dedup"] = substring_dedup.SQL


@query
def op9_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held = language_id.held_out(F.col("doc_id"))
    training = F.col("doc_id").isNotNull() & ~held
    found = language_id.identify(docs, training)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op11_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digested(bpe.coded(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json")))


@query
def op12_resample(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


SQL["op12_resample"] = resampling.SQL


@query
def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie.shared_prefixes(table(spark, folder, "conversations"))


SQL["op13_conversation_trie"] = conversation_trie.SQL
