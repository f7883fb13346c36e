"""Queries of the training-data operators over the whole standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm import chat, embed_dedup, html_extract, langid, lm, media, minhash, mixing, packing, sharding, spelling, url_filter, whitening
from topicloom.llm.common import cut, table
from topicloom.llm.oracles import ORACLES as ORACLES


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast(turns.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).cast(T.StringType()).alias("text"),
    )
    return chat.read_back(chat.expand(turns.unionByName(extra)))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.published_list(spark)).select("page_id", "host", "path", "rule", "verdict", "listed")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.store_texts(table(spark, sf_dir, "documents")))


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op9_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = cut(mixing.sized(docs))
    got = mixing.plan_copies(rows, size_col="size")
    return got.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "component_id", "kept")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op7: what SQL can say of it."""
    return op7_media_sniffing(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op8: what SQL can say of it."""
    return op8_virtual_slots(spark, sf_dir).select("doc_id", "size", "law")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op9: what SQL can say of it."""
    return op9_entropy_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def whitening_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op11: what SQL can say of it."""
    return op11_embedding_whitening(spark, sf_dir).select("vec_id", "component", "n", "deviation")


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op13: what SQL can say of it."""
    got = lm.score_documents(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_embedding_near_dedup,
        op3_language_id,
        op4_chat_formatting,
        op5_url_filter,
        op6_best_fit_packing,
        op7_media_sniffing,
        op8_virtual_slots,
        op9_entropy_mixing,
        op10_order_minhash,
        op11_embedding_whitening,
        op12_spelling_variants,
        op13_lm_scoring,
        media_payloads,
        shard_sizes,
        mixing_targets,
        whitening_deviations,
        lm_base_scores,
    )
}
