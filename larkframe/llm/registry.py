"""The training-data queries, one for each operator and the search of op7, each over its whole intended table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkframe.llm import chat, counts, dedup, langid, lm, mixing, packing, simhash, topk, urls
from larkframe.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "finish")


def op2_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.classes(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.recounted(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def near_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_mixing": op1_mixing,
        "op2_dedup": op2_dedup,
        "op3_packing": op3_packing,
        "op4_topk": op4_topk,
        "op5_urls": op5_urls,
        "op6_counts": op6_counts,
        "op7_simhash": op7_simhash,
        "near_fingerprints": near_fingerprints,
        "op8_chat": op8_chat,
        "op9_lm": op9_lm,
        "op10_langid": op10_langid,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_topk": topk.SQL, "op8_chat": chat.SQL}
