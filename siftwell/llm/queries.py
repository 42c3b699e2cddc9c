"""Registered queries of the training-data operators, each over its whole table, with SQL twins where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import (
    chat, cotrain, decontaminate, html_lines, importance, merkle, packing, quality, rank_merge, sharding, simhash, token_orc, topk,
)
from .common import VOCABULARY, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op1_benchmark_copies", decontaminate.SQL)
def benchmark_copies(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("distance")


@query("op2_line_quality", quality.SQL)
def line_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents")).drop("clean_text")


@query("op3_line_blocks")
def line_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return html_lines.main_text(table(spark, folder, "pages"))


@query("op4_simhash_components")
def simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op5_interleaved_shards", sharding.SQL)
def interleaved_shards(spark: SparkSession, folder: str) -> DataFrame:
    rows = sharding.interleave(table(spark, folder, "documents"))
    return rows.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


@query("op6_co_training")
def co_training(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return cotrain.score(docs, cotrain.train(docs, table(spark, folder, "labels")))


@query("op7_chat_segments", chat.SQL)
def chat_segments(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], turns.schema)
    return chat.digests(chat.format_turns(turns.unionByName(extra)))


@query("op8_token_orc")
def token_ids(spark: SparkSession, folder: str) -> DataFrame:
    to = scratch_path(spark, "token_ids")
    token_orc.write_ids(table(spark, folder, "documents"), VOCABULARY, to)
    return token_orc.digests(token_orc.read_ids(spark, to))


@query("op9_best_fit")
def best_fit(spark: SparkSession, folder: str) -> DataFrame:
    sizes = packing.with_sizes(table(spark, folder, "documents"))
    return packing.best_fit(simhash.settled(sizes, "sizes"))


@query("op10_token_counts")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return rank_merge.token_counts(table(spark, folder, "documents"), VOCABULARY)


@query("op11_merkle_manifest", merkle.SQL)
def merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.digests(table(spark, folder, "documents"))


@query("op12_sorted_lists", topk.SQL)
def sorted_lists(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"))


@query("op13_importance_draw", importance.SQL)
def importance_draw(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
