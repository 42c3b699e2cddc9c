"""Context blocks, prompts, token budget, stream frames and model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import rules as R
from ..functions.text import contains_any, estimate_tokens, title_label


def context_block(rank: Column, doc_id: Column, heading: Column, kind: Column, summary: Column, entities: Column,
                  topics: Column, content: Column) -> Column:
    """One numbered document of the context."""
    blank = F.lit("")
    return F.concat(
        F.lit("Document "), rank.cast("string"), F.lit(': "'), doc_id.cast("string"), F.lit('"'),
        F.when(F.coalesce(heading, blank) != "", F.concat(F.lit(" - "), heading)).otherwise(""),
        F.lit("\nType: "), title_label(kind),
        F.when(F.coalesce(summary, blank) != "", F.concat(F.lit(" - "), summary)).otherwise(""),
        F.when(F.size(entities) > 0, F.concat(F.lit("\nKey entities: "), F.array_join(F.slice(entities, 1, 3), ", "))).otherwise(""),
        F.when(F.size(topics) > 0, F.concat(F.lit("\nTopics: "), F.array_join(topics, ", "))).otherwise(""),
        F.lit("\nContent: "), content,
    )


def build_prompt(blocks: DataFrame, queries: DataFrame, plain: bool = False) -> DataFrame:
    """Prompt per query from its ranked blocks: query_id, prompt.

    ``blocks`` has query_id, rank and block. The lists are the few results of a
    query. ``plain`` joins the blocks by blank lines only.
    """
    joined = blocks.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("parts")).select(
        "query_id", F.array_join(F.transform("parts", lambda p: p["block"]), "\n\n").alias("body"))
    out = queries.select("query_id", "query_text").join(joined, "query_id", "left")
    if plain:
        return out.select("query_id", F.coalesce("body", F.lit("")).alias("prompt"))
    context = F.when(F.col("body").isNotNull(), F.concat(F.lit(R.CONTEXT_INTRO + "\n\n"), F.col("body"), F.lit("\n\n"))).otherwise("")
    return out.select("query_id", F.concat(context, F.lit("\nUser question: "), F.col("query_text"), F.lit("\n\n" + R.ANSWER_RULE)).alias("prompt"))


def budget_context(blocks: DataFrame, budget: Column | int) -> DataFrame:
    """The leading blocks whose tokens fit the budget; the first that does not ends the list."""
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    order = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        blocks.withColumn("tokens", estimate_tokens(F.col("block")))
        .withColumn("tokens_so_far", F.sum("tokens").over(order))
        .filter(F.col("tokens_so_far") <= budget)
    )


def trim_prompt(prompt: Column, max_tokens: int) -> Column:
    """The prompt, cut to the budget in characters where no blocks are known."""
    return F.when(estimate_tokens(prompt) <= max_tokens, prompt).otherwise(F.substring(prompt, 1, max_tokens * 4))


def optimize_prompt(blocks: DataFrame, queries: DataFrame, max_tokens: int = 4000) -> DataFrame:
    """The prompt with the leading blocks that fit beside question and instruction; all of them where they fit.

    Introduction and separators count too, so the prompt keeps the budget. Where
    question and instruction alone exceed it, they are cut in characters.
    """
    around = len(R.CONTEXT_INTRO) + len("\n\n\nUser question: \n\n") + len(R.ANSWER_RULE)
    order = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    so_far = F.sum(F.length("block") + 2).over(order)
    asked = queries.select("query_id", (F.length("query_text") + around).alias("_around"))
    fitting = blocks.join(asked, "query_id").withColumn("_chars", so_far + F.col("_around")).filter(F.col("_chars") < 4 * (max_tokens + 1))
    short = build_prompt(fitting.drop("_around", "_chars"), queries)
    return short.select("query_id", trim_prompt(F.col("prompt"), max_tokens).alias("prompt"))


def cache_minimum(model_id: Column) -> Column:
    """Tokens a prompt needs before the model caches it."""
    return F.when(model_id.startswith("amazon.nova"), 1000).when(model_id.contains("claude-3-5-haiku"), 2048).otherwise(1024)


def rag_prompt_flags(df: DataFrame, prompt: str, model_id: str) -> DataFrame:
    """Add is_rag, meets_minimum, model_caches and cache_worthy."""
    p, m = F.col(prompt), F.col(model_id)
    return (
        df.withColumn("is_rag", contains_any(p, R.RAG_INDICATORS))
        .withColumn("meets_minimum", estimate_tokens(p) >= cache_minimum(m))
        .withColumn("model_caches", m.isin(R.CACHE_MODELS))
        .withColumn("cache_worthy", F.col("is_rag") & F.col("meets_minimum") & F.col("model_caches"))
    )


def assemble_frames(frames: DataFrame) -> DataFrame:
    """Text per connection from its chunk frames, checked against the end frame.

    A connection's frames add up to one answer, which bounds the list.
    """
    chunk = F.when(F.col("type") == "chunk", F.struct("seq", "text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(chunk)), lambda c: c["text"]), "")
    out = frames.groupBy("connection_id").agg(
        joined.alias("text"),
        F.count(chunk).alias("chunks"),
        F.max(F.when(F.col("type") == "end", F.col("text"))).alias("end_text"),
        F.bool_or(F.col("type") == "end").alias("complete"),
        F.bool_or(F.col("type") == "error").alias("failed"),
    )
    return out.withColumn("matches_end", F.coalesce(F.col("text") == F.col("end_text"), F.lit(False)))


def model_family(model_id: Column) -> Column:
    return (
        F.when(model_id.contains("nova"), "nova").when(model_id.contains("anthropic"), "anthropic")
        .when(model_id.contains("ai21"), "ai21").when(model_id.contains("meta"), "meta")
    )


def extract_completion(body: Column, model_id: Column, delta: bool = False) -> Column:
    """Answer text from a model's JSON body, for whole answers or stream deltas."""
    family = model_family(model_id)
    paths = {
        "nova": "$.contentBlockDelta.delta.text" if delta else "$.output.message.content[0].text",
        "anthropic": "$.completion",
        "ai21": "$.choices[0].delta.content" if delta else "$.choices[0].message.content",
        "meta": "$.generation",
    }
    out = None
    for name, path in paths.items():
        got = F.get_json_object(body, path)
        out = F.when(family == name, got) if out is None else out.when(family == name, got)
    return F.when(family.isNotNull(), F.coalesce(out, F.lit("")))
