"""Query analysis and staged retrieval for many queries at once."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import rules as R
from ..functions.text import has_proper_noun, has_word, words
from . import keyword as K, vector as V

DIGITS = 9


def analyze_query(queries: DataFrame, text: str = "query_text") -> DataFrame:
    """Add word_count, five flags, query_type and complexity."""
    q, low = F.col(text), F.lower(F.col(text))
    flagged = (
        queries.withColumn("word_count", F.size(words(q)))
        .withColumn("has_questions", q.contains("?"))
        .withColumn("has_specifics", has_word(low, R.SPECIFIC_WORDS))
        .withColumn("has_comparisons", has_word(low, R.COMPARE_WORDS))
        .withColumn("has_temporal", has_word(low, R.TEMPORAL_WORDS))
        .withColumn("has_entities", has_proper_noun(q))
    )
    kind = (
        F.when(F.col("has_specifics"), "specific").when(F.col("has_comparisons"), "comparative")
        .when(F.col("has_temporal"), "temporal").otherwise("general")
    )
    parts = {"has_questions": 0.2, "has_specifics": 0.2, "has_comparisons": 0.15, "has_temporal": 0.1, "has_entities": 0.05}
    score = (F.col("word_count") / 20.0) * 0.3
    for flag, value in parts.items():
        score = score + F.when(F.col(flag), value).otherwise(0.0)
    return flagged.withColumn("query_type", kind).withColumn("complexity", F.least(F.lit(1.0), score))


def _by_category(place: int) -> Column:
    out = None
    for name, plan in R.STAGE_PLAN.items():
        hit = F.col("category") == name
        out = F.when(hit, plan[place]) if out is None else out.when(hit, plan[place])
    return out


def stage1_plan(analyzed: DataFrame, target: int = 3) -> DataFrame:
    """Add category, stage1_threshold, stage1_limit, fallback_threshold and base_final."""
    category = F.when(F.col("complexity") > 0.7, "complex").when(F.col("complexity") > 0.4, "medium").otherwise("simple")
    plan = analyzed.withColumn("category", category)
    threshold = _by_category(0)
    comparative = F.col("query_type") == "comparative"
    specific = (F.col("query_type") == "specific") & F.col("has_entities")
    threshold = (
        F.when(comparative, F.least(threshold, F.lit(0.3))).when(specific, F.greatest(threshold, F.lit(0.4))).otherwise(threshold)
    )
    limit = _by_category(2) * target
    limit = F.when(comparative, F.greatest(limit, F.lit(target * 3))).otherwise(limit)
    final = F.when(F.col("query_type") == "specific", F.greatest(_by_category(1), F.lit(0.5))).otherwise(_by_category(1))
    return (
        plan.withColumn("stage1_threshold", threshold)
        .withColumn("stage1_limit", limit.cast("int"))
        .withColumn("fallback_threshold", F.greatest(F.lit(0.15), F.round(F.col("stage1_threshold") - 0.1, DIGITS)))
        .withColumn("base_final", final)
    )


def fallback_threshold(near: DataFrame) -> DataFrame:
    """Cut by the query's threshold, or by its lower one where nothing reaches the first.

    The nearest rows are ranked before the cut, so the retry needs no second scan.
    """
    top = F.max("similarity").over(W.partitionBy("query_id"))
    effective = F.when(top >= F.col("stage1_threshold"), F.col("stage1_threshold")).otherwise(F.col("fallback_threshold"))
    return near.withColumn("used_threshold", effective).filter(F.col("similarity") >= F.col("used_threshold"))


PLAN = ["query_id", "query_type", "has_entities", "category", "stage1_threshold", "stage1_limit",
        "fallback_threshold", "base_final"]


def most_candidates(target: int) -> int:
    """The largest stage1_limit that a plan for ``target`` results can hold."""
    return target * max(3, *(p[2] for p in R.STAGE_PLAN.values()))


def stage1_candidates(vectors: DataFrame, plan: DataFrame, use_hybrid: bool = True, target: int = 3,
                      pool: int = R.HYBRID_POOL, head=None) -> DataFrame:
    """Scored candidates per query, with per-query limit and threshold.

    One search serves all queries with the largest pool and the lowest threshold;
    both are cut back per query after it, on short lists. ``target`` is that of
    the plan; ``pool`` bounds what a hybrid search reads beyond a query's limit.
    """
    most = most_candidates(target)
    wanted = K.hybrid_pool(F.col("stage1_limit"), pool) if use_hybrid else F.col("stage1_limit")
    near, rows = V.nearest(vectors, plan, max(most, pool) if use_hybrid else most, min_score=0.15, head=head)
    near = near.join(plan.select(*PLAN), "query_id").filter(F.col("rank") <= wanted).drop("rank", "distance")
    cut = fallback_threshold(near)
    hits = V.attach_metadata(cut, vectors, rows).join(plan.select("query_id", "query_text"), "query_id")
    score = V.search_score(*[F.col(c) for c in ("similarity", "importance_score", "chunk_type", "key_entities", "topics")])
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "key")
    hits = hits.withColumn("score", F.round(score, DIGITS)).withColumn("rank", F.row_number().over(order))
    if not use_hybrid:
        return hits.filter(F.col("rank") <= F.col("stage1_limit")).withColumns(
            {"keyword_score": F.lit(None).cast("double"), "hybrid_score": F.lit(None).cast("double")})
    scored = K.hybrid_scores(hits)
    by_score = W.partitionBy("query_id").orderBy(
        F.desc_nulls_last("hybrid_score"), F.when(F.col("hybrid_score").isNull(), F.col("rank")), "key")
    return scored.withColumn("pool_rank", F.row_number().over(by_score)).filter(
        F.col("pool_rank") <= F.col("stage1_limit")).drop("pool_rank", "has_terms")


def cross_encode(query: Column, content: Column, similarity: Column, importance: Column, kind: Column, has_entities: Column) -> Column:
    """Similarity with word overlap, type and quality boosts, within [0, 1]."""
    low = F.lower(content)
    q_words = F.array_distinct(words(F.lower(query)))
    c_words = words(low)
    overlap = F.size(F.array_intersect(q_words, c_words)) / F.greatest(F.size(q_words), F.lit(1)) * 0.2
    boost = (
        F.when((kind == "specific") & has_entities & has_proper_noun(content), 0.1)
        .when((kind == "comparative") & has_word(low, R.CONTENT_COMPARE_WORDS), 0.15)
        .when((kind == "temporal") & has_word(low, R.CONTENT_TEMPORAL_WORDS), 0.1)
        .otherwise(0.0)
    )
    n = F.size(c_words)
    quality = F.when(importance > 1.2, 0.05).otherwise(0.0) + F.when(n.between(50, 300), 0.05).when(n < 20, -0.1).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), similarity + overlap + boost + quality))


def rerank(candidates: DataFrame) -> DataFrame:
    """Add rerank_score (hybrid where known, else the cross-encoder) and final_rank."""
    crossed = cross_encode(*[F.col(c) for c in ("query_text", "content", "similarity", "importance_score", "query_type", "has_entities")])
    scored = candidates.withColumn("rerank_score", F.round(F.coalesce("hybrid_score", crossed), DIGITS))
    order = W.partitionBy("query_id").orderBy(F.desc("rerank_score"), "key")
    return scored.withColumn("final_rank", F.row_number().over(order))


def final_threshold(ranked: DataFrame) -> DataFrame:
    """Add final_threshold: the base, lowered where the third result trails the first by more than 0.2."""
    order = W.partitionBy("query_id").orderBy("final_rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first, third = F.first("rerank_score").over(order), F.nth_value("rerank_score", 3).over(order)
    adaptive = F.when(third.isNotNull() & (first - third > 0.2), third + 0.05).otherwise(F.col("base_final"))
    return ranked.withColumn("final_threshold", F.least(F.col("base_final"), adaptive))


def final_results(ranked: DataFrame, target: int = 3) -> DataFrame:
    """Results over the final threshold, ``target`` at most and one at least."""
    keep = (F.col("final_rank") <= target) & (
        (F.col("rerank_score") >= F.col("final_threshold")) | (F.col("final_rank") == 1))
    return ranked.filter(keep)


def retrieve(vectors: DataFrame, queries: DataFrame, target: int = 3, multi_stage: bool = True, use_hybrid: bool = True,
             threshold: float = R.SINGLE_STAGE_THRESHOLD, pool: int = R.HYBRID_POOL) -> DataFrame:
    """Results per query. A query without text, or ``multi_stage=False``, takes the single stage.

    Queries with and without text may stand in one batch: the stages run on either
    part, and columns that the single stage does not have are null.
    """
    if not multi_stage:
        return V.similarity_search(vectors, queries, target, threshold)
    has_text = F.coalesce(F.trim(F.col("query_text")) != "", F.lit(False))
    # a small query set is fetched once for both parts; a part without queries plans no search
    both = V.gathered(V.as_asked(queries, vectors, has_text.alias("has_text")), V.QUERY_BYTES)
    told, bare = (None, None) if both is None else (both.filter(both["has_text"]), both.filter(pc.invert(both["has_text"])))
    plan = stage1_plan(analyze_query(queries.filter(has_text)), target)
    ranked = final_threshold(rerank(stage1_candidates(vectors, plan, use_hybrid, target, pool, told)))
    staged = (
        final_results(ranked, target)
        .withColumn("retrieval_stage", F.lit("multi_stage"))
        .withColumn("search_method", F.lit("hybrid" if use_hybrid else "semantic"))
    )
    if bare is not None and not bare.num_rows:
        blank = {"final_rank": "int", "score": "double", "rank": "int"}
        return staged.withColumns({c: F.lit(None).cast(kind) for c, kind in blank.items() if c not in staged.columns})
    single = V.similarity_search(vectors, queries.filter(~has_text), target, threshold, bare)
    single = single.drop("distance").withColumns(
        {"final_rank": F.col("rank"), "retrieval_stage": F.lit("single_stage"), "search_method": F.lit("semantic")})
    return staged.unionByName(single, allowMissingColumns=True)
