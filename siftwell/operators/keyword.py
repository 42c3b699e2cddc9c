"""Keyword scores over candidate sets, and their mix with similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import rules as R
from ..functions.text import let, tokens


def search_text(content: Column, heading: Column, doc_id: Column) -> Column:
    """Content, heading and document id, the empty ones left out."""
    blank = F.lit("")
    return F.concat_ws(" ", F.nullif(content, blank), F.nullif(heading, blank), F.nullif(doc_id.cast("string"), blank))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Term counts: key, term, tf. Combined before the shuffle, so a hot term costs one row per task and text."""
    return docs.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def term_stats(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Texts per term: term, df. Distinct terms are taken inside each text row, so one count remains."""
    return docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("df"))


def corpus_stats(docs: DataFrame, text: str) -> DataFrame:
    """One row: total_docs, total_tokens, avg_length."""
    size = F.size(tokens(F.col(text)))
    return docs.agg(
        F.count(F.lit(1)).alias("total_docs"), F.sum(size).alias("total_tokens"), F.avg(size).alias("avg_length"))


def add_bm25(candidates: DataFrame, text: Column, query_text: Column, k1: float = R.BM25_K1, b: float = R.BM25_B,
             running: bool = False) -> DataFrame:
    """Add bm25 and has_terms to candidate rows (query_id, rank, ...).

    Statistics come from the query's own candidates: all of them, or with
    ``running`` those ranked so far. Candidate lists are short by construction
    (50 at most), so one window per query holds the matched terms of the list;
    nothing is joined or exploded, and the rows stay where the ranking put them.
    """
    wanted = F.array_distinct(F.col("_asked"))
    rows = candidates.withColumns({"_asked": tokens(query_text), "_tokens": tokens(text)})
    rows = rows.withColumns({
        "_length": F.size("_tokens"),
        "_found": let(wanted, lambda q: F.filter("_tokens", lambda w: F.array_contains(q, w))),
    }).drop("_tokens")
    count = lambda words, word: F.size(F.filter(words, lambda w: w == word))
    rows = rows.withColumn("_terms", F.transform(F.array_distinct("_found"), lambda w: F.struct(
        w.alias("term"), count("_asked", w).alias("uses"), count("_found", w).alias("tf"))))
    frame = W.partitionBy("query_id")
    if running:
        frame = frame.orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({
        "_docs": F.count(F.lit(1)).over(frame),
        "_mean": F.avg("_length").over(frame),
        "_seen": F.flatten(F.collect_list(F.transform("_terms", lambda t: t["term"])).over(frame)),
    })
    base = k1 * (1 - b + b * (F.col("_length") / F.col("_mean")))

    def part(t):
        df = count("_seen", t["term"])
        weight = lambda n: F.log((F.col("_docs") - n + 0.5) / (n + 0.5))
        return t["uses"] * let(df, weight) * (t["tf"] * (k1 + 1)) / (t["tf"] + base)

    raw = F.aggregate("_terms", F.lit(0.0), lambda acc, t: acc + part(t))
    return rows.withColumns({"bm25": F.greatest(F.lit(0.0), raw), "has_terms": F.size("_asked") > 0}).drop(
        "_asked", "_length", "_found", "_terms", "_docs", "_mean", "_seen")


def bm25(candidates: DataFrame, queries: DataFrame, **kwargs) -> DataFrame:
    """Keyword score per candidate (query_id, key, rank, text): query_id, key, bm25."""
    rows = candidates.join(queries.select("query_id", "query_text"), "query_id")
    return add_bm25(rows, F.col("text"), F.col("query_text"), **kwargs).select("query_id", "key", "bm25")


def weights(semantic: float, keyword: float) -> tuple[float, float]:
    """Weights that sum to 1; the defaults where they have no positive sum."""
    total = semantic + keyword
    return (semantic / total, keyword / total) if total > 0 else (R.SEMANTIC_WEIGHT, R.KEYWORD_WEIGHT)


def hybrid_pool(limit: Column | int, pool: int = R.HYBRID_POOL) -> Column:
    """How many candidates a hybrid search reads for a wanted number of results: three times it, ``pool`` at most, but never fewer than it."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    return F.greatest(limit, F.least(limit * R.HYBRID_EXPANSION, F.lit(pool)))


def hybrid_scores(hits: DataFrame, semantic: float = R.SEMANTIC_WEIGHT, keyword: float = R.KEYWORD_WEIGHT,
                  running: bool = False, digits: int = 9) -> DataFrame:
    """Add keyword_score and hybrid_score; both null for a query without any term.

    ``hits`` has query_id, query_text, key, similarity, rank, content, heading, doc_id.
    """
    w_s, w_k = weights(semantic, keyword)
    text = search_text(F.col("content"), F.col("heading"), F.col("doc_id"))
    out = add_bm25(hits, text, F.col("query_text"), running=running)
    kw = F.when(F.col("has_terms"), F.least(F.lit(1.0), F.col("bm25") / 10.0))
    return out.withColumn("keyword_score", kw).withColumn(
        "hybrid_score", F.round(F.col("similarity") * w_s + F.col("keyword_score") * w_k, digits)
    ).drop("bm25")


def hybrid_search(hits: DataFrame, queries: DataFrame, limit: int, **kwargs) -> DataFrame:
    """Hybrid order per query; a query without terms keeps its similarity order."""
    named = hits if "query_text" in hits.columns else hits.join(queries.select("query_id", "query_text"), "query_id")
    scored = hybrid_scores(named, **kwargs)
    order = W.partitionBy("query_id").orderBy(F.desc_nulls_last("hybrid_score"), F.when(F.col("hybrid_score").isNull(), F.col("rank")), "key")
    return scored.withColumn("hybrid_rank", F.row_number().over(order)).filter(F.col("hybrid_rank") <= limit)
