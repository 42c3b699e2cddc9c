"""Vector search: V1 to V11. Questions are the benchmark items; none finds itself."""

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.vectors import cosine01, metric_score, similarity_from_distance
from ..operators import cells as N, vector as V
from ..session import scratch_path
from ..sources.store import put_vectors, read_vectors
from . import shared, sqltext as S
from .registry import query

WITH = f"WITH {shared.VECTORS}, {shared.QUERY_SET}, {shared.PAIRS}"
BASE = ["key", "embedding"]
NEIGHBOURS = """n AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


def _neighbours(t):
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return t.embeddings.select("vec_id", "embedding").join(b, "vec_id")


def _keys(t):
    return t.embeddings.select(F.col("vec_id").alias("key"), "embedding", "label")


@query("cosine01", sql=f"""
WITH {NEIGHBOURS}
SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 ELSE round((list_cosine_similarity(x, y) + 1) / 2, 6) END::DOUBLE AS score FROM n""")
def _(t):
    other = F.when(F.col("vec_id") % 5 == 0, F.transform("other", lambda x: x * 0)).when(
        F.col("vec_id") % 5 == 1, F.slice("other", 1, 7)).otherwise(F.col("other"))
    return _neighbours(t).select("vec_id", F.round(cosine01(F.col("embedding"), other), 6).alias("score"))


@query("batch_cosine", sql="""
WITH u AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT list(m ORDER BY i) AS centre FROM (SELECT i, avg(x) AS m FROM u GROUP BY i))
SELECT vec_id AS key, round((list_cosine_similarity(embedding::DOUBLE[], centre) + 1) / 2, 6) AS score FROM embeddings, c""")
def _(t):
    vectors = _keys(t)
    return V.batch_cosine(vectors, V.centroid(vectors)).select("key", F.round("cosine01", 6).alias("score"))


@query("metric_score", sql=f"""
WITH {NEIGHBOURS}
SELECT vec_id, round(list_cosine_similarity(x, y), 6) AS cosine, round(list_inner_product(x, y), 6) AS dot, round(-list_distance(x, y), 6) AS euclidean FROM n""")
def _(t):
    score = lambda m: F.round(metric_score(F.col("embedding"), F.col("other"), m), 6)
    return _neighbours(t).select(
        "vec_id", score("COSINE").alias("cosine"), score("DOT_PRODUCT").alias("dot"), score("EUCLIDEAN").alias("euclidean"))


def _knn_sql(score):
    return f"""WITH {shared.QUERY_SET}, vectors AS (SELECT vec_id AS key, embedding::DOUBLE[] AS embedding, label, 1 AS importance_score FROM embeddings), {shared.PAIRS},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, key) AS rank FROM pairs)
SELECT query_id, key, round({score}, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= 10"""


def _knn(t, metric):
    best = V.knn_topk(_keys(t), shared.query_set(t), 10, metric)
    return best.select("query_id", "key", F.round("similarity", 6).alias("similarity"), "rank")


@query("knn_topk", sql=_knn_sql("similarity"))
def _(t):
    return _knn(t, "COSINE")


@query("knn_topk_euclidean", sql=_knn_sql("euclid"))
def _(t):
    return _knn(t, "EUCLIDEAN")


@query("knn_topk_dot", sql=_knn_sql("dot"))
def _(t):
    return _knn(t, "DOT_PRODUCT")


@query("knn_topk_blocks", sql=_knn_sql("similarity"))
def _(t):
    """The same result by the grid of blocks, the way of query sets past the size bound."""
    best = V.top_scores(_keys(t), shared.query_set(t), 10, query_bytes=0)
    return best.select("query_id", "key", F.round("similarity", 6).alias("similarity"), "rank")


BOOST = f"""CASE WHEN chunk_type IN ({S.text_list(R.BOOSTED_TYPES)}) THEN 1.1::DOUBLE ELSE 1 END
  * CASE WHEN len(key_entities) > 0 OR len(topics) > 0 THEN 1.05::DOUBLE ELSE 1 END"""


@query("search_score", sql=f"""
{WITH}, near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, key) AS near_rank FROM pairs),
cut AS (SELECT n.query_id, n.key, n.similarity, round(n.similarity * v.importance_score * {BOOST}, 9) AS score FROM near n JOIN vectors v USING (key) WHERE near_rank <= 10 AND similarity >= 0.2)
SELECT query_id, key, round(similarity, 6) AS similarity, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key))::INT AS rank FROM cut""")
def _(t):
    hits = V.similarity_search(shared.vectors(t), shared.query_set(t), 10, 0.2)
    return hits.select("query_id", "key", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"), "rank")


@query("search_stored_vectors", sql=f"""
{WITH}, near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, key::VARCHAR || '_chunk_0') AS near_rank FROM pairs),
cut AS (SELECT n.query_id, n.key || '_chunk_0' AS key, n.similarity, round(n.similarity * v.importance_score * {BOOST}, 9) AS score FROM near n JOIN vectors v USING (key) WHERE near_rank <= 10 AND similarity >= 0.2)
SELECT query_id, key, round(similarity, 6) AS similarity, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key))::INT AS rank FROM cut""")
def _(t):
    """Described, stored, the even documents ingested again, then searched from the stored table."""
    path, rows = scratch_path(t.spark, "vectors"), shared.described_vectors(t)
    put_vectors(rows, path)
    put_vectors(rows.filter(F.col("doc_id") % 2 == 0), path)
    asked = shared.query_set(t).withColumn("exclude_key", F.concat(F.col("exclude_key").cast("string"), F.lit("_chunk_0")))
    hits = V.similarity_search(read_vectors(t.spark, path), asked, 10, 0.2)
    return hits.select("query_id", "key", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"), "rank")


@query("full_scan_search", sql=f"""
{WITH}, s AS (SELECT query_id, key, round((similarity + 1) / 2, 9) AS sim, importance_score FROM pairs),
w AS (SELECT *, round(sim * importance_score, 9) AS score FROM s WHERE sim >= 0.6),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM w)
SELECT query_id, key, round(sim, 6) AS similarity, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 5""")
def _(t):
    hits = V.full_scan_search(shared.described_vectors(t), shared.query_set(t), 5, 0.6)
    return hits.select("query_id", "key", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"), "rank")


@query("partition_search", sql=f"""
{WITH}, s AS (SELECT query_id, key, label, round((similarity + 1) / 2, 9) AS sim, importance_score FROM pairs),
w AS (SELECT *, round(sim * importance_score, 9) AS score FROM s WHERE sim >= 0.55),
p AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, key) <= 5),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM p)
SELECT query_id, key, label, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 5""")
def _(t):
    hits = V.partition_search(shared.described_vectors(t), shared.query_set(t), 5, 0.55, "label")
    return hits.select("query_id", "key", "label", F.round("score", 6).alias("score"), "rank")


@query("metadata_filter", sql=f"""
WITH v AS (SELECT vec_id AS key, vec_id AS doc_id, CASE WHEN vec_id % 10 > 0 THEN TIMESTAMP '2024-01-01' + to_days((vec_id % 365)::INT) END AS created_at FROM embeddings)
SELECT key FROM v WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
AND coalesce(created_at >= TIMESTAMP '2024-02-01', true) AND coalesce(created_at <= TIMESTAMP '2024-10-01', true)""")
def _(t):
    v = t.embeddings.select(F.col("vec_id").alias("key"), F.col("vec_id").alias("doc_id"),
                            F.when(F.col("vec_id") % 10 > 0, shared.created_at(F.col("vec_id"))).alias("created_at"))
    return V.metadata_filter(v, t.labels.filter("quality = 1"), "2024-02-01", "2024-10-01").select("key")


@query("similarity_from_distance", sql=f"""
WITH {NEIGHBOURS}, d AS (SELECT vec_id, round(1 - list_cosine_similarity(x, y), 9) AS distance FROM n)
SELECT vec_id, round(CASE WHEN distance <= 1 THEN 1 - distance ELSE 0 END, 6)::DOUBLE AS similarity FROM d""")
def _(t):
    distance = F.round(1 - metric_score(F.col("embedding"), F.col("other"), "COSINE"), 9)
    return _neighbours(t).select("vec_id", F.round(similarity_from_distance(distance), 6).alias("similarity"))


# --- what each question may see: a run of documents, dates from, dates until; every tenth vector has no date ---

SEEN = """CASE WHEN query_id % 3 > 0 THEN range(query_id, query_id + 200) END AS document_ids, CASE WHEN query_id % 2 = 0 THEN TIMESTAMP '2024-01-20' END AS min_date,
  CASE WHEN query_id % 5 = 0 THEN TIMESTAMP '2024-10-01' END AS max_date"""
SEES = """(document_ids IS NULL OR list_contains(document_ids, key)) AND (key % 10 = 0 OR (created_at >= coalesce(min_date, created_at) AND created_at <= coalesce(max_date, created_at)))"""


def asking(t):
    day = lambda date: F.lit(f"{date} 00:00:00").cast("timestamp")
    q = F.col("query_id")
    return shared.query_set(t).withColumns({
        "document_ids": F.when(q % 3 > 0, F.sequence(q, q + 199)), "min_date": F.when(q % 2 == 0, day("2024-01-20")), "max_date": F.when(q % 5 == 0, day("2024-10-01"))})


def undated(vectors):
    return vectors.withColumn("created_at", F.when(F.col("key") % 10 > 0, F.col("created_at")))


FILTERED = f"""{WITH}, seen AS (SELECT query_id, {SEEN} FROM questions), allowed AS (SELECT p.*, v.chunk_type, v.key_entities, v.topics FROM pairs p JOIN vectors v USING (key) JOIN seen s USING (query_id) WHERE {SEES})"""


def _filtered_knn(t, **kw):
    best = V.top_scores(undated(shared.vectors(t)), asking(t), 5, **kw)
    return best.select("query_id", "key", F.round("similarity", 6).alias("similarity"), "rank")


KNN_FILTERED = f"""{FILTERED} SELECT query_id, key, round(similarity, 6) AS similarity, (row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, key))::INT AS rank FROM allowed QUALIFY rank <= 5"""


@query("knn_filtered", sql=KNN_FILTERED)
def _(t):
    """Every question with filters of its own, tested in the scan."""
    return _filtered_knn(t)


@query("knn_filtered_blocks", sql=KNN_FILTERED)
def _(t):
    return _filtered_knn(t, query_bytes=0)


@query("search_filtered", sql=f"""
{FILTERED}, near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, key) AS near_rank FROM allowed),
cut AS (SELECT query_id, key, similarity, round(similarity * importance_score * {BOOST}, 9) AS score FROM near WHERE near_rank <= 6 AND similarity >= 0.1)
SELECT query_id, key, round(similarity, 6) AS similarity, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key))::INT AS rank FROM cut""")
def _(t):
    hits = V.similarity_search(undated(shared.vectors(t)), asking(t), 6, 0.1)
    return hits.select("query_id", "key", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"), "rank")


# --- cells and buckets ---

CELL_SIZE = 50


def _stored_cells(t):
    path = scratch_path(t.spark, "cells")
    N.store_cells(undated(shared.described_vectors(t)), path, CELL_SIZE, 5)
    return path


@query("build_cells")
def _(t):
    assigned, cells, tops = N.build_cells(_keys(t), CELL_SIZE, 5)
    sizes = assigned.groupBy("cell_id").agg(F.count(F.lit(1)).alias("vectors"))
    return cells.select("cell_id", "top_id").join(sizes, "cell_id", "left")


@query("cell_sizes", sql="SELECT true AS agree, count(*) AS vectors, ceil(count(*) / 50)::BIGINT AS cells FROM embeddings JOIN documents ON vec_id = doc_id")
def _(t):
    """The sizes kept beside the stored index are those of its folders, and every vector is in one."""
    path = _stored_cells(t)
    kept = t.spark.read.parquet(f"{path}/cells").select("cell_id", "vectors")
    there = t.spark.read.parquet(f"{path}/rows").groupBy("cell_id").agg(F.count(F.lit(1)).alias("there"))
    both = kept.join(there, "cell_id", "left")
    return both.agg(F.bool_and(F.col("vectors") == F.coalesce("there", F.lit(0))).alias("agree"), F.sum("there").alias("vectors"), F.count(F.lit(1)).alias("cells"))


@query("ivf_search")
def _(t):
    return N.stored_search(t.spark, _stored_cells(t), shared.query_set(t), 10, 0.5, beam=4)


FULL_BEAM = """, w AS (SELECT *, round((similarity + 1) / 2, 9) AS sim FROM {pairs}), s AS (SELECT *, round(sim * importance_score, 9) AS score FROM w WHERE sim >= 0.6)
SELECT query_id, key, round(sim, 6) AS similarity, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key))::INT AS rank FROM s QUALIFY rank <= 5"""


def _all_cells(t, asked):
    hits = N.stored_search(t.spark, _stored_cells(t), asked, 5, 0.6, beam=None)
    return hits.select("query_id", "key", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"), "rank")


@query("ivf_all_cells", sql=WITH + FULL_BEAM.format(pairs="pairs"))
def _(t):
    """Every cell visited: the exact search, from the stored index."""
    return _all_cells(t, shared.query_set(t))


@query("ivf_all_cells_filtered", sql=FILTERED + FULL_BEAM.format(pairs="allowed"))
def _(t):
    return _all_cells(t, asking(t))


@query("lsh_search")
def _(t):
    return N.lsh_search(_keys(t), shared.query_set(t), 10)
