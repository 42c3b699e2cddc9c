"""Vector table lifecycle: D1 to D7."""

import uuid

from pyspark.sql import Window as W, functions as F

from ..functions.text import micros
from ..operators import lifecycle as D
from ..operators.chunk import chunk_neighbours
from ..session import scratch_path
from ..sources.corpus import vector_rows
from ..sources.store import VectorStore
from . import shared
from .registry import query

V = """v AS (SELECT vec_id AS key, vec_id AS doc_id, embedding, label, TIMESTAMP '2024-01-01' + to_days((vec_id % 365)::INT) AS created_at FROM embeddings)"""


def _v(t):
    return t.embeddings.select(F.col("vec_id").alias("key"), F.col("vec_id").alias("doc_id"), "embedding", "label", shared.created_at(F.col("vec_id")).alias("created_at"))


@query("delete_documents", sql=f"WITH {V} SELECT key, label FROM v WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def _(t):
    return D.delete_documents(_v(t), t.labels.filter("quality = 0")).select("key", "label")


@query("expire_vectors", sql=f"WITH {V} SELECT key FROM v WHERE created_at >= TIMESTAMP '2024-09-01' - INTERVAL 90 DAYS")
def _(t):
    return D.expire_vectors(_v(t), "2024-09-01").select("key")


@query("expire_vectors_dry_run", sql=f"WITH {V} SELECT count(*) AS would_delete FROM v WHERE created_at < TIMESTAMP '2024-09-01' - INTERVAL 90 DAYS")
def _(t):
    return D.expire_vectors(_v(t), "2024-09-01", dry_run=True)


@query("count_vectors", sql="SELECT count(*) AS vectors FROM embeddings")
def _(t):
    return D.count_vectors(_v(t))


@query("index_stats", sql="""
SELECT label, count(*) AS vectors, max(len(embedding))::INT AS dimension, min(len(embedding))::INT AS min_dimension, sum(len(embedding) * 4)::BIGINT AS bytes, round(sum(len(embedding) * 4)::DOUBLE / count(*), 6) AS mean_bytes FROM embeddings GROUP BY label""")
def _(t):
    return D.index_stats(_v(t), "label").withColumn("mean_bytes", F.round("mean_bytes", 6))


@query("compact_vectors", sql="SELECT count(*) AS vectors, round(count(*) * 0.006, 2)::DOUBLE AS estimated_mb FROM embeddings")
def _(t):
    path = scratch_path(t.spark, "compact")
    D.compact_vectors(_v(t), path, "label")
    return D.compaction_report(t.spark.read.parquet(path))


@query("compacted_rows", sql="SELECT label, count(*) AS vectors, sum(vec_id)::BIGINT AS keys, 0::BIGINT AS out_of_order FROM embeddings GROUP BY label")
def _(t):
    """Content and order of the files that a compaction wrote."""
    path = scratch_path(t.spark, "compacted")
    D.compact_vectors(_v(t), path, "label")
    rows = t.spark.read.parquet(path).select("label", "key", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    before = F.lag(F.struct("label", "key")).over(W.partitionBy("file").orderBy("at"))
    wrong = F.coalesce(before > F.struct("label", "key"), F.lit(False))
    return rows.withColumn("wrong", wrong).groupBy("label").agg(
        F.count(F.lit(1)).alias("vectors"), F.sum("key").alias("keys"), F.count_if("wrong").alias("out_of_order"))


@query("upsert_vectors", sql=f"""
WITH {V}, c AS (SELECT key, doc_id, label + 100 AS label, CASE WHEN key % 2 = 0 THEN created_at ELSE created_at + INTERVAL 1 DAY * (CASE WHEN key % 3 = 0 THEN -1 ELSE 1 END) END AS created_at FROM v WHERE key IN (SELECT doc_id FROM labels)
  UNION ALL SELECT key + 1000000, doc_id, label, created_at FROM v WHERE label = 3),
b AS (SELECT key, label, created_at, 0 AS fresh FROM v UNION ALL SELECT key, label, created_at, 1 FROM c)
SELECT key, label::INT AS label, epoch_us(created_at) AS created_us FROM b QUALIFY row_number() OVER (PARTITION BY key ORDER BY created_at DESC, fresh DESC) = 1""")
def _(t):
    v = _v(t)
    shift = F.when(F.col("key") % 2 == 0, 0).when(F.col("key") % 3 == 0, -1).otherwise(1)
    changed = v.join(t.labels.select("doc_id"), "doc_id", "left_semi").select(
        "key", "doc_id", "embedding", (F.col("label") + 100).alias("label"), F.timestamp_add("DAY", shift, F.col("created_at")).alias("created_at"))
    added = v.filter("label = 3").withColumn("key", F.col("key") + 1000000)
    return D.upsert_vectors(v, changed.unionByName(added)).select("key", "label", micros(F.col("created_at")).alias("created_us"))


@query("create_and_drop_vectors", sql="SELECT 64::INT AS dimension, 'COSINE' AS metric, count(*) AS dropped FROM embeddings JOIN documents ON vec_id = doc_id")
def _(t):
    """Stored rows with their neighbours in a named table."""
    name, spark = f"vectors_{uuid.uuid4().hex}", t.spark
    D.create_vectors(spark, name, 64, location=scratch_path(spark, "warehouse"))
    D.insert_vectors(vector_rows(chunk_neighbours(shared.described_vectors(t), "doc_id")), name)
    dim, metric = D.table_properties(spark, name)
    dropped = D.drop_vectors(spark, name, force=True)
    return spark.createDataFrame([(dim, metric, dropped)], "dimension int, metric string, dropped bigint")


@query("store_changes", sql=f"""
WITH {shared.VECTORS}, c AS (
  SELECT doc_id, CASE WHEN doc_id % 21 = 3 THEN 'back: ' || content WHEN doc_id % 3 = 0 THEN 'again: ' || content ELSE content END AS content,
    CASE WHEN doc_id % 3 = 0 AND doc_id % 21 <> 3 THEN created_at + INTERVAL 1 DAY ELSE created_at END AS made, doc_id % 21 = 3 AS back FROM vectors)
SELECT doc_id || '_chunk_0' AS key, doc_id::VARCHAR AS doc_id, substr(content, 1, 500) AS content, epoch_us(made) AS created_us, 64::INT AS dimension
FROM c WHERE back OR (doc_id % 7 <> 3 AND made >= TIMESTAMP '2024-09-01' - INTERVAL 90 DAYS)""")
def _(t):
    """Stored; a third again, each document twice in the batch; some deleted, old ones expired, some of both put back; compacted."""
    rows = shared.described_vectors(t)
    marked = lambda mark, days: rows.withColumn("content", F.concat(F.lit(mark), "content")).withColumn("created_at", F.timestamp_add("DAY", F.lit(days), F.col("created_at")))
    store = VectorStore.create(t.spark, scratch_path(t.spark, "store"), 64)
    store.put(rows)
    store.put(marked("again: ", 1).unionByName(marked("old: ", 0)).filter("doc_id % 3 = 0"))
    store.delete(rows.filter("doc_id % 7 = 3").select("doc_id"))
    store.expire("2024-09-01", 90)
    store.put(marked("back: ", 0).filter("doc_id % 21 = 3"))
    store.compact()
    return store.read().select("key", "doc_id", "content", micros(F.col("created_at")).alias("created_us"), F.size("embedding").alias("dimension"))
