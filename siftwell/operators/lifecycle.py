"""Vector table lifecycle: create, upsert, delete, expire, count, compact, drop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import rules as R
from ..sources.corpus import STORED, VECTOR_BUCKETS


def delete_documents(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """The table without any row of the given documents."""
    return vectors.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def expired(vectors: DataFrame, as_of: str, days: int = R.RETENTION_DAYS) -> DataFrame:
    """Rows older than the retention at a fixed time; the literal bound reaches the scan."""
    bound = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return vectors.filter(F.col("created_at") < bound)


def expire_vectors(vectors: DataFrame, as_of: str, days: int = R.RETENTION_DAYS, dry_run: bool = False) -> DataFrame:
    """The table without expired rows; a dry run returns the count of rows that would go."""
    if dry_run:
        return expired(vectors, as_of, days).agg(F.count(F.lit(1)).alias("would_delete"))
    bound = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return vectors.filter(F.coalesce(F.col("created_at") >= bound, F.lit(True)))


def count_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.count(F.lit(1)).alias("vectors"))


def index_stats(vectors: DataFrame, index: str) -> DataFrame:
    """Per index: vectors, dimension, bytes and mean bytes per vector."""
    row_bytes = (F.size("embedding") * 4).cast("bigint")
    return vectors.groupBy(index).agg(
        F.count(F.lit(1)).alias("vectors"), F.max(F.size("embedding")).alias("dimension"),
        F.min(F.size("embedding")).alias("min_dimension"), F.sum(row_bytes).alias("bytes"),
    ).withColumn("mean_bytes", F.col("bytes") / F.col("vectors"))


def upsert_vectors(current: DataFrame, changes: DataFrame, version: str = "created_at") -> DataFrame:
    """One row per key, the latest; among equal versions the change wins."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    order = W.partitionBy("key").orderBy(F.desc_nulls_last(version), F.desc("_new"))
    return both.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn", "_new")


def compact_vectors(vectors: DataFrame, path: str, cell: str, rows_per_file: int = 1_000_000) -> None:
    """Rewrite sorted by cell and key.

    Ranges over (cell, key) cut a large cell into several files instead of
    sending it to one task.
    """
    (
        vectors.repartitionByRange(cell, "key").sortWithinPartitions(cell, "key")
        .write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)
    )


def compaction_report(vectors: DataFrame) -> DataFrame:
    """Rows and estimated size in MB."""
    return count_vectors(vectors).withColumn("estimated_mb", F.round(F.col("vectors") * R.VECTOR_MB, 2))


def create_vectors(spark: SparkSession, table: str, dim: int, metric: str = "COSINE", location: str | None = None) -> None:
    """An empty table of stored rows, neighbours included, that records its dimension and metric."""
    if metric not in ("COSINE", "EUCLIDEAN", "DOT_PRODUCT"):
        raise ValueError(f"unknown metric {metric}")
    spark.sql(
        f"""CREATE TABLE {table} ({STORED}, bucket INT)
        USING parquet PARTITIONED BY (bucket) {f"LOCATION '{location}'" if location else ""}
        TBLPROPERTIES ('vector.dimension' = '{int(dim)}', 'vector.metric' = '{metric}')"""
    )


def insert_vectors(rows: DataFrame, table: str, buckets: int = VECTOR_BUCKETS) -> None:
    """Append rows as ``vector_rows`` gives them; a vector of another dimension than the table's is an error."""
    spark = rows.sparkSession
    dim, _ = table_properties(spark, table)
    wrong = F.raise_error(F.concat(F.lit(f"{table} takes {dim} dimensions, not "), F.size("embedding").cast("string")))
    rows = rows.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(wrong.cast("array<float>")))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    for c, kind in spark.table(table).dtypes:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    rows.select(*spark.table(table).columns).write.insertInto(table)


def table_properties(spark: SparkSession, table: str) -> tuple[int, str]:
    props = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    return int(props["vector.dimension"]), props["vector.metric"]


def drop_vectors(spark: SparkSession, table: str, force: bool = False) -> int:
    """Drop the table and say how many rows it had; a table with rows needs ``force``."""
    rows = spark.table(table).count()
    if rows and not force:
        raise ValueError(f"{table} holds {rows} vectors; pass force=True to drop it")
    spark.sql(f"DROP TABLE {table}")
    return rows
