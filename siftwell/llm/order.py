"""Places of rows in a sorted order, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .simhash import settled


def numbered(rows: DataFrame, group: str, order: list[str | Column], name: str) -> DataFrame:
    """``rows`` with ``pos``, the place from 0 within the group by ``order``, and ``n``, the number of rows of the group.

    Rows are written in ranges of group and order, each range sorted, one file
    per range. The place is then the number of the row in its file plus what the
    files before hold of the group; only counts per file and group are gathered.
    Rows alike in group and order take any of their places, and are dealt to
    several ranges by where they lie, so neither a large group nor a row that
    repeats makes one task large. ``rows`` must not have the columns part, salt,
    at, pos and n.
    """
    spark = rows.sparkSession
    here = settled(rows, name)
    here = here.withColumn("salt", F.xxhash64("_metadata.file_path", "_metadata.row_index"))
    by = [F.col(group), *(F.col(c) if isinstance(c, str) else c for c in order), F.col("salt")]
    dealt = here.repartitionByRange(*by).sortWithinPartitions(*by).drop("salt").withColumn("part", F.spark_partition_id())
    path = scratch_path(spark, f"{name}_ordered")
    dealt.write.option("maxRecordsPerFile", 0).parquet(path)
    placed = spark.read.parquet(path).withColumn("at", F.col("_metadata.row_index"))
    runs = placed.groupBy("part", group).agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("start"))
    each = Window.partitionBy(group)  # a row per file at most
    before = F.coalesce(F.sum("c").over(each.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("part", group, (before - F.col("start")).alias("shift"), F.sum("c").over(each).alias("n"))
    out = placed.join(runs, ["part", group])
    return out.withColumn("pos", F.col("at") + F.col("shift")).drop("at", "shift", "part")
