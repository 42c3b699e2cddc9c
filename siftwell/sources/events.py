"""Structured log events in, metric rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import rules as R

LOG_FIELDS = {
    "timestamp": "string", "level": "string", "logger": "string", "message": "string", "module": "string",
    "function": "string", "line": "int", "exception": "string",
}
# The field that marks each family of events.
FAMILIES = [
    "performance_metric", "security_event", "business_event", "api_request", "api_response",
    "cache_event", "document_processing", "vector_operation", "bedrock_request",
]


def parse_event(line: Column) -> Column:
    """JSON log line to struct: fixed fields, every other field in the map ``extra``. Bad lines give null."""
    flat = F.from_json(line, "map<string,string>", {"mode": "PERMISSIVE"})
    fixed = [F.try_element_at(flat, F.lit(n)).try_cast(t).alias(n) for n, t in LOG_FIELDS.items()]
    extra = F.map_filter(flat, lambda k, v: ~k.isin(list(LOG_FIELDS)))
    family = F.coalesce(*[F.when(F.try_element_at(flat, F.lit(f)) == "true", F.lit(f)) for f in FAMILIES])
    return F.when(flat.isNotNull() & (F.size(flat) > 0), F.struct(*fixed, family.alias("family"), extra.alias("extra")))


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Typed events of a folder of JSON lines, with the file and a raw column for lines that do not parse."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))
    return lines.withColumn("event", parse_event(F.col("raw"))).select(
        "file", "event.*", F.when(F.col("event").isNull(), F.col("raw")).alias("unparsed"))


METRIC_SCHEMA = T.StructType([
    T.StructField("namespace", T.StringType()), T.StructField("metric_name", T.StringType()), T.StructField("value", T.DoubleType()),
    T.StructField("unit", T.StringType()), T.StructField("ts", T.TimestampType()),
    T.StructField("dimensions", T.MapType(T.StringType(), T.StringType())),
])


def metric_rows(df: DataFrame, name: Column, value: Column, unit: str, ts: Column, namespace: str, **dimensions: Column) -> DataFrame:
    """Metric rows in the common shape."""
    pairs = [x for k, c in sorted(dimensions.items()) for x in (F.lit(k), c.cast("string"))]
    dims = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.select(
        F.lit(namespace).alias("namespace"), name.alias("metric_name"), value.cast("double").alias("value"), F.lit(unit).alias("unit"),
        ts.cast("timestamp").alias("ts"), dims.alias("dimensions"))


def write_metrics(metrics: DataFrame, path: str, batch_size: int = R.METRIC_BATCH, mode: str = "append") -> None:
    """Write metric rows with their batch number; one folder per namespace."""
    from ..operators.cost import metric_batches

    rows = metrics.withColumn("metric_id", F.xxhash64("metric_name", "value", "ts", F.to_json("dimensions")))
    metric_batches(rows, batch_size).drop("metric_id").write.mode(mode).partitionBy("namespace").parquet(path)
