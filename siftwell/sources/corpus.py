"""Reading a corpus, guarding sizes, and writing vectors and document status."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import rules as R
from ..functions.text import strip_tags, words
from ..functions.vectors import valid_embedding

VECTOR_BUCKETS = 64
NEIGHBOURS = ["prev_context", "next_context", "chunk_position", "total_chunks", "relative_position"]
# Columns of a stored row: those of ``vector_rows``, neighbours included.
STORED = """key STRING, doc_id STRING, chunk_index INT, embedding ARRAY<FLOAT>, content STRING, heading STRING, chunk_type STRING,
    key_entities ARRAY<STRING>, topics ARRAY<STRING>, importance_score DOUBLE, context_summary STRING, created_at TIMESTAMP,
    prev_context STRUCT<heading: STRING, chunk_type: STRING, summary: STRING>,
    next_context STRUCT<heading: STRING, chunk_type: STRING, summary: STRING>, chunk_position INT, total_chunks BIGINT, relative_position DOUBLE"""


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot; null without one."""
    return F.when(F.instr(path, ".") > 0, F.lower(F.substring_index(path, ".", -1)))


def supported_type(path: Column, allowed: list[str] | None = None) -> Column:
    return F.coalesce(extension(path).isin(allowed or R.UPLOAD_EXTENSIONS), F.lit(False))


def doc_id_from_path(path: Column, root: str = "") -> Column:
    """Path below the root with slashes turned to underscores."""
    relative = F.regexp_replace(path, "^" + root.replace(".", r"\."), "") if root else path
    return F.regexp_replace(relative, r"[/\\]", "_")


def below(path: Column, folder: str) -> Column:
    """A file's path without the folder it was read from."""
    root = "(?:[a-z]+:)?/*" + re.escape(folder.split(":", 1)[-1].strip("/")) + "/"
    return F.regexp_replace(path, "^" + root, "")


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def size_reason(size: Column, chars: Column, max_bytes: int = R.MAX_FILE_BYTES, max_chars: int = R.MAX_TEXT_CHARS) -> Column:
    return F.when(size > max_bytes, "file_too_large").when(chars > max_chars, "text_too_long")


def size_guard(df: DataFrame, size: Column, chars: Column, max_bytes: int = R.MAX_FILE_BYTES,
               max_chars: int = R.MAX_TEXT_CHARS) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason). Everything per document relies on this bound."""
    marked = df.withColumn("reject_reason", size_reason(size, chars, max_bytes, max_chars))
    return marked.filter("reject_reason is null").drop("reject_reason"), marked.filter("reject_reason is not null")


def read_text_corpus(spark: SparkSession, path: str, exts: list[str] | None = None, recursive: bool = True,
                     max_bytes: int = R.MAX_FILE_BYTES) -> DataFrame:
    """Text files of a folder: doc_id, path, ext, size, modified, text.

    Sizes are checked on the file listing before any text is read, so a file over
    the limit is never loaded; ``rejected_files`` returns those, with their reason.
    """
    exts = exts or R.CORPUS_EXTENSIONS
    files = (
        spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", recursive)
        .option("pathGlobFilter", "*.{" + ",".join(exts) + "}").load(path)
    )
    meta = files.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"),
                        F.col("_metadata.file_modification_time").alias("modified"))
    return meta.filter(F.col("size") <= max_bytes).select(
        doc_id_from_path(below(F.col("path"), path)).alias("doc_id"), "path", extension(F.col("path")).alias("ext"), "size", "modified",
        F.col("value").alias("text"))


def rejected_files(spark: SparkSession, path: str, exts: list[str] | None = None, max_bytes: int = R.MAX_FILE_BYTES,
                   max_chars: int = R.MAX_TEXT_CHARS) -> DataFrame:
    """What ``read_text_corpus`` and ``size_guard`` leave out of a folder: path, size, reject_reason.

    Files over ``max_bytes`` and files of another type are known from the listing;
    the text is read only of files that pass it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"))
    listed = files.withColumn("reject_reason", F.when(~supported_type(F.col("path"), exts or R.CORPUS_EXTENSIONS), "unsupported_type").otherwise(
        size_reason(F.col("size"), F.lit(0), max_bytes, max_chars))).filter("reject_reason is not null")
    read = read_text_corpus(spark, path, exts, max_bytes=max_bytes)
    long = size_guard(read, F.col("size"), F.length("text"), max_bytes, max_chars)[1].select("path", "size", "reject_reason")
    return listed.unionByName(long)


def corpus_text(df: DataFrame) -> DataFrame:
    """Markup removed from HTML rows; other rows as they are."""
    return df.withColumn("text", F.when(F.col("ext").isin("html", "htm"), strip_tags(F.col("text"))).otherwise(F.col("text")))


def json_document_fields(df: DataFrame, text: str) -> DataFrame:
    """Add json_title and json_metadata; both null where the text is no JSON object or lacks them."""
    body = F.col(text)
    return df.withColumn("json_title", F.nullif(F.get_json_object(body, "$.title"), F.lit(""))).withColumn(
        "json_metadata", F.get_json_object(body, "$.metadata"))


def vector_rows(chunks: DataFrame) -> DataFrame:
    """Rows as stored: key, cut text columns, lists as arrays, invalid embeddings left out.

    Keys number chunks over the whole document. Of a list, the leading items are
    kept whose JSON text fits the bound; an item is never cut. The neighbour
    columns are stored where the chunks have them.
    """
    beside = [c for c in NEIGHBOURS if c in chunks.columns]
    return chunks.filter(valid_embedding(F.col("embedding"))).select(
        F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("key"),
        F.col("doc_id").cast("string").alias("doc_id"),
        F.col("chunk_index").cast("int").alias("chunk_index"),
        F.col("embedding").cast("array<float>").alias("embedding"),
        F.substring("content", 1, R.CONTENT_CUT).alias("content"),
        F.substring(F.coalesce("heading", F.lit("")), 1, R.HEADING_CUT).alias("heading"),
        F.coalesce("chunk_type", F.lit("paragraph")).alias("chunk_type"),
        _fitting(F.col("key_entities"), R.ENTITIES_CUT).alias("key_entities"),
        _fitting(F.col("topics"), R.TOPICS_CUT).alias("topics"),
        F.coalesce("importance_score", F.lit(1.0)).alias("importance_score"),
        F.substring(F.coalesce("context_summary", F.lit("")), 1, R.SUMMARY_CUT).alias("context_summary"),
        "created_at", *beside,
    )


def _fitting(items: Column, most: int) -> Column:
    """The leading items of a string array whose JSON text, with ", " between items, has at most ``most`` characters."""
    escaped = lambda x: F.length(x) + F.length(F.regexp_replace(x, r'[^\\\\"\n]', ""))
    taken = lambda i: F.aggregate(F.slice(items, F.lit(1), i + 1), F.lit(0), lambda n, x: n + escaped(x) + 4)
    return F.coalesce(F.filter(items, lambda x, i: taken(i) <= most), F.array().cast("array<string>"))


def write_vectors(chunks: DataFrame, path: str, mode: str = "append", rows_per_file: int = 1_000_000,
                  buckets: int = VECTOR_BUCKETS) -> None:
    """Write stored rows, partitioned by a hash bucket of the document.

    Rows go out as they come; one document's rows need no gathering, so a document
    with many chunks does not make a hot task.
    """
    rows = vector_rows(chunks).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    spread = F.pmod(F.xxhash64("key"), F.lit(8))
    rows.repartition("bucket", spread).write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy("bucket").parquet(path)


def document_status(chunks: DataFrame, status: str = "completed") -> DataFrame:
    """Per document: total_chunks, dimension, summary of the first chunk, status."""
    return chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("vector_dimensions"),
        F.min_by(F.substring("content", 1, 200), "chunk_index").alias("first"),
    ).select("doc_id", "total_chunks", "vector_dimensions", F.concat("first", F.lit("...")).alias("content_summary"),
             F.lit(status).alias("processing_status"))


def write_doc_status(chunks: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    document_status(chunks).write.mode(mode).format(fmt).save(path)


def incremental_ingest(documents: DataFrame, stored: DataFrame, text: str = "text") -> DataFrame:
    """Documents whose (doc_id, content hash) the stored table does not know."""
    fresh = documents.withColumn("content_hash", F.sha2(F.col(text), 256))
    return fresh.join(stored.select("doc_id", "content_hash").distinct(), ["doc_id", "content_hash"], "left_anti")
