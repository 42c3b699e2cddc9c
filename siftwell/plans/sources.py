"""Sources and sinks: S1 to S11."""

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import strip_tags
from ..operators.describe import hash_embedding
from ..session import scratch_path
from ..sources import corpus as C, events as E
from ..sources.store import put_vectors, read_vectors
from . import shared, sqltext as S
from .registry import query

EXT_CASE = "CASE p_partkey % 6 WHEN 0 THEN '.PDF' WHEN 1 THEN '.md' WHEN 2 THEN '.exe' WHEN 3 THEN '' WHEN 4 THEN '.tar.html' ELSE '.docx' END"
PATH = f"p_brand || '/' || replace(p_name, ' ', chr(92)) || '/file' || p_partkey || {EXT_CASE} AS path"
PATHS = f"(SELECT p_partkey, {PATH} FROM part)"


def _paths(t):
    return t.part.selectExpr("p_partkey", PATH)


@query("read_text_corpus", sql="""
SELECT 'txt' AS ext, count(*) AS documents, sum(length(text) + 1)::BIGINT AS chars FROM documents""")
def _(t):
    path = scratch_path(t.spark, "corpus")
    one_line = F.regexp_replace("text", "\n", " ")
    t.documents.select(one_line.alias("text"), "lang").write.partitionBy("lang").option("maxRecordsPerFile", 50).text(path)
    files = C.read_text_corpus(t.spark, path, ["txt"])
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return files.groupBy("ext").agg(F.sum(lines).cast("bigint").alias("documents"), F.sum(F.length("text")).cast("bigint").alias("chars"))


@query("doc_id_from_path", sql=f"""
SELECT path, replace(replace(path, '/', '_'), chr(92), '_') AS doc_id,
       regexp_replace(list_last(string_split(path, '/')), '(.)[.][^.]*$', '\\1') AS stem FROM {PATHS}""")
def _(t):
    return _paths(t).select("path", C.doc_id_from_path(F.col("path")).alias("doc_id"), C.stem(F.col("path")).alias("stem"))


@query("supported_type", sql=f"""
SELECT path, contains(path, '.') AND lower(list_last(string_split(path, '.'))) IN ({S.text_list(R.UPLOAD_EXTENSIONS)}) AS supported,
       contains(path, '.') AND lower(list_last(string_split(path, '.'))) IN ({S.text_list(R.CORPUS_EXTENSIONS)}) AS in_corpus FROM {PATHS}""")
def _(t):
    p = F.col("path")
    return _paths(t).select("path", C.supported_type(p).alias("supported"), C.supported_type(p, R.CORPUS_EXTENSIONS).alias("in_corpus"))


@query("size_guard", sql="""
SELECT doc_id, CASE WHEN strlen(text) > 8000 THEN 'file_too_large' WHEN length(text) > 4000 THEN 'text_too_long' ELSE 'accepted' END AS outcome
FROM documents""")
def _(t):
    ok, rejected = C.size_guard(t.documents, F.octet_length("text"), F.length("text"), 8000, 4000)
    return ok.select("doc_id", F.lit("accepted").alias("outcome")).unionByName(
        rejected.select("doc_id", F.col("reject_reason").alias("outcome")))


@query("json_document_fields", sql="""
SELECT page_id, CASE WHEN page_id % 7 > 0 AND page_id % 3 > 0 THEN url END AS json_title,
       CASE WHEN page_id % 7 > 0 THEN '{"page":' || page_id || '}' END AS json_metadata FROM pages""")
def _(t):
    body = F.to_json(F.struct(
        F.when(F.col("page_id") % 3 > 0, F.col("url")).otherwise("").alias("title"),
        F.struct(F.col("page_id").alias("page")).alias("metadata"), F.col("html").alias("body")))
    broken = F.when(F.col("page_id") % 7 > 0, body).otherwise(F.concat(F.lit("{"), F.col("url")))
    docs = t.pages.select("page_id", broken.alias("json"))
    return C.json_document_fields(docs, "json").drop("json")


@query("html_to_text", sql="SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text FROM pages")
def _(t):
    return t.pages.select("page_id", strip_tags(F.col("html")).alias("text"))


@query("write_vectors", sql=f"""
WITH {shared.VECTORS}
SELECT doc_id || '_chunk_0' AS key, doc_id::VARCHAR AS doc_id, chunk_type, substr(content, 1, 500) AS content, substr(heading, 1, 100) AS heading,
       array_to_string(list_filter(key_entities, lambda e, i: list_sum(list_transform(list_slice(key_entities, 1, i), lambda x: length(x) + length(regexp_replace(x, '[^"' || chr(92) || chr(92) || chr(10) || ']', '', 'g')) + 4)) <= 200), '|') AS key_entities,
       array_to_string(list_filter(topics, lambda e, i: list_sum(list_transform(list_slice(topics, 1, i), lambda x: length(x) + 4)) <= 100), '|') AS topics,
       importance_score, substr(context_summary, 1, 200) AS context_summary, len(embedding)::INT AS dimension
FROM vectors""")
def _(t):
    path = scratch_path(t.spark, "vectors")
    C.write_vectors(shared.described_vectors(t), path)
    return t.spark.read.parquet(path).select(
        "key", "doc_id", "chunk_type", "content", "heading", F.array_join("key_entities", "|").alias("key_entities"),
        F.array_join("topics", "|").alias("topics"), "importance_score", "context_summary", F.size("embedding").alias("dimension"))


@query("rejected_documents", sql="""
WITH f AS (SELECT doc_id % 5 = 0 AS other, doc_id % 200 AS part, sum(strlen(replace(text, chr(10), ' ')) + 1)::BIGINT AS bytes, sum(length(text) + 1)::BIGINT AS chars FROM documents GROUP BY ALL),
r AS (SELECT CASE WHEN other THEN 'unsupported_type' WHEN bytes > 20000 THEN 'file_too_large' WHEN chars > 10000 THEN 'text_too_long' END AS reject_reason, bytes FROM f)
SELECT reject_reason, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM r WHERE reject_reason IS NOT NULL GROUP BY ALL""")
def _(t):
    """Documents as 200 text files, the files of one in five documents under a type that is not read."""
    path = scratch_path(t.spark, "files")
    lines = t.documents.select(F.regexp_replace("text", "\n", " ").alias("text"), (F.col("doc_id") % 200).alias("part"))
    for ext, wanted in (("txt", F.col("part") % 5 > 0), ("csv", F.col("part") % 5 == 0)):
        rows = lines.filter(wanted).repartition("part")
        if ext == "txt":
            rows.write.partitionBy("part").text(f"{path}/{ext}")
        else:
            rows.write.partitionBy("part").option("quote", "").option("escape", "").option("sep", "\u0001").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{path}/{ext}")
    rejected = C.rejected_files(t.spark, path, ["txt"], 20000, 10000)
    return rejected.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("files"), F.sum("size").cast("bigint").alias("bytes"))


@query("put_vectors", sql=f"""
WITH {shared.VECTORS}
SELECT doc_id || '_chunk_0' AS key, doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 2 = 0 THEN 'again: ' || substr(content, 1, 493) ELSE substr(content, 1, 500) END AS content
FROM vectors WHERE doc_id % 7 > 0 OR doc_id % 2 = 0""")
def _(t):
    """Ingested whole; then the even documents again with another text, and every seventh odd one deleted."""
    path, rows = scratch_path(t.spark, "vectors"), shared.described_vectors(t)
    put_vectors(rows, path)
    even = F.col("doc_id") % 2 == 0
    gone = rows.filter(~even & (F.col("doc_id") % 7 == 0)).select("doc_id")
    put_vectors(rows.filter(even).withColumn("content", F.concat(F.lit("again: "), "content")), path, gone=gone)
    return read_vectors(t.spark, path).select("key", "doc_id", "content")


@query("write_doc_status", sql="""
WITH c AS (SELECT conv_id AS doc_id, turn AS chunk_index, text AS content FROM conversations)
SELECT doc_id::VARCHAR AS doc_id, count(*) AS total_chunks, 8::BIGINT AS vector_dimensions,
       arg_min(substr(content, 1, 200), chunk_index) || '...' AS content_summary, 'completed' AS processing_status FROM c GROUP BY doc_id""")
def _(t):
    chunks = t.conversations.select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("content"))
    path = scratch_path(t.spark, "status")
    C.write_doc_status(chunks.withColumn("embedding", hash_embedding(F.col("content"), 8)), path)
    schema = "doc_id string, total_chunks bigint, vector_dimensions bigint, content_summary string, processing_status string"
    return t.spark.read.schema(schema).json(path)


@query("write_metrics", sql=f"""
WITH {shared.METRICS}
SELECT namespace, metric_name, count(*) AS metrics, round(sum(value), 4) AS total FROM metrics GROUP BY ALL""")
def _(t):
    m = shared.metrics(t)
    path = scratch_path(t.spark, "metrics")
    for namespace in ("ops", "cost"):
        rows = E.metric_rows(m.filter(F.col("namespace") == namespace), F.col("metric_name"), F.col("value"), "Count", F.col("ts"), namespace, user=F.col("user_id"))
        E.write_metrics(rows, path)
    return t.spark.read.parquet(path).groupBy("namespace", "metric_name").agg(
        F.count(F.lit(1)).alias("metrics"), F.round(F.sum("value"), 4).alias("total"))


@query("read_event_log", sql="""
SELECT event_id, CASE WHEN event_id % 11 > 0 THEN CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END END AS level,
       CASE WHEN event_id % 11 > 0 THEN event_type END AS message,
       CASE WHEN event_id % 11 > 0 THEN (props->>'$.k')::INT END AS line,
       CASE WHEN event_id % 11 > 0 AND event_type = 'view' THEN 'cache_event' WHEN event_id % 11 > 0 AND event_type = 'error' THEN 'security_event' END AS family,
       CASE WHEN event_id % 11 > 0 THEN user_id::VARCHAR END AS user_id, event_id % 11 = 0 AS unparsed FROM events""")
def _(t):
    kind = F.col("event_type")
    good = F.to_json(F.struct(
        F.when(kind == "error", "ERROR").otherwise("INFO").alias("level"), kind.alias("message"), shared.props_k().alias("line"),
        F.when(kind == "view", True).alias("cache_event"), F.when(kind == "error", True).alias("security_event"), F.col("user_id")))
    raw = F.when(F.col("event_id") % 11 > 0, good).otherwise(F.concat(F.lit("plain text "), kind))
    path = scratch_path(t.spark, "events")
    t.events.select(F.concat(F.col("event_id").cast("string"), F.lit("\t"), raw).alias("value")).write.text(path)
    parts = F.split("value", "\t", 2)
    lines = t.spark.read.text(path).select(parts[0].cast("bigint").alias("event_id"), E.parse_event(parts[1]).alias("e"))
    return lines.select(
        "event_id", "e.level", "e.message", "e.line", "e.family", F.try_element_at("e.extra", F.lit("user_id")).alias("user_id"),
        F.col("e").isNull().alias("unparsed"))


@query("incremental_ingest", sql="""
SELECT doc_id, sha256(text) AS content_hash FROM documents
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND l.quality = 1)""")
def _(t):
    stored = t.documents.join(t.labels.filter("quality = 1"), "doc_id", "left_semi").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return C.incremental_ingest(t.documents.select("doc_id", "text"), stored).select("doc_id", "content_hash")
