"""Tables that several queries derive from the given ones, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.describe import describe
from . import sqltext as S
from .registry import Tables


def vectors(t: Tables) -> DataFrame:
    """One row per document with an embedding; dates spread over a year by id."""
    docs = t.documents.select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"))
    return t.embeddings.join(docs, "vec_id").select(
        F.col("vec_id").alias("key"), F.col("vec_id").alias("doc_id"), F.lit(0).alias("chunk_index"), "embedding", "label",
        "content", created_at(F.col("vec_id")).alias("created_at"),
    )


def described_vectors(t: Tables) -> DataFrame:
    return describe(vectors(t))


def created_at(key):
    return F.timestamp_add("DAY", (key % 365).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp"))


PHRASES = ["", " What is that?", " Compare this versus that", " before the year"]
PHRASE_CASE = "CASE item_id % 4 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHRASES)) + " END"


def query_set(t: Tables) -> DataFrame:
    """The benchmark texts as questions of four kinds, each with the vector of its id; it must not find itself."""
    texts = t.benchmark.select(F.col("item_id").alias("vec_id"), F.expr(f"text || {PHRASE_CASE}").alias("query_text"))
    return t.embeddings.join(texts, "vec_id").select(
        F.col("vec_id").alias("query_id"), "query_text", "embedding", F.col("vec_id").alias("exclude_key"))


VECTORS = f"""described AS (
  SELECT vec_id AS key, vec_id AS doc_id, embedding::DOUBLE[] AS embedding, label, text AS content,
         {S.heading('text')} AS heading, {S.kind('text')} AS chunk_type, {S.entities('text')} AS key_entities,
         {S.topics('text')} AS topics, TIMESTAMP '2024-01-01' + to_days((vec_id % 365)::INT) AS created_at
  FROM embeddings JOIN documents ON vec_id = doc_id),
vectors AS (
  SELECT *, round({S.importance('content', 'chunk_type', 'key_entities')}, 6) AS importance_score,
         {S.summary('content', 'heading', 'chunk_type')} AS context_summary FROM described)"""

QUERY_SET = f"""questions AS (
  SELECT vec_id AS query_id, text || {PHRASE_CASE} AS query_text, embedding::DOUBLE[] AS embedding
  FROM embeddings JOIN benchmark ON vec_id = item_id)"""

# All pairs, as an oracle may; the library never forms them.
PAIRS = """pairs AS (
  SELECT q.query_id, v.key, round(list_cosine_similarity(q.embedding, v.embedding), 9) AS similarity,
         round(list_inner_product(q.embedding, v.embedding), 9) AS dot,
         round(-list_distance(q.embedding, v.embedding), 9) AS euclid, v.importance_score, v.label
  FROM questions q, vectors v WHERE q.query_id <> v.key)"""


# --- markdown made from documents: a title, then every line as a section heading ---

MD_SQL = r"""('# Document ' || doc_id || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10) || '## '))"""


def markdown(t: Tables) -> DataFrame:
    body = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n## "))
    return t.documents.select("doc_id", F.concat(F.lit("# Document "), F.col("doc_id").cast("string"), F.lit("\n\n"), body).alias("md"))


# --- usage log made from conversations ---

MODELS = ["amazon.nova-lite-v1:0", "amazon.titan-embed-text-v1", "amazon.titan-embed-text-v2:0"]
USAGE = f"""usage AS (
  SELECT conv_id::VARCHAR AS conversation_id, turn, CASE conv_id % 3 WHEN 0 THEN '{MODELS[0]}' WHEN 1 THEN '{MODELS[1]}' ELSE '{MODELS[2]}' END AS model_id,
         CASE WHEN role = 'assistant' THEN 0 ELSE length(text) // 4 END AS input_tokens,
         CASE WHEN role = 'assistant' THEN length(text) // 4 ELSE 0 END AS output_tokens,
         (conv_id + turn) % 5 = 0 AS cached, TIMESTAMP '2024-01-01' + to_minutes((conv_id * 37 + turn)::BIGINT) AS ts, role, text
  FROM conversations),
prices AS (SELECT * FROM (VALUES ('amazon.nova-lite-v1', 0.00006::DOUBLE, 0.00024::DOUBLE), ('amazon.titan-embed-text-v1', 0.0001::DOUBLE, 0::DOUBLE)) p(base_model, input_per_1k, output_per_1k)),
costed AS (
  SELECT u.*, input_tokens + output_tokens AS total_tokens, p.base_model IS NULL AS price_missing,
         input_tokens / 1000.0::DOUBLE * coalesce(input_per_1k, 0) + output_tokens / 1000.0::DOUBLE * coalesce(output_per_1k, 0) AS gross_cost
  FROM usage u LEFT JOIN prices p ON string_split(u.model_id, ':')[1] = p.base_model)"""


def usage(t: Tables) -> DataFrame:
    tokens = F.floor(F.length("text") / 4)
    model = F.when(F.col("conv_id") % 3 == 0, MODELS[0]).when(F.col("conv_id") % 3 == 1, MODELS[1]).otherwise(MODELS[2])
    at = F.timestamp_add("MINUTE", (F.col("conv_id") * 37 + F.col("turn")).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    reply = F.col("role") == "assistant"
    return t.conversations.select(
        F.col("conv_id").cast("string").alias("conversation_id"), "turn", model.alias("model_id"),
        F.when(reply, 0).otherwise(tokens).alias("input_tokens"), F.when(reply, tokens).otherwise(0).alias("output_tokens"),
        ((F.col("conv_id") + F.col("turn")) % 5 == 0).alias("cached"), at.alias("ts"), "role", "text")


# --- cache log, metrics and API calls made from events ---

CACHE_LOG = """cache_log AS (
  SELECT user_id::VARCHAR AS conversation_id, event_type AS cache_type, (props->>'$.k')::INT % 3 > 0 AS hit, value / 10000 AS cost_saved, ts, event_id
  FROM events)"""


def props_k(column: str = "props"):
    return F.get_json_object(column, "$.k").cast("int")


def cache_log(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("user_id").cast("string").alias("conversation_id"), F.col("event_type").alias("cache_type"),
        (props_k() % 3 > 0).alias("hit"), (F.col("value") / 10000).alias("cost_saved"), "ts", "event_id")


METRIC_NAME = {"view": "VectorQuery", "click": "CacheHit", "error": "CacheMiss", "signup": "APICall", "purchase": "ConversationCost"}
METRICS = f"""metrics AS (
  SELECT event_id AS metric_id, ts, value, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in METRIC_NAME.items())} END AS metric_name,
         CASE WHEN event_type IN ('signup', 'error') THEN 'ops' ELSE 'cost' END AS namespace, user_id FROM events)"""


def metrics(t: Tables) -> DataFrame:
    name = None
    for k, v in METRIC_NAME.items():
        name = F.when(F.col("event_type") == k, v) if name is None else name.when(F.col("event_type") == k, v)
    return t.events.select(
        F.col("event_id").alias("metric_id"), "ts", "value", name.alias("metric_name"),
        F.when(F.col("event_type").isin("signup", "error"), "ops").otherwise("cost").alias("namespace"), "user_id")


# --- log lines made from events: a hundred lines a file ---

LINE_TEXTS = [
    "An error occurred (AccessDenied) when calling the operation",
    "Error: stack creation halted",
    "botocore EndpointConnectionError: could not connect",
    "ModuleNotFoundError: no module named x",
    "FAILED: step timeout after retries",
    "ValidationException: Template format error at line 3",
    "bash: deploy: command not found",
    "Exception: credential rejected, signature invalid",
]
LINE_CASE = (
    "CASE WHEN event_type = 'error' AND (event_id // 100) % 3 = 0 THEN CASE CAST(k % 8 AS INT) "
    + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LINE_TEXTS))
    + " END WHEN event_type = 'error' AND (event_id // 100) % 3 = 1 THEN CASE WHEN k % 2 = 0 THEN 'Error: stack creation halted' ELSE 'step Failed: after retries' END "
    "ELSE 'INFO ' || event_type || ' for user ' || user_id END"
)
LOG_LINES = f"""log_lines AS (
  SELECT event_id // 100 AS file, event_id % 100 AS line_no, {LINE_CASE} AS line
  FROM (SELECT *, (props->>'$.k')::INT AS k FROM events))"""


def log_lines(t: Tables) -> DataFrame:
    return t.events.withColumn("k", props_k()).select(
        F.floor(F.col("event_id") / 100).alias("file"), (F.col("event_id") % 100).alias("line_no"),
        F.expr(LINE_CASE.replace("event_id // 100", "event_id div 100")).alias("line"))
