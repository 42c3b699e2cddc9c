"""Cost, usage, metrics, alarms, rates and cache reuse: T1 to T21."""

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import micros
from ..operators import cost as T
from ..session import scratch_path
from . import shared, sqltext as S
from .registry import query

US = 1_000_000


def _prices(t):
    return T.price_table(t.spark)


def _costed(t):
    return T.token_cost(shared.usage(t), _prices(t))


NET = "CASE WHEN cached THEN 0 ELSE gross_cost END"


@query("token_cost", sql=f"""
WITH {shared.USAGE} SELECT conversation_id, turn, total_tokens, price_missing, round(gross_cost, 9) AS gross_cost, round({NET}, 9)::DOUBLE AS net_cost FROM costed""")
def _(t):
    return _costed(t).select("conversation_id", "turn", "total_tokens", "price_missing", F.round("gross_cost", 9).alias("gross_cost"), F.round("net_cost", 9).alias("net_cost"))


@query("vector_query_cost", sql=f"""
WITH v AS (SELECT event_id, (props->>'$.k')::INT AS n, event_type = 'view' AS hit FROM events)
SELECT event_id, round(n * 0.0004, 6)::DOUBLE AS gross_cost, (CASE WHEN hit THEN 0 ELSE round(n * 0.0004, 6) END)::DOUBLE AS net_cost FROM v""")
def _(t):
    rows = t.events.select("event_id", shared.props_k().alias("n"), (F.col("event_type") == "view").alias("hit"))
    return T.vector_query_cost(rows, "n", "hit").select("event_id", F.round("gross_cost", 6).alias("gross_cost"), F.round("net_cost", 6).alias("net_cost"))


@query("cache_events", sql=f"""
WITH {shared.CACHE_LOG}
SELECT event_id, cache_type, CASE WHEN hit THEN 'CacheHit' ELSE 'CacheMiss' END AS metric_name, 1::DOUBLE AS value, 'Count' AS unit FROM cache_log
UNION ALL SELECT event_id, cache_type, 'ConversationCost', -cost_saved, 'USD' FROM cache_log WHERE hit AND cost_saved > 0""")
def _(t):
    return T.cache_events(shared.cache_log(t), ["event_id", "cache_type"])


@query("api_call_stats", sql="""
SELECT event_type AS api_type, count(*) AS calls, count(CASE WHEN value > 0 THEN 1 END) AS timed_calls, round(sum(CASE WHEN value > 0 THEN value END), 4) AS total_ms, round(avg(CASE WHEN value > 0 THEN value END), 6) AS mean_ms
FROM events GROUP BY event_type""")
def _(t):
    rows = T.api_call_stats(t.events.withColumnRenamed("event_type", "api_type"), "api_type", "value")
    return rows.select("api_type", "calls", "timed_calls", F.round("total_ms", 4).alias("total_ms"), F.round("mean_ms", 6).alias("mean_ms"))


def _within(rows, key, value, folder):
    """Whether quantiles from sketches stored by day, read back and merged are within the stated error of their ranks."""
    shares = {"p50": 0.5, "p95": 0.95}
    T.quantile_sketches(rows, [key], value).write.parquet(folder)
    found = T.merged_quantiles(rows.sparkSession.read.parquet(folder), [key], shares)
    both = rows.filter(F.col(value).isNotNull()).join(found, key)  # a row per key
    ranks = both.groupBy(key).agg(F.first("n").alias("timed_calls"), *[
        (F.avg((F.col(value) < F.col(c)).cast("int")) <= q + T.RANK_ERROR).alias(f"{c}_low") for c, q in shares.items()], *[
        (F.avg((F.col(value) <= F.col(c)).cast("int")) >= q - T.RANK_ERROR).alias(f"{c}_high") for c, q in shares.items()])
    return ranks.select(key, "timed_calls", *[(F.col(f"{c}_low") & F.col(f"{c}_high")).alias(f"{c}_within") for c in shares])


@query("api_call_quantiles", sql="""
SELECT event_type AS api_type, count(*) AS timed_calls, true AS p50_within, true AS p95_within FROM events WHERE value > 0 GROUP BY event_type""")
def _(t):
    rows = t.events.filter("value > 0").select(F.col("event_type").alias("api_type"), "ts", "value")
    return _within(rows, "api_type", "value", scratch_path(t.spark, "api-sketches"))


@query("response_quantiles", sql=f"""
WITH {shared.USAGE} SELECT model_id, count(*) AS timed_calls, true AS p50_within, true AS p95_within FROM usage GROUP BY model_id""")
def _(t):
    rows = shared.usage(t).select("model_id", "ts", (F.length("text") % 97 * 1.5).alias("latency_ms"))
    return _within(rows, "model_id", "latency_ms", scratch_path(t.spark, "response-sketches"))


CONVERSATIONS = f"""{shared.USAGE}, {shared.CACHE_LOG},
rowsum AS (SELECT conversation_id, total_tokens, 0 AS vector_queries, 0 AS cache_hits, 0 AS cache_misses, gross_cost, {NET} AS net_cost, ts FROM costed
  UNION ALL SELECT conversation_id, 0, CASE WHEN cache_type = 'view' THEN 1 ELSE 0 END, hit::INT, (NOT hit)::INT, 0, 0, ts FROM cache_log),
conv AS (SELECT conversation_id, sum(total_tokens)::BIGINT AS total_tokens, sum(vector_queries)::BIGINT AS vector_queries, sum(cache_hits)::BIGINT AS cache_hits, sum(cache_misses)::BIGINT AS cache_misses,
  sum(gross_cost) AS gross_cost, sum(net_cost) AS net_cost, min(ts) AS start_time, max(ts) AS last_activity FROM rowsum GROUP BY conversation_id)"""


def _conversations(t):
    spent = _costed(t).select("conversation_id", "total_tokens", "gross_cost", "net_cost", "ts")
    seen = shared.cache_log(t).select(
        "conversation_id", (F.col("cache_type") == "view").cast("int").alias("vector_queries"), F.col("hit").cast("int").alias("cache_hits"),
        (~F.col("hit")).cast("int").alias("cache_misses"), "ts")
    return T.conversation_cost(spent.unionByName(seen, allowMissingColumns=True))


COUNTERS = ["total_tokens", "vector_queries", "cache_hits", "cache_misses"]


@query("conversation_cost", sql=f"""
WITH {CONVERSATIONS} SELECT conversation_id, {', '.join(COUNTERS)}, round(gross_cost, 9) AS gross_cost, round(net_cost, 9) AS net_cost, epoch_us(start_time) AS start_us, epoch_us(last_activity) AS last_us FROM conv""")
def _(t):
    return _conversations(t).select(
        "conversation_id", *COUNTERS, F.round("gross_cost", 9).alias("gross_cost"), F.round("net_cost", 9).alias("net_cost"),
        micros(F.col("start_time")).alias("start_us"), micros(F.col("last_activity")).alias("last_us"))


@query("cost_summary", sql=f"""
WITH {CONVERSATIONS} SELECT count(*) AS total_conversations, round(sum(gross_cost), 6) AS total_cost_estimate, sum(total_tokens)::BIGINT AS total_tokens, sum(vector_queries)::BIGINT AS total_vector_queries,
  round(sum(cache_hits)::DOUBLE / (sum(cache_hits) + sum(cache_misses)), 3) AS cache_hit_rate, round(sum(gross_cost) / count(*), 6) AS average_cost_per_conversation FROM conv""")
def _(t):
    return T.cost_summary(_conversations(t))


@query("top_conversations", sql=f"""
WITH {CONVERSATIONS} SELECT conversation_id, total_tokens, round(gross_cost, 9) AS gross_cost FROM (SELECT * REPLACE (round(gross_cost, 9) AS gross_cost) FROM conv) ORDER BY gross_cost DESC, conversation_id LIMIT 10""")
def _(t):
    return T.top_conversations(_conversations(t).withColumn("gross_cost", F.round("gross_cost", 9))).select("conversation_id", "total_tokens", "gross_cost")


@query("hit_rate_by_cache", sql=f"""
WITH {shared.CACHE_LOG} SELECT cache_type, count_if(hit)::BIGINT AS hits, count_if(NOT hit)::BIGINT AS misses, count(*) AS total, round(count_if(hit)::DOUBLE / count(*), 6) AS hit_ratio FROM cache_log GROUP BY cache_type""")
def _(t):
    return T.hit_rate_by_cache(shared.cache_log(t)).withColumn("hit_ratio", F.round("hit_ratio", 6))


@query("tokens_by_model", sql=f"""
WITH {shared.USAGE} SELECT model_id, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(input_tokens + output_tokens)::BIGINT AS total_tokens, count(*) AS uses FROM usage GROUP BY model_id""")
def _(t):
    return T.tokens_by_model(shared.usage(t))


def _series_sql(interval, by="metric_name"):
    return f"""WITH {shared.METRICS} SELECT epoch_us(time_bucket(INTERVAL '{interval}', ts)) AS window_us, {by}, round(sum(value), 4) AS total, count(*) AS samples, max(value) AS peak FROM metrics GROUP BY ALL"""


def _series(df, *by):
    return df.select(micros(F.col("window_start")).alias("window_us"), *by, F.round("total", 4).alias("total"), "samples", "peak")


@query("metric_timeseries", sql=_series_sql("5 minutes"))
def _(t):
    return _series(T.metric_timeseries(shared.metrics(t)), "metric_name")


@query("metric_timeseries_15m_by_namespace", sql=_series_sql("15 minutes", "namespace, metric_name"))
def _(t):
    return _series(T.metric_timeseries(shared.metrics(t), "15 minutes", ("namespace", "metric_name")), "namespace", "metric_name")


@query("alarms", sql=f"""
WITH {shared.METRICS}, c AS (SELECT * FROM metrics WHERE metric_name = 'ConversationCost'),
d AS (SELECT 'daily_cost' AS alarm, epoch_us(time_bucket(INTERVAL '24 hours', ts)) AS window_us, sum(value) AS total, max(value) AS peak FROM c GROUP BY ALL),
s AS (SELECT 'conversation_cost' AS alarm, epoch_us(time_bucket(INTERVAL '5 minutes', ts)) AS window_us, sum(value) AS total, max(value) AS peak FROM c GROUP BY ALL)
SELECT alarm, window_us, round(total, 4) AS total, peak FROM d WHERE total > 5.0 UNION ALL SELECT alarm, window_us, round(total, 4), peak FROM s WHERE peak > 0.10""")
def _(t):
    rows = T.cost_alarms(shared.metrics(t))
    return rows.select("alarm", micros(F.col("window_start")).alias("window_us"), F.round("total", 4).alias("total"), "peak")


@query("alarms_consecutive", sql=f"""
WITH {shared.METRICS}, p AS (SELECT metric_name, epoch_us(ts) // 3600000000 AS period, sum(value) AS total FROM metrics GROUP BY ALL),
o AS (SELECT *, lag(period) OVER (PARTITION BY metric_name ORDER BY period) AS before FROM p WHERE total > 10)
SELECT metric_name, period, round(total, 4) AS total FROM o WHERE before = period - 1""")
def _(t):
    return T.consecutive_alarms(shared.metrics(t), 3600, R.ERROR_ALARM).withColumn("total", F.round("total", 4))


@query("metric_batches", sql=f"""
WITH {shared.METRICS} SELECT metric_id, namespace, (row_number() OVER (PARTITION BY namespace ORDER BY ts, metric_id) - 1) // 20 AS batch_no FROM metrics""")
def _(t):
    return T.metric_batches(shared.metrics(t)).select("metric_id", "namespace", "batch_no")


def _rate_sql(seconds, limit, source):
    return f"""SELECT event_id, count(*) OVER (PARTITION BY {source} ORDER BY ts RANGE BETWEEN INTERVAL {seconds} SECONDS PRECEDING AND CURRENT ROW) AS recent_calls,
  count(*) OVER (PARTITION BY {source} ORDER BY ts RANGE BETWEEN INTERVAL {seconds} SECONDS PRECEDING AND CURRENT ROW) > {limit} AS blocked FROM events"""


@query("sliding_rate_per_minute", sql=_rate_sql(60, 10, "event_type"))
def _(t):
    return T.sliding_rate(t.events, "event_type", 60, 10).select("event_id", "recent_calls", "blocked")


@query("sliding_rate_per_hour", sql=_rate_sql(3600, 5, "event_type"))
def _(t):
    return T.sliding_rate(t.events, "event_type", 3600, 5).select("event_id", "recent_calls", "blocked")


@query("collector_error_rate", sql="""
WITH o AS (SELECT CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'dropped' ELSE 'sent' END AS outcome FROM events)
SELECT count(*) AS collected, count_if(outcome = 'sent')::BIGINT AS sent, count_if(outcome = 'dropped')::BIGINT AS dropped, count_if(outcome = 'error')::BIGINT AS errors,
  round(count_if(outcome = 'error')::DOUBLE / greatest(count(*), 1), 6) AS error_rate FROM o""")
def _(t):
    outcome = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "dropped").otherwise("sent")
    return T.collector_error_rate(t.events.select(outcome.alias("outcome")), "outcome").withColumn("error_rate", F.round("error_rate", 6))


KEYS = "CASE WHEN doc_id % 9 = 0 THEN 'api_key ' ELSE '' END || text"


@query("cache_key", sql=f"""
WITH k AS (SELECT doc_id, {KEYS} AS body FROM documents)
SELECT doc_id, CASE WHEN NOT {S.either('lower(body)', R.CACHE_SENSITIVE)} THEN 'response:' || md5(body) END AS key, sha256(body || ':' || 'amazon.nova-lite-v1:0') AS prompt_key,
  'context:' || md5('{{"a": "' || doc_id || '", "b": "x"}}') AS map_key FROM k""")
def _(t):
    rows = t.documents.select("doc_id", F.expr(KEYS).alias("body"))
    pairs = F.create_map(F.lit("b"), F.lit("x"), F.lit("a"), F.col("doc_id").cast("string"))
    return rows.select(
        "doc_id", T.cache_key(F.lit("response"), F.col("body")).alias("key"), T.prompt_key(F.col("body"), F.lit("amazon.nova-lite-v1:0")).alias("prompt_key"),
        T.cache_key(F.lit("context"), T.canonical_json(pairs)).alias("map_key"))


@query("context_key", sql="""
SELECT vec_id, sha256(array_to_string(list_transform(embedding[1:10], lambda x: printf('%.6f', x::DOUBLE)), ',') || ':3:0.45') AS key FROM embeddings""")
def _(t):
    return t.embeddings.select("vec_id", T.context_key(F.col("embedding"), 3, 0.45).alias("key"))


def _ttl_sql(ttl):
    return f"""
WITH RECURSIVE l AS (SELECT event_type AS cache_type, epoch_us(ts) AS us, count(*) AS n FROM events GROUP BY ALL),
ins AS (SELECT cache_type, min(us) AS us FROM l GROUP BY cache_type
  UNION ALL SELECT i.cache_type, min(l.us) FROM ins i JOIN l ON l.cache_type = i.cache_type AND l.us >= i.us + {ttl * US} GROUP BY i.cache_type)
SELECT l.cache_type, l.us AS ts_us, n::BIGINT AS requests, (n - CASE WHEN ins.us IS NULL THEN 0 ELSE 1 END)::BIGINT AS hits, ins.us IS NOT NULL AS inserted
FROM l LEFT JOIN ins ON ins.cache_type = l.cache_type AND ins.us = l.us"""


def _ttl(t, ttl):
    return T.ttl_reuse(t.events.withColumnRenamed("event_type", "cache_type"), "cache_type", ttl)


@query("ttl_reuse", sql=_ttl_sql(R.CACHE_TTL_SECONDS["response"]))
def _(t):
    return _ttl(t, R.CACHE_TTL_SECONDS["response"])


@query("ttl_reuse_widget", sql=_ttl_sql(R.WIDGET_TTL_SECONDS))
def _(t):
    return _ttl(t, R.WIDGET_TTL_SECONDS)


@query("cache_occupancy", sql=f"""
WITH e AS (SELECT event_type AS cache_type, epoch_us(ts) AS us, CASE WHEN event_type = 'view' THEN 3600 ELSE 86400 END AS ttl FROM events), n AS (SELECT epoch_us(TIMESTAMP '2024-01-20 12:00:00') AS us)
SELECT cache_type, count_if(e.us <= n.us AND e.us + ttl::BIGINT * {US} > n.us)::BIGINT AS live, count_if(e.us <= n.us AND e.us + ttl::BIGINT * {US} <= n.us)::BIGINT AS expired FROM e, n GROUP BY cache_type""")
def _(t):
    rows = t.events.select(F.col("event_type").alias("cache_type"), "ts", F.when(F.col("event_type") == "view", 3600).otherwise(86400).cast("bigint").alias("ttl"))
    return T.cache_occupancy(rows, "ttl", "2024-01-20 12:00:00")


@query("cost_projection", sql=f"""
WITH {shared.USAGE}, d AS (SELECT model_id, ts::DATE AS day, count_if(NOT cached) AS calls, sum(CASE WHEN cached THEN 0 ELSE input_tokens END) AS i, sum(CASE WHEN cached THEN 0 ELSE output_tokens END) AS o FROM usage GROUP BY ALL),
m AS (SELECT model_id, avg(calls) * 30 AS calls, avg(i) * 30 AS i, avg(o) * 30 AS o FROM d GROUP BY model_id)
SELECT model_id, round(calls, 6) AS calls, round(i, 6) AS input_tokens, round(o, 6) AS output_tokens, round(i / 1000 * coalesce(input_per_1k, 0) + o / 1000 * coalesce(output_per_1k, 0), 9) AS monthly_cost, p.base_model IS NULL AS price_missing
FROM m LEFT JOIN prices p ON string_split(model_id, ':')[1] = p.base_model""")
def _(t):
    rows = T.cost_projection(shared.usage(t), _prices(t))
    return rows.select("model_id", *[F.round(c, 6).alias(c) for c in ("calls", "input_tokens", "output_tokens")], F.round("monthly_cost", 9).alias("monthly_cost"), "price_missing")


@query("storage_cost", sql=f"""
WITH v AS (SELECT label, len(embedding) * 4 + strlen(vec_id::VARCHAR) + coalesce(strlen(text), 0) AS b FROM embeddings LEFT JOIN documents ON vec_id = doc_id)
SELECT label, count(*) AS vectors, sum(b)::BIGINT AS bytes, round(sum(b) / 1e9 * 0.06, 12)::DOUBLE AS monthly_cost FROM v GROUP BY label""")
def _(t):
    docs = t.documents.select(F.col("doc_id").alias("vec_id"), "text")
    rows = T.storage_cost(t.embeddings.join(docs, "vec_id", "left"), ["vec_id", "text"], ["label"])
    return rows.withColumn("monthly_cost", F.round("monthly_cost", 12))


@query("response_audit", sql=f"""
WITH {shared.USAGE} SELECT model_id, count(*) AS messages, round(avg(CASE WHEN role = 'assistant' THEN 0 ELSE length(text) END), 6) AS mean_message, round(avg(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END), 6) AS mean_response,
  round(avg(cached::INT), 6) AS cached_share, round(avg(length(text) % 97 * 1.5::DOUBLE), 6) AS mean_latency FROM usage GROUP BY model_id""")
def _(t):
    reply = F.col("role") == "assistant"
    n = F.length("text")
    rows = shared.usage(t).select("model_id", "cached", F.when(reply, 0).otherwise(n).alias("message_length"), F.when(reply, n).otherwise(0).alias("response_length"), (n % 97 * 1.5).alias("latency_ms"))
    return T.response_audit(rows).select("model_id", "messages", *[F.round(c, 6).alias(c) for c in ("mean_message", "mean_response", "cached_share", "mean_latency")])


@query("cache_attribution", sql=f"""
WITH {shared.USAGE}, a AS (SELECT model_id, CASE WHEN cached THEN 'memory' WHEN input_tokens = 0 THEN 'model_cache' ELSE 'none' END AS src FROM usage)
SELECT model_id, count(*) AS answers, {', '.join(f"count_if(src = '{s}')::BIGINT AS {s}, round(count_if(src = '{s}')::DOUBLE / count(*), 6) AS {s}_share" for s in ('memory', 'model_cache', 'none'))} FROM a GROUP BY model_id""")
def _(t):
    rows = T.cache_attribution(shared.usage(t).select("model_id", F.col("cached").alias("memory_hit"), F.col("input_tokens").alias("billed_input_tokens")))
    for s in ("memory", "model_cache", "none"):
        rows = rows.withColumn(f"{s}_share", F.round(f"{s}_share", 6))
    return rows
