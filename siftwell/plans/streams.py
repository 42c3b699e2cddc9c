"""Streams: W1 to W9, run to the end of a given table and compared with the batch result."""

from pyspark.sql import functions as F

from ..functions.text import micros
from ..operators import cost as K
from ..session import scratch_path
from ..sources.store import read_vectors
from ..streaming import jobs as J
from . import chunking, screening, shared, sqltext as S, usage
from .registry import Tables, query


class _Streams(Tables):
    """The given tables as streams, for the same derivations as in batch."""

    def __getattr__(self, name):
        batch = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return J.table_stream(self.spark, f"{self.folder}/{name}[.]parquet", batch.schema)


def _streams(t):
    return _Streams(t.spark, t.folder)


@query("stream_ingest", sql=f"""
WITH {chunking.OVERLAP_SQL}, c AS ({chunking.ROWS}),
d AS (SELECT *, {S.heading('content')} AS heading, {S.kind('content')} AS chunk_type, {S.entities('content')} AS ents, {S.topics('content')} AS tops FROM c)
SELECT doc_id || '_chunk_' || chunk_index AS key, doc_id::VARCHAR AS doc_id, chunk_index, chunk_type, substr(content, 1, 500) AS content, substr(heading, 1, 100) AS heading,
  round({S.importance('content', 'chunk_type', 'ents')}, 6) AS importance_score, substr({S.summary('content', 'heading', 'chunk_type')}, 1, 200) AS context_summary, 64::INT AS dimension FROM d""")
def _(t):
    docs = _streams(t).documents
    path, state = scratch_path(t.spark, "ingest"), scratch_path(t.spark, "ingest-state")
    J.stream_ingest(docs, path, state, tasks=t.spark.sparkContext.defaultParallelism).awaitTermination()
    return read_vectors(t.spark, path).select(
        "key", "doc_id", "chunk_index", "chunk_type", "content", "heading", "importance_score", "context_summary", F.size("embedding").alias("dimension"))


def _closed(width):
    return f"""WITH {shared.METRICS}, w AS (SELECT time_bucket(INTERVAL '{width}', ts) AS s, metric_name, sum(value) AS total, count(*) AS samples, max(value) AS peak FROM metrics GROUP BY ALL)
SELECT epoch_us(s) AS window_us, metric_name, round(total, 4) AS total, samples, peak FROM w WHERE s + INTERVAL '{width}' <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM metrics)"""


def _windows(t, width):
    path = J.drain(J.stream_metric_windows(shared.metrics(_streams(t)).drop("user_id"), width), "windows")
    rows = t.spark.read.parquet(path)
    return rows.select(micros(F.col("window_start")).alias("window_us"), "metric_name", F.round("total", 4).alias("total"), "samples", "peak")


@query("stream_metric_windows", sql=_closed("5 minutes"))
def _(t):
    return _windows(t, "5 minutes")


@query("stream_metric_windows_15m", sql=_closed("15 minutes"))
def _(t):
    return _windows(t, "15 minutes")


def _alarm_sql(width, statistic, limit):
    return f"""WITH {shared.METRICS}, w AS (SELECT epoch_us(time_bucket(INTERVAL '{width}', ts)) AS window_us, metric_name, sum(value) AS total, max(value) AS peak FROM metrics WHERE metric_name = 'ConversationCost' GROUP BY ALL)
SELECT window_us, metric_name, round(total, 4) AS total, peak FROM w WHERE {statistic} > {limit}"""


def _alarms(t, width, statistic, limit):
    cost = shared.metrics(_streams(t)).filter("metric_name = 'ConversationCost'")
    path = J.drain(J.stream_alarms(cost, width, statistic, limit), "alarms", "update")
    rows = J.latest(t.spark, path, ["window_start", "metric_name"])
    return rows.select(micros(F.col("window_start")).alias("window_us"), "metric_name", F.round("total", 4).alias("total"), "peak")


@query("stream_alarms_daily", sql=_alarm_sql("24 hours", "total", 5.0))
def _(t):
    return _alarms(t, "24 hours", "total", 5.0)


@query("stream_alarms_peak", sql=_alarm_sql("5 minutes", "peak", 0.1))
def _(t):
    return _alarms(t, "5 minutes", "peak", 0.1)


@query("stream_conversation_state", sql=f"""
WITH {shared.USAGE} SELECT conversation_id, sum(total_tokens)::BIGINT AS total_tokens, round(sum(gross_cost), 9) AS gross_cost, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us FROM costed GROUP BY conversation_id""")
def _(t):
    spent = K.token_cost(shared.usage(_streams(t)), K.price_table(t.spark))
    path = J.drain(J.stream_conversation_state(spent), "conversations", "update")
    rows = J.latest(t.spark, path, ["conversation_id"])
    return rows.select("conversation_id", F.col("total_tokens").cast("bigint"), F.round("gross_cost", 9).alias("gross_cost"),
                       micros(F.col("start_time")).alias("start_us"), micros(F.col("last_activity")).alias("last_us"))


@query("stream_sessions", sql="""
WITH e AS (SELECT event_type AS conversation_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 20 MINUTES THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY conversation_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e),
g AS (SELECT conversation_id, n, min(ts) AS a, max(ts) AS b, count(*) AS events, sum(value) AS total FROM s GROUP BY ALL)
SELECT conversation_id, epoch_us(a) AS start_us, events, round(total, 4) AS total FROM g WHERE b + INTERVAL 20 MINUTES <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM events)""")
def _(t):
    events = _streams(t).events.select(F.col("event_type").alias("conversation_id"), "ts", "value")
    path = J.drain(J.stream_sessions(events, "20 minutes", "value"), "sessions")
    return t.spark.read.parquet(path).select("conversation_id", micros(F.col("session_start")).alias("start_us"), "events", F.round("total", 4).alias("total"))


@query("stream_rate_limit", sql="""
WITH w AS (SELECT time_bucket(INTERVAL 10 SECONDS, ts) - INTERVAL 1 SECOND * 10 * i AS s, event_type FROM events, range(6) r(i))
SELECT epoch_us(s) AS window_us, event_type, count(*) AS calls, count(*) > 1 AS blocked FROM w WHERE s + INTERVAL 60 SECONDS <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM events) GROUP BY ALL""")
def _(t):
    path = J.drain(J.stream_rate_limit(_streams(t).events, "event_type", 1), "rates")
    return t.spark.read.parquet(path).select(micros(F.col("window_start")).alias("window_us"), "event_type", "calls", "blocked")


@query("stream_ttl_reuse", sql=f"WITH RECURSIVE x AS (SELECT 1), {usage._ttl_sql(7200).replace('WITH RECURSIVE ', '', 1).strip().replace('SELECT l.cache_type, l.us AS ts_us, n::BIGINT AS requests, (n - CASE WHEN ins.us IS NULL THEN 0 ELSE 1 END)::BIGINT AS hits,', 'SELECT l.cache_type, l.us AS ts_us,')}")
def _(t):
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.ROCKSDB)
    try:
        requests = _streams(t).events.select(F.col("event_type").alias("cache_type"), "ts")
        path = J.drain(J.stream_ttl_reuse(requests, "cache_type", 7200), "ttl")
    finally:
        t.spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return t.spark.read.parquet(path).select("cache_type", "ts_us", "inserted")


@query("stream_ttl_dedupe", sql="SELECT user_id FROM events GROUP BY user_id")
def _(t):
    path = J.drain(J.stream_ttl_dedupe(_streams(t).events.select("user_id", "ts"), "user_id", "60 days"), "dedupe")
    return t.spark.read.parquet(path).select("user_id")


@query("stream_metric_sink", sql=f"""
WITH {shared.METRICS} SELECT metric_id, namespace, (row_number() OVER (PARTITION BY namespace ORDER BY ts, metric_id) - 1) // 20 AS batch_no FROM metrics""")
def _(t):
    path = scratch_path(t.spark, "sink")
    J.stream_metric_sink(shared.metrics(_streams(t)), path, scratch_path(t.spark, "sink-state"), interval=None).awaitTermination()
    return t.spark.read.parquet(path).select("metric_id", "namespace", "batch_no")


@query("stream_screen", sql=f"""
WITH {screening.MESSAGES}, r AS (SELECT conv_id, turn, message, CASE WHEN {S.strip('message')} = '' THEN 'empty' WHEN length(message) > 2000 THEN 'too_long' WHEN {screening._match('message', screening.R.UNSAFE_INPUT)} THEN 'unsafe' END AS reason FROM messages)
SELECT conv_id, turn, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN length({S.strip('message')}) >= 18 AND NOT {S.either('lower(message)', screening.R.DOCUMENT_KEYWORDS)} THEN 'moderate' ELSE 'accepted' END AS outcome FROM r""")
def _(t):
    path = scratch_path(t.spark, "screen")
    J.stream_screen(screening._messages(_streams(t)), "message", path, scratch_path(t.spark, "screen-state")).awaitTermination()
    return t.spark.read.parquet(path).select("conv_id", "turn", "outcome")


@query("stream_late_data", sql=_closed("5 minutes").replace("SELECT epoch_us(s)", "SELECT (SELECT count(*) FROM events e WHERE e.ts < (SELECT min(ts) + INTERVAL 1 DAY FROM events))::BIGINT AS resent, epoch_us(s)"))
def _(t):
    """The table arrives in two parts, then its first day once more: those rows are late and change nothing."""
    folder = scratch_path(t.spark, "late")
    events = t.events
    t0 = events.agg(F.min("ts")).first()[0]
    age = events.withColumn("age", F.timestamp_diff("HOUR", F.lit(t0).cast("timestamp_ntz"), F.col("ts")))
    for part, rows in enumerate(["age < 360", "age >= 360", "age < 24"]):
        age.filter(rows).drop("age").coalesce(1).write.parquet(f"{folder}/part={part}")
    resent = age.filter("age < 24").count()

    class Late(Tables):
        def __getattr__(self, name):
            return J.table_stream(t.spark, f"{folder}/*/*.parquet", events.schema, "1")

    stream = J.stream_metric_windows(shared.metrics(Late(t.spark, folder)).drop("user_id"))
    rows = t.spark.read.parquet(J.drain(stream, "late-out"))
    return rows.select(F.lit(resent).cast("bigint").alias("resent"), micros(F.col("window_start")).alias("window_us"), "metric_name",
                       F.round("total", 4).alias("total"), "samples", "peak")


@query("stream_totals", sql=f"""
WITH {shared.USAGE} SELECT conversation_id, sum(total_tokens)::BIGINT AS total_tokens, round(sum(gross_cost), 9) AS gross_cost, count(*) AS rows, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us FROM costed GROUP BY conversation_id""")
def _(t):
    """Totals whose state ends after an hour's pause, the last row per conversation in a keyed table."""
    spent, path = K.token_cost(shared.usage(_streams(t)), K.price_table(t.spark)), scratch_path(t.spark, "totals")
    values = ["total_tokens", "gross_cost"]
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.ROCKSDB)
    try:
        J.stream_totals(spent, "conversation_id", values, path, scratch_path(t.spark, "totals-state")).awaitTermination()
    finally:
        t.spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    rows = J.read_totals(t.spark, path, "conversation_id", values)
    return rows.select("conversation_id", F.col("total_tokens").cast("bigint"), F.round("gross_cost", 9).alias("gross_cost"), "rows", "start_us", "last_us")


@query("stream_late_rows", sql="""
WITH e AS (SELECT event_type, ts < (SELECT min(ts) + INTERVAL 1 DAY FROM events) AS again FROM events)
SELECT event_type, count(*) AS on_time, count_if(again)::BIGINT AS late, (count(*) + count_if(again))::BIGINT AS rows FROM e GROUP BY event_type""")
def _(t):
    """The table, then its first day once more: late rows are kept beside the others, and both together are the input."""
    folder, path = scratch_path(t.spark, "late-in"), scratch_path(t.spark, "late-split")
    first = t.events.agg(F.min("ts")).first()[0]
    again = t.events.filter(F.timestamp_diff("HOUR", F.lit(first).cast("timestamp_ntz"), F.col("ts")) < 24)
    for part, rows in enumerate((t.events, again)):
        rows.coalesce(1).write.parquet(f"{folder}/part={part}")
    stream = J.table_stream(t.spark, f"{folder}/*/*.parquet", t.events.schema, "1")
    J.split_late(stream, path, scratch_path(t.spark, "late-split-state")).awaitTermination()
    counts = lambda sink: J.split_rows(t.spark, path, sink).groupBy("event_type").agg(F.count(F.lit(1)).alias(sink))
    both = counts("on_time").join(counts("late"), "event_type", "left").fillna(0, ["late"])
    return both.withColumn("rows", F.col("on_time") + F.col("late"))
