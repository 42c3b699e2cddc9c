"""Structured Streaming jobs. Each takes a stream and returns a stream or a started query.

Sinks are idempotent per micro-batch, so a job restarted after a lost executor
or driver repeats its last batch without doubling rows. Checkpoints and state go
to the shared folder. Micro-batch size is bounded at the source, which bounds
what a hot key can bring to one task at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.text import micros
from ..operators import chunk as C, cost as K, describe as D, screen as G
from ..session import scratch_path, tasks_for
from ..sources import corpus as S
from ..sources.store import KeyedTable, deal, put_vectors

LATENESS = "10 minutes"
MAX_FILES, MAX_BYTES = "1000", str(10 * 1024**3)
INGEST_TASK_BYTES, INGEST_MOST_TASKS = 16 * 1024 * 1024, 4096


# --- plumbing -------------------------------------------------------------------------


def table_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: str = MAX_FILES) -> DataFrame:
    """Parquet files as a stream, a bounded number per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def _file_stream(spark: SparkSession, path: str, max_bytes: str) -> DataFrame:
    files = (
        spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True)
        .option("maxBytesPerTrigger", max_bytes).load(path)
    )
    return files.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))


def document_stream(spark: SparkSession, path: str, exts: list[str], max_bytes: str = MAX_BYTES) -> DataFrame:
    """Text files as they arrive: doc_id, ext, text. Ids come from the path below ``path``, so files of one name stay apart.

    Sizes are known from the listing; a text that is too long is left out after
    reading. ``rejected_stream`` has what is left out.
    """
    named = _file_stream(spark, path, max_bytes).filter(S.supported_type(F.col("path"), exts))
    fits = S.size_reason(F.col("size"), F.lit(0)).isNull() & S.size_reason(F.lit(0), F.length("value")).isNull()
    return named.filter(fits).select(
        S.doc_id_from_path(S.below(F.col("path"), path)).alias("doc_id"), S.extension(F.col("path")).alias("ext"), F.col("value").alias("text"))


def rejected_stream(spark: SparkSession, path: str, exts: list[str], max_bytes: str = MAX_BYTES) -> DataFrame:
    """The files that ``document_stream`` leaves out, as they arrive: path, size, reject_reason."""
    named = _file_stream(spark, path, max_bytes)
    reason = F.when(~S.supported_type(F.col("path"), exts), "unsupported_type").otherwise(S.size_reason(F.col("size"), F.length("value")))
    return named.select("path", "size", reason.alias("reject_reason")).filter("reject_reason is not null")


def start(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append",
          interval: str | None = None) -> StreamingQuery:
    """Run ``write`` per micro-batch: on a clock with ``interval``, else until the source is drained."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def batch_writer(path: str, *partitions: str) -> Callable[[DataFrame, int], None]:
    """Write each micro-batch to its own folder, replacing what an earlier try left there."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out = batch.write.mode("overwrite")
        out = out.partitionBy(*partitions) if partitions else out
        out.parquet(f"{path}/batch_id={batch_id}")

    return write


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last written row per key, for sinks in update mode."""
    rows = spark.read.option("basePath", path).parquet(path)
    values = [c for c in rows.columns if c not in keys and c != "batch_id"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v")).select(*keys, "v.*")


def drain(stream: DataFrame, name: str, mode: str = "append", partitions: tuple[str, ...] = ()) -> str:
    """Run a stream to the end of its source and return the folder it wrote."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    query = start(stream, scratch_path(spark, f"{name}-state"), batch_writer(path, *partitions), mode)
    query.awaitTermination()
    return path


def timed(stream: DataFrame, lateness: str) -> DataFrame:
    """Event time for the engine: a zoned timestamp with a watermark."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


# --- W1: ingest ---------------------------------------------------------------------------


def ingest_chunks(documents: DataFrame, dim: int = 64, created_at: Column | None = None) -> DataFrame:
    """Documents to chunks ready to store: chunk, describe, embed, and what stands beside each chunk in its document."""
    chunks = C.chunk_sentence_overlap(documents, "doc_id", "text")
    # below the windows: a filter on the vectors would otherwise compute them once more for each of its conditions
    embedded = D.embed(D.describe(chunks), "content", dim=dim)
    stamp = created_at if created_at is not None else F.current_timestamp()
    return C.chunk_neighbours(embedded, "doc_id").withColumn("created_at", stamp)


def stream_ingest(documents: DataFrame, path: str, checkpoint: str, dim: int = 64, interval: str | None = None,
                  tasks: int | None = None) -> StreamingQuery:
    """Ingest documents as they arrive; a document that comes again, or a repeated micro-batch, replaces its rows.

    A micro-batch is dealt once, by document, to tasks of about ``INGEST_TASK_BYTES`` of its input, to ``tasks``
    at least and no fewer than the session's; chunks meet their neighbours there and are stored from there.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # a batch made by a join may be estimated far too large
        by_size = min(tasks_for(batch, INGEST_TASK_BYTES), INGEST_MOST_TASKS)
        put_vectors(ingest_chunks(deal(batch, max(tasks or 1, by_size)), dim), path)

    return start(documents, checkpoint, write, interval=interval)


# --- W2, W3, W5, W9: windows --------------------------------------------------------------------


def stream_metric_windows(metrics: DataFrame, width: str = "5 minutes", by: tuple[str, ...] = ("metric_name",),
                          lateness: str = LATENESS) -> DataFrame:
    """Tumbling sums per metric. Rows later than the watermark are dropped by the engine."""
    return K.metric_timeseries(timed(metrics, lateness), width, by)


def stream_alarms(metrics: DataFrame, width: str, statistic: str, limit: float, lateness: str = LATENESS) -> DataFrame:
    """Windows over a limit, emitted again as they grow (update mode)."""
    return K.threshold_alarms(timed(metrics, lateness), width, statistic, limit)


def stream_rate_limit(calls: DataFrame, source: str, limit: int, width: str = "60 seconds", slide: str = "10 seconds",
                      lateness: str = LATENESS) -> DataFrame:
    """Calls per source and sliding window, and whether they exceed the limit."""
    return (
        timed(calls, lateness).groupBy(F.window("ts", width, slide).alias("w"), source)
        .agg(F.count(F.lit(1)).alias("calls"))
        .select(F.col("w.start").alias("window_start"), source, "calls", (F.col("calls") > limit).alias("blocked"))
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows the engine dropped as later than the watermark, from the query's progress reports."""
    return sum(int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators)


def split_late(stream: DataFrame, path: str, checkpoint: str, width: str = "5 minutes", lateness: str = LATENESS,
               interval: str | None = None) -> StreamingQuery:
    """Two sinks below ``path``: ``on_time`` and ``late``, with all rows of the input between them.

    A row is late when its window of ``width`` had closed before its micro-batch:
    when the window's end is not after the latest time of all earlier
    micro-batches less ``lateness``. That mark is written per micro-batch, so a
    repeated one splits the same way. A row without a time is on time.
    """
    spark = stream.sparkSession
    marks = f"{path}/marks"

    def mark_before(batch_id: int) -> int | None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(marks)
        files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
        earlier = [n.split("-") for n in names if int(n.split("-")[0]) < batch_id]
        return max((int(us) for _, us in earlier), default=None)

    length = lambda text: int(spark.sql(f"SELECT unix_micros(TIMESTAMP_SECONDS(0) + INTERVAL {text})").first()[0])
    wide, slack = length(width), length(lateness)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("_end", (F.floor(micros(F.col("ts")) / wide) + 1) * wide)
        seen = mark_before(batch_id)
        bound = None if seen is None else seen - slack
        late = F.lit(False) if bound is None else F.coalesce(F.col("_end") <= bound, F.lit(False))
        rows.withColumn("sink", F.when(late, "late").otherwise("on_time")).drop("_end").write.mode("overwrite").partitionBy("sink").parquet(
            f"{path}/rows/batch_id={batch_id}")
        latest_us = batch.agg(F.max(micros(F.col("ts")))).first()[0]
        if latest_us is not None or seen is not None:
            mark = spark._jvm.org.apache.hadoop.fs.Path(f"{marks}/{batch_id}-{max(x for x in (latest_us, seen) if x is not None)}")
            mark.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).createNewFile(mark)

    return start(stream, checkpoint, write, interval=interval)


def split_rows(spark: SparkSession, path: str, sink: str) -> DataFrame:
    """What ``split_late`` wrote to one of its sinks."""
    return spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows").filter(F.col("sink") == sink).drop("sink", "batch_id")


# --- W4: conversations -------------------------------------------------------------------------------


def stream_conversation_state(usage: DataFrame) -> DataFrame:
    """Running totals per conversation, kept for ever (update mode)."""
    return K.conversation_cost(usage)


class _Totals(StatefulProcessor):
    """Per key: totals since its first row. A timer ends them once nothing came for the gap, by event time."""

    def __init__(self, key: str, values: list[str], gap_us: int):
        self.key, self.values, self.gap_us = key, values, gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [T.StructField(c, T.DoubleType()) for c in self.values]
        self.state = handle.getValueState("totals", T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in ("part", "rows", "start_us", "last_us")]]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sums, n, low, high = np.zeros(len(self.values)), 0, None, None
        for r in rows:
            sums += r[self.values].sum().to_numpy(dtype=float)
            n += len(r)
            a, b = int(r["ts_us"].min()), int(r["ts_us"].max())
            low, high = a if low is None else min(low, a), b if high is None else max(high, b)
        part = low
        if self.state.exists():
            *old, began, before, start, last = self.state.get()
            self.handle.deleteTimer((last + self.gap_us) // 1000)
            if low <= last + self.gap_us:  # else the pause came before its timer
                sums, part, n, low, high = sums + np.array(old), began, n + before, min(low, start), max(high, last)
        self.state.update((*map(float, sums), part, n, low, high))
        self.handle.registerTimer((high + self.gap_us) // 1000)
        yield pd.DataFrame({self.key: [key[0]], "part": [part], **{c: [float(x)] for c, x in zip(self.values, sums)}, "rows": [n], "start_us": [low], "last_us": [high]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_totals(rows: DataFrame, key: str, values: list[str], path: str, checkpoint: str, gap_seconds: int = 3600,
                  lateness: str = LATENESS, interval: str | None = None, every: int = 20) -> StreamingQuery:
    """Running totals per key whose state ends with a pause, and the last of them in a keyed table at ``path``.

    A row of the table is one key and ``part``, the time its state began; totals
    per key are sums over its parts (``read_totals``). Needs the RocksDB state
    store. A repeated micro-batch writes the same rows again.
    """
    spark = rows.sparkSession
    table = KeyedTable(spark, path, [key, "part"], every)
    fields = [rows.schema[key], T.StructField("part", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in values]]
    out = T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in ("rows", "start_us", "last_us")]])
    picked = timed(rows, lateness).select(key, "ts", micros(F.col("ts")).alias("ts_us"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in values])
    totals = picked.groupBy(key).transformWithStateInPandas(
        _Totals(key, values, gap_seconds * 1_000_000), outputStructType=out, outputMode="update", timeMode="eventTime")
    return start(totals, checkpoint, lambda batch, batch_id: table.upsert(batch), "update", interval)


def read_totals(spark: SparkSession, path: str, key: str, values: list[str]) -> DataFrame:
    """Totals per key over all its parts."""
    return KeyedTable(spark, path, [key, "part"]).read().groupBy(key).agg(
        *[F.sum(c).alias(c) for c in values], F.sum("rows").alias("rows"), F.min("start_us").alias("start_us"), F.max("last_us").alias("last_us"))


def stream_sessions(usage: DataFrame, gap: str, value: str, lateness: str = LATENESS) -> DataFrame:
    """Bounded form: a conversation's state ends with a pause longer than ``gap``."""
    return (
        timed(usage, lateness).groupBy(F.session_window("ts", gap).alias("w"), "conversation_id")
        .agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total"))
        .select("conversation_id", F.col("w.start").alias("session_start"), "events", "total")
    )


# --- W6: reuse within a life time -----------------------------------------------------------------------


class _TtlReuse(StatefulProcessor):
    """Per key: until when the entry lives. A timer clears the state when the entry ends."""

    def __init__(self, ttl_us: int, key: str):
        self.ttl_us, self.key = ttl_us, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alive = handle.getValueState("alive", T.StructType([T.StructField("until", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ts = np.sort(np.concatenate([r["ts_us"].to_numpy() for r in rows]))
        before = self.alive.get()[0] if self.alive.exists() else None
        until, i = before, 0
        inserted = np.zeros(len(ts), dtype=bool)
        i = 0 if until is None else int(np.searchsorted(ts, until, side="left"))
        while i < len(ts):
            inserted[i] = True
            until = int(ts[i]) + self.ttl_us
            i = int(np.searchsorted(ts, until, side="left"))
        if until != before:
            if before is not None:
                self.handle.deleteTimer(before // 1000 + 1)
            self.alive.update((until,))
            self.handle.registerTimer(until // 1000 + 1)
        yield pd.DataFrame({self.key: key[0], "ts_us": ts, "inserted": inserted})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.alive.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_ttl_reuse(requests: DataFrame, key: str, ttl_seconds: int, lateness: str = LATENESS) -> DataFrame:
    """Exact: each request with whether it inserts an entry. Needs the RocksDB state store."""
    kind = requests.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("ts_us", T.LongType()), T.StructField("inserted", T.BooleanType())])
    rows = timed(requests, lateness).select(key, "ts", micros(F.col("ts")).alias("ts_us"))
    return rows.groupBy(key).transformWithStateInPandas(
        _TtlReuse(ttl_seconds * 1_000_000, key), outputStructType=out, outputMode="append", timeMode="eventTime")


def stream_ttl_dedupe(requests: DataFrame, key: str, ttl: str) -> DataFrame:
    """Near form: one request per key while the watermark remembers it."""
    return timed(requests, ttl).dropDuplicatesWithinWatermark([key])


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# --- W7, W8: sinks ------------------------------------------------------------------------------------------


def stream_metric_sink(metrics: DataFrame, path: str, checkpoint: str, interval: str | None = "60 seconds") -> StreamingQuery:
    """Each flush writes its metrics with batch numbers, a folder per namespace."""

    def write(batch: DataFrame, batch_id: int) -> None:
        K.metric_batches(batch).write.mode("overwrite").partitionBy("namespace").parquet(f"{path}/batch_id={batch_id}")

    return start(metrics, checkpoint, write, interval=interval)


def screened(messages: DataFrame, text: str) -> DataFrame:
    """Messages with outcome rejected, accepted, or moderate; one pass feeds all sinks."""
    rows = G.screen_message(messages, text)
    outcome = F.when(F.col("reason").isNotNull(), "rejected").when(G.needs_moderation(F.col(text)), "moderate").otherwise("accepted")
    return rows.withColumn("outcome", outcome)


def stream_screen(messages: DataFrame, text: str, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """One folder per outcome."""
    return start(screened(messages, text), checkpoint, batch_writer(path, "outcome"), interval=interval)
