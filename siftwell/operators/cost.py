"""Token cost, usage, metric windows, alarms, rate limits and cache reuse.

Aggregations combine before the shuffle. Where a rule needs the order of one
key's rows, that key is cut into time blocks, so a hot key spreads over tasks.
"""

from __future__ import annotations

import pandas as pd
import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import rules as R
from ..functions.text import micros

SECOND = 1_000_000


def price_table(spark: SparkSession, prices: list[tuple] | None = None) -> DataFrame:
    """The price list as a table: base_model, input_per_1k, output_per_1k. A handful of fixed rows."""
    return spark.createDataFrame(prices or R.PRICES, "base_model string, input_per_1k double, output_per_1k double")


def token_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Add gross_cost, net_cost (0 for a cached answer) and price_missing.

    ``usage`` has model_id, input_tokens, output_tokens and cached; the version
    after the colon of a model is ignored.
    """
    priced = usage.withColumn("base_model", F.substring_index("model_id", ":", 1)).join(prices, "base_model", "left")
    gross = (
        F.col("input_tokens") / 1000 * F.coalesce("input_per_1k", F.lit(0.0))
        + F.col("output_tokens") / 1000 * F.coalesce("output_per_1k", F.lit(0.0))
    )
    return (
        priced.withColumn("price_missing", F.col("input_per_1k").isNull())
        .withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
        .withColumn("gross_cost", gross)
        .withColumn("net_cost", F.when(F.col("cached"), 0.0).otherwise(F.col("gross_cost")))
        .drop("input_per_1k", "output_per_1k")
    )


def vector_query_cost(df: DataFrame, count: str, hit: str) -> DataFrame:
    """Add gross_cost and net_cost (0 for a cache hit)."""
    return df.withColumn("gross_cost", F.col(count) * R.VECTOR_QUERY_PRICE).withColumn(
        "net_cost", F.when(F.col(hit), 0.0).otherwise(F.col("gross_cost")))


def cache_events(log: DataFrame, keep: list[str]) -> DataFrame:
    """Long form of a cache log: a hit or miss row each, and the saved cost of a hit as negative cost."""
    row = lambda name, value, unit: F.struct(
        F.lit(name).alias("metric_name") if isinstance(name, str) else name.alias("metric_name"),
        value.cast("double").alias("value"), F.lit(unit).alias("unit"))
    kind = F.when(F.col("hit"), "CacheHit").otherwise("CacheMiss")
    saved = F.when(F.col("hit") & (F.col("cost_saved") > 0), row("ConversationCost", -F.col("cost_saved"), "USD"))
    rows = F.filter(F.array(row(kind, F.lit(1), "Count"), saved), lambda r: r.isNotNull())
    return log.select(*keep, F.explode(rows).alias("m")).select(*keep, "m.*")


def api_call_stats(calls: DataFrame, api: str, duration: str) -> DataFrame:
    """Calls and durations by API type. Quantiles come from mergeable sketches."""
    d = F.when(F.col(duration) > 0, F.col(duration))
    return calls.groupBy(api).agg(
        F.count(F.lit(1)).alias("calls"), F.count(d).alias("timed_calls"), F.sum(d).alias("total_ms"), F.avg(d).alias("mean_ms"),
        F.percentile_approx(d, 0.5).alias("p50_ms"), F.percentile_approx(d, 0.95).alias("p95_ms"))


SKETCH_K = 200  # a sketch of this size states ranks within RANK_ERROR, whatever the number of values and merges
RANK_ERROR = 0.02


def quantile_sketches(rows: DataFrame, keys: list[str], value: str, ts: str = "ts", every: str = "1 day") -> DataFrame:
    """One small sketch of the values per key and window of time, to be stored and merged later: keys, window_start, n, sketch."""
    start = F.window(F.col(ts).cast("timestamp"), every).start.alias("window_start")
    return rows.filter(F.col(value).isNotNull()).groupBy(*keys, start).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), SKETCH_K).alias("sketch"))


def merged_quantiles(sketches: DataFrame, keys: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Quantiles over all stored windows of each key; ``quantiles`` maps a column's name to its share."""
    whole = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", SKETCH_K).alias("s"))
    return whole.select(*keys, "n", *[F.kll_sketch_get_quantile_double("s", F.lit(float(q))).alias(c) for c, q in quantiles.items()])


def conversation_cost(usage: DataFrame) -> DataFrame:
    """Totals per conversation. ``usage`` rows carry whichever counters they have; missing ones count 0."""
    total = lambda name, zero=0: F.sum(F.coalesce(F.col(name), F.lit(zero))).alias(name) if name in usage.columns else F.lit(zero).alias(name)
    times = [F.min("ts").alias("start_time"), F.max("ts").alias("last_activity")] if "ts" in usage.columns else []
    return usage.groupBy("conversation_id").agg(
        total("total_tokens"), total("vector_queries"), total("cache_hits"), total("cache_misses"),
        total("gross_cost", 0.0), total("net_cost", 0.0), *times)


def cost_summary(conversations: DataFrame) -> DataFrame:
    """One row over all conversations."""
    c = F.col
    sums = conversations.agg(
        F.count(F.lit(1)).alias("total_conversations"), F.sum("gross_cost").alias("cost"),
        F.sum("total_tokens").alias("total_tokens"), F.sum("vector_queries").alias("total_vector_queries"),
        F.sum("cache_hits").alias("hits"), F.sum("cache_misses").alias("misses"))
    seen = c("hits") + c("misses")
    return sums.select(
        "total_conversations", F.round("cost", 6).alias("total_cost_estimate"), "total_tokens", "total_vector_queries",
        F.when(seen > 0, F.round(c("hits") / seen, 3)).otherwise(0.0).alias("cache_hit_rate"),
        F.when(c("total_conversations") > 0, F.round(c("cost") / c("total_conversations"), 6)).otherwise(0.0).alias("average_cost_per_conversation"))


def top_conversations(conversations: DataFrame, n: int = 10) -> DataFrame:
    """The n dearest conversations: a take-ordered, not a full sort."""
    return conversations.orderBy(F.desc("gross_cost"), "conversation_id").limit(n)


def hit_rate_by_cache(log: DataFrame) -> DataFrame:
    return log.groupBy("cache_type").agg(
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.count(F.lit(1)).alias("total")
    ).withColumn("hit_ratio", F.col("hits") / F.col("total"))


def tokens_by_model(usage: DataFrame) -> DataFrame:
    return usage.groupBy("model_id").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), F.count(F.lit(1)).alias("uses"))


# --- time windows ------------------------------------------------------------------


def metric_timeseries(metrics: DataFrame, width: str = "5 minutes", by: tuple[str, ...] = ("metric_name",)) -> DataFrame:
    """Sum, count and maximum per metric and tumbling window."""
    return metrics.groupBy(F.window("ts", width).alias("w"), *by).agg(
        F.sum("value").alias("total"), F.count(F.lit(1)).alias("samples"), F.max("value").alias("peak")
    ).select(F.col("w.start").alias("window_start"), *by, "total", "samples", "peak")


def threshold_alarms(metrics: DataFrame, width: str, statistic: str, limit: float, by: tuple[str, ...] = ("metric_name",)) -> DataFrame:
    """Windows whose statistic (total or peak) exceeds the limit."""
    return metric_timeseries(metrics, width, by).filter(F.col(statistic) > limit)


def consecutive_alarms(metrics: DataFrame, seconds: int, limit: float, periods: int = 2, by: str = "metric_name") -> DataFrame:
    """Alarm where the window sum exceeds the limit in this and the preceding windows without a gap.

    Windows are numbered and joined to themselves shifted, on (metric, number):
    the time line of one metric is never gathered in a task.
    """
    number = F.floor(micros(F.col("ts")) / (seconds * SECOND))
    over = metrics.groupBy(by, number.alias("period")).agg(F.sum("value").alias("total")).filter(F.col("total") > limit)
    out = over
    for back in range(1, periods):
        out = out.join(over.select(by, (F.col("period") + back).alias("period")), [by, "period"], "left_semi")
    return out


def cost_alarms(metrics: DataFrame) -> DataFrame:
    """Daily sum and five-minute peak of conversation cost over their limits."""
    cost = metrics.filter(F.col("metric_name") == "ConversationCost")
    daily = threshold_alarms(cost, "24 hours", "total", R.DAILY_COST_ALARM).withColumn("alarm", F.lit("daily_cost"))
    single = threshold_alarms(cost, "5 minutes", "peak", R.CONVERSATION_COST_ALARM).withColumn("alarm", F.lit("conversation_cost"))
    return daily.unionByName(single)


def _ordered_blocks(df: DataFrame, key: str, block_seconds: int) -> DataFrame:
    return df.withColumn("_us", micros(F.col("ts"))).withColumn("_block", F.floor(F.col("_us") / (block_seconds * SECOND)))


def metric_batches(metrics: DataFrame, size: int = R.METRIC_BATCH, key: str = "namespace", tie: str = "metric_id",
                   block_seconds: int = 60) -> DataFrame:
    """Add batch_no: batches of ``size`` in time order per namespace.

    Rows are numbered inside (namespace, minute) and shifted by the rows of the
    earlier minutes, so one namespace may hold most rows of the table; what is
    summed up per namespace is one count a minute, whatever the volume.
    """
    rows = _ordered_blocks(metrics, key, block_seconds)
    counts = rows.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(key, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    order = W.partitionBy(key, "_block").orderBy("_us", tie)
    numbered = rows.withColumn("_rn", F.row_number().over(order)).join(offsets, [key, "_block"])
    return numbered.withColumn("batch_no", F.floor((F.col("_offset") + F.col("_rn") - 1) / size)).drop(
        "_us", "_block", "_rn", "_offset")


def sliding_rate(calls: DataFrame, source: str, window_seconds: int = 60, limit: int = R.MAX_CALLS_PER_MINUTE,
                 block_seconds: int | None = None) -> DataFrame:
    """Add recent_calls (this one and those at most ``window_seconds`` older) and blocked.

    Calls are counted per source and instant. Each instant then stands twice in
    its source's time line: as itself, with its count, and just before its window
    opens, with none; the difference of the running totals there is the count of
    the window. Running totals are taken inside blocks of time and shifted by the
    totals of the blocks before, so a task holds the instants of one block of a
    source, however many calls they have and however long the window is.
    """
    span, width = window_seconds * SECOND, (block_seconds or max(1, window_seconds // 4)) * SECOND
    at = calls.groupBy(F.col(source).alias("_s"), micros(F.col("ts")).alias("_us")).agg(F.count(F.lit(1)).alias("_n"))
    ends = F.array(
        F.struct(F.col("_us").alias("_at"), F.col("_n"), F.lit(1).alias("_sign")),
        F.struct((F.col("_us") - span - 1).alias("_at"), F.lit(0).cast("long").alias("_n"), F.lit(-1).alias("_sign")))
    line = at.select("_s", "_us", F.explode(ends).alias("_e")).select("_s", "_us", "_e.*").withColumn("_block", F.floor(F.col("_at") / width))
    sums = line.groupBy("_s", "_block").agg(F.sum("_n").alias("_n"))
    before = W.partitionBy("_s").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("_s").alias("_s2"), F.col("_block").alias("_b2"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = W.partitionBy("_s", "_block").orderBy("_at").rangeBetween(W.unboundedPreceding, W.currentRow)
    line = line.withColumn("_total", F.sum("_n").over(inside))
    line = line.join(sums, F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_block") == F.col("_b2")))
    recent = line.groupBy("_s", "_us").agg(F.sum((F.col("_total") + F.col("_shift")) * F.col("_sign")).alias("recent_calls"))
    return (
        calls.withColumn("_at", micros(F.col("ts"))).join(recent, F.col(source).eqNullSafe(F.col("_s")) & (F.col("_at") == F.col("_us")))
        .drop("_at", "_s", "_us").withColumn("blocked", F.col("recent_calls") > limit)
    )


def collector_error_rate(events: DataFrame, outcome: str) -> DataFrame:
    """One row: collected, sent, dropped, errors and errors per collected metric."""
    n = lambda kind: F.count_if(F.col(outcome) == kind)
    return events.agg(
        F.count(F.lit(1)).alias("collected"), n("sent").alias("sent"), n("dropped").alias("dropped"), n("error").alias("errors")
    ).withColumn("error_rate", F.col("errors") / F.greatest(F.col("collected"), F.lit(1)))


# --- cache keys and reuse ----------------------------------------------------------------


def cache_key(kind: Column, canonical: Column) -> Column:
    """``type:md5``, or null where the key names something sensitive."""
    from .screen import sensitive_key

    return F.when(~sensitive_key(canonical), F.concat(kind, F.lit(":"), F.md5(canonical)))


def prompt_key(prompt: Column, model_id: Column) -> Column:
    return F.sha2(F.concat(prompt, F.lit(":"), model_id), 256)


def context_key(embedding: Column, limit: int, threshold: float) -> Column:
    """Hash of the first ten dimensions (six decimals), limit and threshold."""
    head = F.transform(F.slice(embedding, 1, 10), lambda x: F.format_string("%.6f", x.cast("double")))
    return F.sha2(F.concat(F.array_join(head, ","), F.lit(f":{limit}:{threshold}")), 256)


def canonical_json(keyed: Column) -> Column:
    """A string map as JSON text with sorted keys."""
    entries = F.array_sort(F.map_entries(keyed))
    quoted = lambda s: F.concat(F.lit('"'), s, F.lit('"'))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(": "), quoted(e["value"]))), ", "), F.lit("}"))


def _chain_next(ts: np.ndarray, ttl: int) -> np.ndarray:
    """For each request, the first one that no longer finds the entry it would insert."""
    return np.searchsorted(ts, ts + ttl, side="left")


def ttl_reuse(requests: DataFrame, key: str, ttl_seconds: int, block_seconds: int | None = None) -> DataFrame:
    """Requests per (key, time) with hits: a hit finds an entry younger than its life, counted from insertion.

    Which request inserts depends on the one before it, so a key's requests form a
    chain. The chain is cut into time blocks. Each block is first summed up as a
    short step function (entry still alive until e -> entry alive until e'), the
    blocks' functions are chained per key, and each block is then walked with its
    true start. A key may hold most rows; only its step functions come together.
    Returns key, ts_us, requests, hits, inserted.
    """
    ttl = ttl_seconds * SECOND
    width = (block_seconds or 4 * ttl_seconds) * SECOND
    key_type = requests.schema[key].dataType.simpleString()
    times = (
        requests.groupBy(key, micros(F.col("ts")).alias("ts_us")).agg(F.count(F.lit(1)).alias("requests"))
        .withColumn("block", F.floor(F.col("ts_us") / width))
    )

    def summarise(group: pd.DataFrame) -> pd.DataFrame:
        ts = np.sort(group["ts_us"].to_numpy())
        nxt = _chain_next(ts, ttl)
        last = np.arange(len(ts))
        for i in range(len(ts) - 1, -1, -1):
            if nxt[i] < len(ts):
                last[i] = last[nxt[i]]
        # entry times lie before block start + ttl, so later first hits share one step
        upto = int(np.searchsorted(ts, group["block"].iloc[0] * width + ttl, side="left"))
        starts = np.arange(min(upto + 1, len(ts)))
        leave = ts[last[starts]] + ttl
        edge = np.r_[leave[1:] != leave[:-1], True]
        return pd.DataFrame({
            key: [group[key].iloc[0]], "block": [group["block"].iloc[0]],
            "until": [ts[starts][edge].tolist()], "leave": [leave[edge].tolist()],
        })

    steps = times.groupBy(key, "block").applyInPandas(
        summarise, f"{key} {key_type}, block bigint, until array<bigint>, leave array<bigint>")
    chained = steps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block", "until", "leave"))).alias("blocks"))
    zero = F.struct(F.lit(-(2**62)).cast("bigint").alias("alive"), F.array().cast("array<struct<block:bigint,alive:bigint>>").alias("seen"))

    def follow(acc, b):
        at = F.array_position(F.transform(b["until"], lambda u: u >= acc["alive"]), F.lit(True))
        leave = F.when(at > 0, F.try_element_at(b["leave"], at.cast("int"))).otherwise(acc["alive"])
        return F.struct(leave.alias("alive"), F.concat(acc["seen"], F.array(F.struct(b["block"].alias("block"), acc["alive"].alias("alive")))).alias("seen"))

    entries = chained.select(key, F.explode(F.aggregate("blocks", zero, follow, lambda a: a["seen"])).alias("e")).select(key, "e.block", "e.alive")

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ts_us", ignore_index=True)
        ts = group["ts_us"].to_numpy()
        inserted = np.zeros(len(ts), dtype=bool)
        i = int(np.searchsorted(ts, group["alive"].iloc[0], side="left"))
        nxt = _chain_next(ts, ttl)
        while i < len(ts):
            inserted[i] = True
            i = int(nxt[i])
        return pd.DataFrame({
            key: group[key], "ts_us": ts, "requests": group["requests"],
            "hits": group["requests"] - inserted.astype("int64"), "inserted": inserted,
        })

    return times.join(entries, [key, "block"]).groupBy(key, "block").applyInPandas(
        walk, f"{key} {key_type}, ts_us bigint, requests bigint, hits bigint, inserted boolean")


def cache_occupancy(entries: DataFrame, ttl: str, at: str) -> DataFrame:
    """Live and expired entries per type at a time; entries inserted later do not count."""
    now = micros(F.lit(at).cast("timestamp_ntz"))
    born = micros(F.col("ts"))
    known = born <= now
    live = born + F.col(ttl) * SECOND > now
    return entries.groupBy("cache_type").agg(
        F.count_if(known & live).alias("live"), F.count_if(known & ~live).alias("expired"))


# --- projections --------------------------------------------------------------------------


def cost_projection(usage: DataFrame, prices: DataFrame, days: int = 30) -> DataFrame:
    """Per model: a month's uncached calls, tokens and cost from the daily means seen."""
    daily = usage.groupBy("model_id", F.to_date("ts").alias("day")).agg(
        F.count_if(~F.col("cached")).alias("calls"),
        F.sum(F.when(~F.col("cached"), F.col("input_tokens")).otherwise(0)).alias("input_tokens"),
        F.sum(F.when(~F.col("cached"), F.col("output_tokens")).otherwise(0)).alias("output_tokens"))
    monthly = daily.groupBy("model_id").agg(*[
        (F.avg(c) * days).alias(c) for c in ("calls", "input_tokens", "output_tokens")])
    priced = token_cost(monthly.withColumn("cached", F.lit(False)), prices)
    return priced.select("model_id", "calls", "input_tokens", "output_tokens", F.col("gross_cost").alias("monthly_cost"), "price_missing")


def storage_cost(vectors: DataFrame, text_columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Vectors, bytes (4 per dimension, plus key and metadata text) and monthly price."""
    row_bytes = F.size("embedding") * 4 + sum([F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in text_columns], F.lit(0))
    return vectors.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("vectors"), F.sum(row_bytes.cast("bigint")).alias("bytes")
    ).withColumn("monthly_cost", F.col("bytes") / 1e9 * R.STORAGE_GB_MONTH)


def response_audit(chats: DataFrame) -> DataFrame:
    """Per model: messages, mean lengths, cached share, latency mean and quantiles."""
    return chats.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("messages"), F.avg("message_length").alias("mean_message"), F.avg("response_length").alias("mean_response"),
        F.avg(F.col("cached").cast("int")).alias("cached_share"), F.avg("latency_ms").alias("mean_latency"),
        F.percentile_approx("latency_ms", [0.5, 0.95]).alias("latency_quantiles"))


def cache_attribution(answers: DataFrame) -> DataFrame:
    """Per model: answers from memory, from the model's own cache (no input tokens billed), or from neither."""
    source = F.when(F.col("memory_hit"), "memory").when(F.coalesce("billed_input_tokens", F.lit(0)) == 0, "model_cache").otherwise("none")
    counted = answers.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("answers"), *[F.count_if(source == s).alias(s) for s in ("memory", "model_cache", "none")])
    for s in ("memory", "model_cache", "none"):
        counted = counted.withColumn(f"{s}_share", F.col(s) / F.col("answers"))
    return counted
