"""Cost, windows and reuse against plain loops, with one key that holds most rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siftwell.operators import cost as T

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def calls():
    rnd = random.Random(3)
    return [(i, "hot" if rnd.random() < 0.6 else f"s{rnd.randint(0, 4)}", START + timedelta(seconds=rnd.randint(0, 4000))) for i in range(900)]


@pytest.fixture(scope="module")
def frame(spark, calls):
    return spark.createDataFrame(calls, "id int, source string, ts timestamp").repartition(5)


@pytest.mark.parametrize("window,block", [(60, None), (60, 60), (300, 301)])
def test_sliding_rate(frame, calls, window, block):
    got = {r.id: r.recent_calls for r in T.sliding_rate(frame, "source", window, 5, block).collect()}
    for i, source, ts in calls:
        assert got[i] == sum(s == source and 0 <= (ts - t).total_seconds() <= window for _, s, t in calls)


def test_sliding_rate_of_one_hot_source(spark):
    """90 % of 200,000 calls in one source, a tenth of them at one instant, some without a source: exact, and no task above its share."""
    rows = spark.range(200_000).select(
        "id", F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 50 > 0, "cold").alias("source"),
        F.timestamp_seconds(F.when(F.col("id") % 10 == 5, 5000).otherwise(F.pmod(F.xxhash64("id"), F.lit(10_000)))).alias("ts"))
    found = T.sliding_rate(rows, "source", 60, 5).groupBy("source", "ts").agg(F.min("recent_calls").alias("a"), F.max("recent_calls").alias("b")).collect()
    counts = {(r.source, int(r.ts.timestamp())): r["count"] for r in rows.groupBy("source", "ts").count().collect()}
    for r in found[::37]:
        second = int(r.ts.timestamp())
        assert r.a == r.b == sum(counts.get((r.source, t), 0) for t in range(second - 60, second + 1))
    assert len(found) == len(counts)
    at = T.sliding_rate(rows, "source", 60, 5, 10)
    plan = at._jdf.queryExecution().analyzed().toString()
    assert "_block" in plan and at.filter("recent_calls is null").count() == 0


def test_stored_sketches_merge(spark):
    """Skewed values over many windows: merged quantiles keep their rank within the stated error; nulls and empty tables."""
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("ts"),
        F.when(F.col("id") % 7 > 0, F.exp(F.pmod(F.xxhash64("id"), F.lit(1000)) / 100)).alias("v"))
    sketches = T.quantile_sketches(rows, ["k"], "v")
    assert 80 < sketches.count() < 90
    got = {r.k: r for r in T.merged_quantiles(sketches, ["k"], {"q10": 0.1, "q50": 0.5, "q99": 0.99}).collect()}
    for k in ("hot", "cold"):
        values = sorted(r.v for r in rows.filter((F.col("k") == k) & F.col("v").isNotNull()).select("v").collect())
        assert got[k].n == len(values)
        for c, q in (("q10", 0.1), ("q50", 0.5), ("q99", 0.99)):
            low, high = sum(v < got[k][c] for v in values) / len(values), sum(v <= got[k][c] for v in values) / len(values)
            assert low - T.RANK_ERROR <= q <= high + T.RANK_ERROR
    assert T.merged_quantiles(T.quantile_sketches(rows.limit(0), ["k"], "v"), ["k"], {"m": 0.5}).count() == 0


@pytest.mark.parametrize("ttl,block", [(100, None), (100, 100), (700, 900), (5000, None)])
def test_ttl_reuse(frame, calls, ttl, block):
    got = {(r.source, r.ts_us): (r.requests, r.hits, r.inserted) for r in T.ttl_reuse(frame, "source", ttl, block).collect()}
    want, alive = {}, {}
    for _, source, ts in sorted(calls, key=lambda c: c[2]):
        key = (source, int((ts - datetime(1970, 1, 1)).total_seconds()) * 1_000_000)
        n, hits, inserted = want.get(key, (0, 0, False))
        fresh = ts >= alive.get(source, datetime.min)
        if fresh:
            alive[source] = ts + timedelta(seconds=ttl)
        want[key] = (n + 1, hits + (not fresh), inserted or fresh)
    assert got == want


def test_batches(frame, calls):
    rows = T.metric_batches(frame, 20, "source", "id", block_seconds=500).collect()
    got = {r.id: r.batch_no for r in rows}
    for source in {c[1] for c in calls}:
        own = sorted((c for c in calls if c[1] == source), key=lambda c: (c[2], c[0]))
        assert [got[c[0]] for c in own] == [n // 20 for n in range(len(own))]


def test_token_cost(spark):
    usage = spark.createDataFrame(
        [("c", "amazon.nova-lite-v1:0", 1000, 500, False), ("c", "amazon.nova-lite-v1:0", 1000, 500, True), ("c", "other:1", 10, 10, False)],
        "conversation_id string, model_id string, input_tokens long, output_tokens long, cached boolean")
    rows = sorted(T.token_cost(usage, T.price_table(spark)).collect(), key=lambda r: (r.model_id, r.cached))
    assert [(round(r.gross_cost, 8), round(r.net_cost, 8), r.price_missing) for r in rows] == [(0.00018, 0.00018, False), (0.00018, 0.0, False), (0.0, 0.0, True)]


def test_consecutive_needs_neighbours(spark):
    rows = [("m", START + timedelta(hours=h), 20.0) for h in (0, 1, 3, 4, 5)] + [("m", START + timedelta(hours=2), 1.0)]
    df = spark.createDataFrame(rows, "metric_name string, ts timestamp, value double")
    base = int(START.timestamp() // 3600)
    assert sorted(r.period - base for r in T.consecutive_alarms(df, 3600, 10, 2).collect()) == [1, 4, 5]
    assert sorted(r.period - base for r in T.consecutive_alarms(df, 3600, 10, 3).collect()) == [5]


def test_cache_key_ignores_map_order_and_refuses_secrets(spark):
    a = F.create_map(F.lit("x"), F.lit("1"), F.lit("y"), F.lit("2"))
    b = F.create_map(F.lit("y"), F.lit("2"), F.lit("x"), F.lit("1"))
    key = lambda c: T.cache_key(F.lit("response"), c)
    row = spark.range(1).select(key(T.canonical_json(a)).alias("a"), key(T.canonical_json(b)).alias("b"), key(F.lit("user_password")).alias("s")).first()
    assert row.a == row.b and row.a.startswith("response:") and row.s is None
