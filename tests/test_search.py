"""Vector and keyword search on small fixtures, and the ways for large inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.functions.vectors import cosine01, similarity_from_distance, valid_embedding
from siftwell.operators import cells as N, keyword as K, retrieve as Q, vector as V
from siftwell.operators.vector import top_scores

rng = np.random.default_rng(1)
DATA = rng.standard_normal((600, 16))
ASK = rng.standard_normal((9, 16))


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(f"k{i:04d}", [float(x) for x in v], 1.0) for i, v in enumerate(DATA)]
    return spark.createDataFrame(rows, "key string, embedding array<double>, importance_score double").repartition(5)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(ASK)], "query_id int, embedding array<double>")


def exact(k):
    cos = (ASK @ DATA.T) / np.linalg.norm(ASK, axis=1)[:, None] / np.linalg.norm(DATA, axis=1)[None, :]
    return {i: [f"k{j:04d}" for j in np.argsort(-cos[i], kind="stable")[:k]] for i in range(len(ASK))}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.key)
    return out


def test_cosine01_table(spark):
    cases = [([1.0, 2.0], [1.0, 2.0], 1.0), ([1.0, 0.0, 0.0], [0.0, 1.0, 0.0], 0.5), ([1.0], [-1.0], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0),
             ([1.0], [1.0, 2.0], 0.0), (None, [1.0], 0.0), ([float("inf")], [1.0], 0.0), ([], [], 0.0)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a array<double>, b array<double>")
    got = {r.i: r.x for r in df.select("i", cosine01(F.col("a"), F.col("b")).alias("x")).collect()}
    assert [round(got[i], 9) for i in range(len(cases))] == [c[2] for c in cases]


def test_valid_and_distance(spark):
    df = spark.createDataFrame([([1.0, float("nan")],), ([0.0, 0.0],), ([1.0, 0.0],), (None,)], "e array<double>")
    assert [r.v for r in df.select(valid_embedding(F.col("e"), 2).alias("v")).collect()] == [False, False, True, False]
    d = spark.createDataFrame([(0.15,), (1.0,), (1.5,)], "d double").select(similarity_from_distance(F.col("d")).alias("s")).collect()
    assert [round(r.s, 6) for r in d] == [0.85, 0.0, 0.0]


@pytest.mark.parametrize("query_bytes", [V.QUERY_BYTES, 0])
def test_knn_is_exact_both_ways(vectors, queries, query_bytes, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_VECTORS", 70)
    monkeypatch.setattr(V, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(V, "TILE_CELLS", 500)
    assert found(top_scores(vectors, queries, 7, query_bytes=query_bytes)) == exact(7)


def test_ties_go_to_the_smaller_key(spark, queries):
    same = spark.createDataFrame([(f"d{i}", [float(x) for x in DATA[0]]) for i in range(30)], "key string, embedding array<double>").repartition(6)
    assert all(keys == ["d0", "d1", "d10"] for keys in found(top_scores(same, queries, 3)).values())


def test_odd_rows_are_skipped(spark, queries):
    odd = spark.createDataFrame([("short", [1.0]), ("null", None), ("zero", [0.0] * 16), ("ok", [1.0] * 16)], "key string, embedding array<double>")
    assert all(keys == ["ok"] for keys in found(top_scores(odd, queries, 5)).values())


def recall(got, k):
    want = exact(k)
    return np.mean([len(set(got.get(i, [])) & set(want[i])) / k for i in want])


def test_many_tasks_are_merged_in_steps(vectors, queries, monkeypatch):
    monkeypatch.setattr(V, "MERGE", 2)
    monkeypatch.setattr(V, "scan_tasks", lambda df: 40)
    got = V.top_scores(vectors.repartition(40), queries, 7)
    assert found(got) == exact(7)
    assert got._jdf.queryExecution().analyzed().toString().count("Window") == 6


def test_best_per_group_and_task(spark, queries):
    """Many tiles of many groups, so that floors cut; the result is that of one sort."""
    rows = spark.createDataFrame([(i, i % 7, [float(x) for x in DATA[i]]) for i in range(600)], "key int, part int, embedding array<double>")
    got = V.top_scores(rows, queries, 3, group="part").collect()
    cos = (ASK @ DATA.T) / np.linalg.norm(ASK, axis=1)[:, None] / np.linalg.norm(DATA, axis=1)[None, :]
    want = {(q, g): sorted((i for i in range(g, 600, 7)), key=lambda i: -cos[q, i])[:3] for q in range(9) for g in range(7)}
    seen = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        seen.setdefault((r.query_id, r.part), []).append(r.key)
    assert seen == want


def test_queries_of_several_sizes(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.0, 0.0]), ("d", [1.0])], "key string, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.5, 0.1, 0.1]), (3, []), (4, None), (5, [0.0] * 2), (6, [1.0] * 9)], "query_id int, embedding array<double>")
    for query_bytes in (V.QUERY_BYTES, 0):
        assert found(V.top_scores(rows, asked, 5, query_bytes=query_bytes)) == {1: ["a", "b"], 2: ["c"]}
    assert V.top_scores(rows, asked.filter("query_id = 4"), 5).count() == 0


FILTERED = "query_id int, embedding array<double>, document_ids array<string>, min_date timestamp, max_date timestamp"


@pytest.mark.parametrize("query_bytes", [V.QUERY_BYTES, 0])
def test_filters_are_the_questions_own(spark, query_bytes, monkeypatch):
    """Lists of documents (unknown ones, nulls, empty, none at all) and open or closed dates, against plain Python."""
    from datetime import datetime, timedelta

    monkeypatch.setattr(V, "TILE_CELLS", 300)
    monkeypatch.setattr(V, "BLOCK_VECTORS", 70)
    start = datetime(2024, 1, 1)
    made = [None if i % 11 == 0 else start + timedelta(days=i % 90) for i in range(600)]
    rows = [(f"k{i:04d}", None if i % 50 == 0 else f"d{i % 37}", [float(x) for x in DATA[i]], made[i]) for i in range(600)]
    vectors = spark.createDataFrame(rows, "key string, doc_id string, embedding array<double>, created_at timestamp").repartition(4)
    lists = [None, ["d1", "d5", "d99"], [], ["d7", None], ["d3"] * 3, None, [f"d{i}" for i in range(20)], ["none"], None]
    low = [None, None, start + timedelta(days=30), None, start + timedelta(days=10), start + timedelta(days=60), None, None, start + timedelta(days=89)]
    high = [None, start + timedelta(days=40), None, None, start + timedelta(days=20), start + timedelta(days=61), start, None, start]
    asked = spark.createDataFrame([(i, [float(x) for x in ASK[i]], lists[i], low[i], high[i]) for i in range(9)], FILTERED)
    cos = (ASK @ DATA.T) / np.linalg.norm(ASK, axis=1)[:, None] / np.linalg.norm(DATA, axis=1)[None, :]
    want = {}
    for q in range(9):
        ok = [i for i in range(600) if (lists[q] is None or (rows[i][1] is not None and rows[i][1] in lists[q]))
              and (made[i] is None or ((low[q] is None or made[i] >= low[q]) and (high[q] is None or made[i] <= high[q])))]
        if ok:
            want[q] = [f"k{i:04d}" for i in sorted(ok, key=lambda i: (-round(cos[q, i], 9), i))[:6]]
    assert found(V.top_scores(vectors, asked, 6, query_bytes=query_bytes)) == want and len(want) == 7


def test_stored_cells(spark, vectors, queries, tmp_path, monkeypatch):
    """Visited folders alone are read, without a shuffle; with all cells the result is exact, also in several scans."""
    path = str(tmp_path / "cells")
    N.store_cells(vectors, path, 30, 5, file_rows=10)
    some = N.stored_search(spark, path, queries.filter("query_id = 1"), 10, 0.0, beam=2)
    plan = some._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scan) == 1 and "PartitionFilters: [cell_id#" in scan[0] and "Exchange" not in plan[plan.index("MapInArrow"):]
    cells = spark.read.parquet(f"{path}/cells")
    assert cells.agg(F.sum("vectors")).first()[0] == 600 and cells.count() == 20
    assert found(N.stored_search(spark, path, queries, 10, -1.0, beam=None)) == exact(10)
    got = found(N.stored_search(spark, path, queries, 10, 0.0, beam=4))
    assert recall(got, 10) >= 0.9
    monkeypatch.setattr(V, "QUERY_ROWS", 3)
    monkeypatch.setattr(V, "BLOCK_QUERIES", 3)
    assert found(N.stored_search(spark, path, queries, 10, -1.0, beam=None)) == exact(10)
    N.store_cells(vectors.limit(0), str(tmp_path / "none"), 30)
    assert spark.read.parquet(str(tmp_path / "none/cells")).count() == 0


def test_training_set_is_bounded(vectors):
    """With few training rows there are fewer cells, and all vectors are still assigned."""
    assigned, cells, _ = N.build_cells(vectors, 10, 5, train_rows=200)
    assert cells.count() == 10 and assigned.count() == 600


def test_buckets(vectors, queries):
    """Recall of probed buckets; with every neighbour of a single wide bucket the result is exact."""
    assert recall(found(N.lsh_search(vectors, queries, 10, probes=9, tables=12)), 10) >= 0.9
    assert found(N.lsh_search(vectors, queries, 10, width=1e6, tables=1, probes=9)) == exact(10)
    assert N.bucket_postings(vectors).columns == ["tab", "bucket", "key"]
    own = queries.withColumn("exclude_key", F.lit("k0001"))
    assert all("k0001" not in keys for keys in found(N.lsh_search(vectors, own, 600, width=1e6, tables=1, probes=9)).values())


def test_filter_keeps_unknown_dates(spark):
    rows = [("a", "2024-01-15 00:00:00"), ("b", "2023-01-01 00:00:00"), ("c", None)]
    df = spark.createDataFrame(rows, "doc_id string, d string").select("doc_id", F.col("d").cast("timestamp").alias("created_at"))
    assert {r.doc_id for r in V.metadata_filter(df, min_date="2024-01-01", max_date="2024-12-31").collect()} == {"a", "c"}
    ids = spark.createDataFrame([("b",)], "doc_id string")
    assert [r.doc_id for r in V.metadata_filter(df, ids).collect()] == ["b"]


DOCS = ["red fox runs", "red red dog", "blue sky over the sea", "fox and dog"]


def plain_bm25(asked, docs, running):
    split = [d.split() for d in docs]
    out = []
    for r, d in enumerate(split):
        seen = split[: r + 1] if running else split
        mean, score = sum(map(len, seen)) / len(seen), 0.0
        for term in asked:
            tf, df = d.count(term), sum(term in s for s in seen)
            if tf:
                score += math.log((len(seen) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / mean))
        out.append(round(max(0.0, score), 9))
    return out


@pytest.mark.parametrize("running", [False, True])
def test_bm25(spark, running):
    cand = spark.createDataFrame([(1, f"k{i}", i + 1, d) for i, d in enumerate(DOCS)], "query_id int, key string, rank int, text string")
    asked = spark.createDataFrame([(1, "blue Red red")], "query_id int, query_text string")
    got = {r.key: round(r.bm25, 9) for r in K.bm25(cand, asked, running=running).collect()}
    assert [got[f"k{i}"] for i in range(4)] == plain_bm25(["blue", "red", "red"], DOCS, running)


def test_weights():
    assert K.weights(7, 3) == (0.7, 0.3) and K.weights(0, 0) == (0.7, 0.3)


def test_analysis_and_plan(spark):
    texts = ["How does it compare?", "compare Apple versus Pear", "events during last year", "plain words"]
    df = spark.createDataFrame(list(enumerate(texts)), "query_id int, query_text string")
    rows = Q.stage1_plan(Q.analyze_query(df)).orderBy("query_id").collect()
    assert [r.query_type for r in rows] == ["specific", "comparative", "temporal", "general"]
    assert rows[1].stage1_threshold == 0.3 and rows[1].stage1_limit == 9
    assert rows[0].stage1_threshold == 0.4 and rows[0].fallback_threshold == 0.3


def test_final_threshold_only_falls(spark):
    rows = [(1, i, s, 0.6) for i, s in enumerate([0.9, 0.5, 0.4, 0.2], 1)] + [(2, 1, 0.3, 0.6)]
    df = spark.createDataFrame(rows, "query_id int, final_rank int, rerank_score double, base_final double")
    out = Q.final_results(Q.final_threshold(df), 3)
    assert sorted((r.query_id, r.final_rank) for r in out.collect()) == [(1, 1), (1, 2), (2, 1)]


def test_more_than_a_hundred_neighbours(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(f"k{i}", [float(x) for x in rng.normal(size=4)]) for i in range(400)], "key string, embedding array<double>")
    asked = spark.createDataFrame([("q", [1.0, 0.0, 0.0, 0.0])], "query_id string, embedding array<double>")
    assert V.knn_topk(rows, asked, 300).count() == 300


def test_queries_with_and_without_text_in_one_batch(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame(
        [(f"k{i}", f"d{i}", 0, f"Alpha number {i} beta.", [float(x) for x in rng.normal(size=4)]) for i in range(50)],
        "key string, doc_id string, chunk_index int, content string, embedding array<double>")
    vec = [1.0, 0.2, 0.0, 0.0]
    asked = spark.createDataFrame([(1, "What is alpha?", vec), (2, None, vec), (3, "  ", vec)], "query_id int, query_text string, embedding array<double>")
    got = Q.retrieve(rows, asked, threshold=0.1)
    stages = {(r.query_id, r.retrieval_stage) for r in got.collect()}
    assert stages == {(1, "multi_stage"), (2, "single_stage"), (3, "single_stage")}
    alone = V.similarity_search(rows, asked.filter("query_id = 2"), 3, 0.1)
    assert sorted(r.key for r in got.filter("query_id = 2").collect()) == sorted(r.key for r in alone.collect())


def test_probes_in_the_scan_find_what_the_postings_find(spark):
    made = np.random.default_rng(3).standard_normal((300, 8))
    vectors = spark.createDataFrame([(f"k{i:04d}", [float(x) for x in v]) for i, v in enumerate(made)], "key string, embedding array<double>")
    queries = vectors.limit(9).select(F.col("key").alias("query_id"), "embedding", F.col("key").alias("exclude_key"))
    scanned, joined = N.lsh_search(vectors, queries, 7), N.lsh_search(vectors, queries, 7, postings=N.bucket_postings(vectors))
    rows = lambda df: sorted((r.query_id, r["rank"], r.key, round(r.similarity, 7)) for r in df.collect())
    assert rows(scanned) == rows(joined) and len(rows(scanned)) > 30
    # candidates are no rows of a join
    assert "Join" not in scanned._jdf.queryExecution().executedPlan().toString()


def test_found_rows_are_cut_often(spark):
    import pyarrow as pa

    made = np.random.default_rng(5).standard_normal((4_000, 4))
    asked = V.Asked(pa.table({"query_id": np.arange(1_000), "embedding": pa.array(made[:1_000].tolist())}), 4)
    best, held = V._Best(asked, 10, "COSINE", -1.0, False, 9), 0
    for at in range(0, 4_000, 20):
        best.add(made[at : at + 20], np.arange(at, at + 20), None, None, pa.table({"key": np.arange(at, at + 20)}))
        held = max(held, best.held)
    assert held <= V.HELD_ROWS + 20_000
    best.shrink()
    q, key = best.rows[0][:2]
    exact = np.argsort(-np.round(made[:1_000] @ made.T / np.outer(np.linalg.norm(made[:1_000], axis=1), np.linalg.norm(made, axis=1)), 9), axis=1, kind="stable")[:, :10]
    assert (key.reshape(1_000, 10) == exact).all()
