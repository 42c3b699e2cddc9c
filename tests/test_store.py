"""The appending vector table: what changes cost, who sees what, and named tables."""

import math
import os

import pytest
from pyspark.sql import functions as F

from siftwell.operators import lifecycle
from siftwell.operators.chunk import chunk_neighbours
from siftwell.operators.describe import describe
from siftwell.sources import corpus
from siftwell.sources.postings import PostingStore
from siftwell.sources.store import KeyedTable, VectorStore, put_vectors, read_vectors


def chunks(spark, ids, chunks=3, mark="", at="2024-05-01", dim=4):
    rows = [(str(i), c, f"{mark}Text {c} of {i}.", [float(i), float(c), 1.0] + [0.5] * (dim - 3)) for i in ids for c in range(chunks)]
    df = spark.createDataFrame(rows, "doc_id string, chunk_index int, content string, embedding array<double>")
    return describe(df.withColumn("created_at", F.lit(at).cast("timestamp")))


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def state(store):
    return sorted((r.key, r.content) for r in store.read().collect())


def expected(docs):
    return sorted((f"{i}_chunk_{c}", f"{mark}Text {c} of {i}.") for i, (n, mark) in docs.items() for c in range(n))


def test_change_costs_the_change(spark, tmp_path):
    """300 of 5,000 documents: every old file stays untouched, and their rows are replaced, fewer chunks included."""
    path = str(tmp_path / "v")
    put_vectors(chunks(spark, range(5000)), path)
    before = files(path)
    put_vectors(chunks(spark, range(100, 400), 2, "new "), path)
    after = files(path)
    assert {f: after.get(f) for f in before} == before and len(after) <= len(before) + 64
    want = {i: (3, "") for i in range(5000)} | {i: (2, "new ") for i in range(100, 400)}
    assert sorted((r.key, r.content) for r in read_vectors(spark, path).collect()) == expected(want)


def test_buckets_meet_without_a_shuffle(spark, tmp_path):
    store = VectorStore.create(spark, str(tmp_path / "v"), 4, buckets=8)
    for mark in ("", "b "):
        store.put(chunks(spark, range(20), mark=mark))
    plan = store.read()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ShuffledHashJoin" in plan
    assert store.read().rdd.getNumPartitions() == 8
    store.compact()
    assert "Join" not in store.read()._jdf.queryExecution().executedPlan().toString()


def test_changes(spark, tmp_path):
    """Put, repeated rows, deletion, expiry, a claim that failed, compaction and vacuum, each against the expected rows."""
    path = str(tmp_path / "v")
    store = VectorStore.create(spark, path, 4, "DOT_PRODUCT", 4)
    assert state(store) == [] and (store.dim, store.metric, store.buckets) == (4, "DOT_PRODUCT", 4)
    want = {i: (3, "") for i in range(10)}
    store.put(chunks(spark, range(10)).unionByName(chunks(spark, [5])))
    assert state(store) == expected(want)
    twice = chunks(spark, [1, 2], mark="old ", at="2024-01-01").unionByName(chunks(spark, [1, 2], mark="new ", at="2024-06-01"))
    store.put(twice, gone=spark.createDataFrame([(3,), (4,)], "doc_id int"))
    want |= {1: (3, "new "), 2: (3, "new ")}
    del want[3], want[4]
    assert state(store) == expected(want)
    store.delete(spark.createDataFrame([("9",), ("77",)], "doc_id string"))
    del want[9]
    assert state(store) == expected(want)
    failed = store._claim()
    store._append(chunks_as_rows(spark, [0]).repartition(4, "doc_id"), 0, failed)
    assert state(store) == expected(want)
    store.put(chunks(spark, [6], 1, "six ", at="2023-01-01"))
    want[6] = (1, "six ")
    assert state(store) == expected(want)
    store.expire("2024-06-10", 30)
    want = {1: (3, "new "), 2: (3, "new ")}
    assert state(store) == expected(want)
    store.put(chunks(spark, [6], 2, "back ", at="2023-01-01"))
    want[6] = (2, "back ")
    assert state(store) == expected(want)
    store.compact()
    assert state(store) == expected(want) == state(VectorStore(spark, path))
    store.vacuum()
    assert state(store) == expected(want) and len([d for d in os.listdir(path) if d.startswith("rows")]) == 1
    store.put(chunks(spark, [1], 1, "last "))
    want[1] = (1, "last ")
    assert state(store) == expected(want)
    store._mark(f"{store._claim():012d}-compacting")
    with pytest.raises(RuntimeError):
        store.put(chunks(spark, [1]))


def chunks_as_rows(spark, ids):
    return corpus.vector_rows(chunks(spark, ids, mark="lost ")).withColumn("gone", F.lit(False))


def test_dimension_is_honoured(spark, tmp_path):
    store = VectorStore.create(spark, str(tmp_path / "v"), 4, buckets=2)
    both = chunks(spark, [1], 1).unionByName(chunks(spark, [2], 1, dim=6))
    store.put(both)
    assert state(store) == expected({1: (1, "")})
    assert [tuple(r) for r in store.misfits(both).collect()] == [("2_chunk_0", 6)]
    with pytest.raises(ValueError):
        VectorStore.create(spark, str(tmp_path / "w"), 4, "L3")
    with pytest.raises(FileNotFoundError):
        VectorStore(spark, str(tmp_path / "none"))


def test_named_table_holds_stored_rows(spark, tmp_path):
    lifecycle.create_vectors(spark, "named_vectors", 4, location=str(tmp_path / "t"))
    rows = corpus.vector_rows(chunk_neighbours(chunks(spark, [1, 2]), "doc_id"))
    lifecycle.insert_vectors(rows, "named_vectors")
    lifecycle.insert_vectors(corpus.vector_rows(chunks(spark, [3])), "named_vectors")
    got = spark.table("named_vectors")
    assert got.count() == 9 and got.filter("size(topics) >= 0 and next_context.chunk_type is not null").count() == 4
    with pytest.raises(Exception, match="takes 4 dimensions"):
        lifecycle.insert_vectors(corpus.vector_rows(chunks(spark, [4], dim=5)), "named_vectors")
    assert lifecycle.drop_vectors(spark, "named_vectors", force=True) == 9


def test_keyed_table_keeps_the_last_row(spark, tmp_path):
    """Many updates: one row per key, and no more folders are read than since the last merge."""
    table = KeyedTable(spark, str(tmp_path / "k"), ["id"], every=4)
    want = {}
    for n in range(11):
        rows = [(i, n * 100 + i) for i in range(n % 3, 12, 3)]
        table.upsert(spark.createDataFrame(rows, "id int, v int"))
        want |= dict(rows)
        assert {r.id: r.v for r in table.read().collect()} == want
        assert len(table._current()) <= 5
    assert len(table.read().inputFiles()) < 30


def plain_bm25(docs, question):
    words = {k: t.lower().split() for k, t in docs.items()}
    mean, out = sum(map(len, words.values())) / len(words), {}
    for k, w in words.items():
        score = 0.0
        for term in question.lower().split():
            tf, df = w.count(term), sum(term in x for x in words.values())
            if tf:
                score += math.log((len(words) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))
        if score > 0:
            out[k] = round(score, 6)
    return out


def test_postings_change_by_document(spark, tmp_path):
    """Added, replaced (by a shorter text), removed, repeated and empty documents: scores are those of a fresh index."""
    import random

    rng = random.Random(6)
    text = lambda n: " ".join(f"w{min(int(rng.expovariate(0.1)), 60)}" for _ in range(n))
    docs = {str(i): text(rng.randint(5, 40)) for i in range(120)}
    frame = lambda d: spark.createDataFrame(list(d.items()), "id string, text string")
    asked = spark.createDataFrame([(1, "w30 w31 w30"), (2, "w1 nothing"), (3, ""), (4, None)], "query_id int, query_text string")
    store = PostingStore(spark, str(tmp_path / "p"))
    assert store.bm25(asked, 5).count() == 0 and store.stats().first().total_docs == 0

    def same(now):
        got = store.bm25(asked, 1000).collect()
        for q, question in ((1, "w30 w31 w30"), (2, "w1 nothing")):
            assert {r.key: round(r.bm25, 6) for r in got if r.query_id == q} == plain_bm25(now, question)
        assert {r.query_id for r in got} <= {1, 2}

    store.add(frame(docs), "id", "text")
    same(docs)
    store.remove(frame({k: "" for k in list(docs)[:12]}), "id")
    docs = dict(list(docs.items())[12:])
    same(docs)
    changed = {k: text(3) for k in list(docs)[:12]} | {"new": text(30), "blank": "..."}
    store.add(frame(changed), "id", "text")
    docs |= changed | {"blank": ""}
    same(docs)
    store._claim()  # a change that failed
    store.compact()
    same(docs)
    store.remove(frame({"new": ""}), "id")
    del docs["new"]
    same(docs)


def test_postings_are_shuffled_once_to_their_files(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter
    from siftwell.sources.postings import PostingStore

    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, **kw: (plans.append((path, self._df._jdf.queryExecution().executedPlan().toString())), write(self, path, **kw))[1])
    docs = spark.createDataFrame([(1, "a b a"), (1, "a c"), (2, None), (3, ""), (None, "b")], "doc_id int, text string")
    store = PostingStore(spark, str(tmp_path / "p"))
    store.add(docs, "doc_id", "text")
    rows = {(r.key, r.term): r.tf for r in store._postings().collect()}
    assert rows == {("1", "a"): 3, ("1", "b"): 1, ("1", "c"): 1, (None, "b"): 1}
    plan = next(p for path, p in plans if "/postings/" in path)
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_compaction_moves_postings_only_to_their_lengths(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter
    from siftwell.sources.postings import PostingStore

    plans, write = [], DataFrameWriter.parquet
    store = PostingStore(spark, str(tmp_path / "p"))
    store.add(spark.createDataFrame([(1, "a b a"), (2, "c"), (3, "a")], "doc_id int, text string"), "doc_id", "text")
    store.add(spark.createDataFrame([(1, "d a")], "doc_id int, text string"), "doc_id", "text")
    store.remove(spark.createDataFrame([(2,)], "doc_id int"), "doc_id")
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, **kw: (plans.append((path, self._df._jdf.queryExecution().executedPlan().toString())), write(self, path, **kw))[1])
    store.compact()
    assert "REPARTITION" not in next(p for path, p in plans if "/postings/" in path)
    assert sorted((r.key, r.term, r.tf) for r in store._postings().collect()) == [("1", "a", 1), ("1", "d", 1), ("3", "a", 1)]
