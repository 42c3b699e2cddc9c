"""Streams on small fixtures: ids and rejects, late rows, state that ends."""

from datetime import datetime, timedelta


from siftwell.sources.store import KeyedTable
from siftwell.streaming import jobs as J

START = datetime(2024, 1, 1)


def test_files_of_one_name_stay_apart(spark, tmp_path, monkeypatch):
    from siftwell.sources import corpus

    for folder, name, text in [("a", "x.txt", "one"), ("b", "x.txt", "two"), ("b", "x.md", "three"), ("a", "y.exe", "no"), ("b", "long.txt", "w " * 400)]:
        (tmp_path / "in" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / folder / name).write_text(text)
    monkeypatch.setattr(corpus.size_reason, "__defaults__", (corpus.R.MAX_FILE_BYTES, 500))
    path = str(tmp_path / "in")
    got = spark.read.parquet(J.drain(J.document_stream(spark, path, ["txt", "md"]), "files")).collect()
    assert {(r.doc_id, r.ext, r.text) for r in got} == {("a_x.txt", "txt", "one"), ("b_x.txt", "txt", "two"), ("b_x.md", "md", "three")}
    bad = spark.read.parquet(J.drain(J.rejected_stream(spark, path, ["txt", "md"]), "rejects")).collect()
    assert {(r.path.rsplit("/", 1)[1], r.reject_reason) for r in bad} == {("y.exe", "unsupported_type"), ("long.txt", "text_too_long")}


def parts(spark, folder, schema, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part={i}")
    return J.table_stream(spark, f"{folder}/*/*.parquet", spark.read.parquet(f"{folder}/part=0").schema, "1")


def test_late_rows_are_kept(spark, tmp_path):
    """Closed windows alone make a row late; nulls and open windows are on time; both sinks together are the input."""
    at = lambda m: START + timedelta(minutes=m)
    stream = parts(spark, str(tmp_path / "in"), "id int, ts timestamp", [(1, at(0)), (2, at(60))], [(3, at(49)), (4, at(44)), (5, None), (6, at(51))], [(7, at(1)), (8, at(200))], [(9, at(100))])
    path = str(tmp_path / "out")
    J.split_late(stream, path, str(tmp_path / "state"), "5 minutes", "10 minutes").awaitTermination()
    # the bound is minute 50 for the second and third part, and minute 190 for the fourth
    assert {r.id for r in J.split_rows(spark, path, "late").collect()} == {3, 4, 7, 9}
    assert {r.id for r in J.split_rows(spark, path, "on_time").collect()} == {1, 2, 5, 6, 8}


def test_state_ends_after_the_gap(spark, tmp_path):
    """Totals go on within the gap and begin anew after it; in the end no state is left for keys that paused."""
    at = lambda m: START + timedelta(minutes=m)
    rows = [[("a", at(0), 1.0), ("a", at(10), 2.0), ("b", at(5), 5.0)], [("a", at(20), 4.0)], [("c", at(300), 1.0)], [("a", at(310), 8.0), ("c", at(320), None)], [("d", at(900), 1.0)], [("d", at(901), 1.0)]]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.ROCKSDB)
    try:
        stream = parts(spark, str(tmp_path / "in"), "k string, ts timestamp, v double", *rows)
        path = str(tmp_path / "out")
        query = J.stream_totals(stream, "k", ["v"], path, str(tmp_path / "state"), 3600, every=2)
        query.awaitTermination()
        held = query.recentProgress[-1].stateOperators[0].numRowsTotal
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {r.k: (r.v, r.rows) for r in J.read_totals(spark, path, "k", ["v"]).collect()}
    assert got == {"a": (15.0, 4), "b": (5.0, 1), "c": (1.0, 2), "d": (2.0, 2)}
    table = KeyedTable(spark, path, ["k", "part"])
    assert table.read().filter("k = 'a'").count() == 2 and len(table._current()) <= 3
    assert held <= 4  # the value, the timer and its index of d alone


def test_ingested_documents_are_dealt_by_id(spark, tmp_path, monkeypatch):
    from siftwell.sources.store import read_vectors

    spark.createDataFrame([(1, "One is here. Two is there."), (2, "Three."), (None, "Four."), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    put, plans = J.put_vectors, []
    monkeypatch.setattr(J, "put_vectors", lambda rows, path: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), put(rows, path))[1])
    docs = J.table_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    J.stream_ingest(docs, str(tmp_path / "v"), str(tmp_path / "state"), tasks=2).awaitTermination()
    assert [p.split("Initial Plan")[-1].count("Exchange ") for p in plans] == [1]
    assert {"1", "2"} <= {r.doc_id for r in read_vectors(spark, str(tmp_path / "v")).collect()}


def test_ingested_chunks_are_stored_where_they_were_made(spark, tmp_path, monkeypatch):
    from siftwell.sources.store import VectorStore, read_vectors

    rows = [(i, f"Text {i} is here. " * 100) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    append, plans = VectorStore._append, []
    monkeypatch.setattr(VectorStore, "_append", lambda self, rows, *rest: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), append(self, rows, *rest))[1])
    docs = J.table_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    J.stream_ingest(docs, str(tmp_path / "v"), str(tmp_path / "state"), tasks=100).awaitTermination()
    plan = plans[0].split("Initial Plan")[-1]
    assert plan.count("Exchange ") == 1 and "hashpartitioning(doc_id#" in plan and ", 128), " in plan
    assert "md5" not in "".join(x for x in plan.splitlines() if "Filter " in x)  # vectors are not computed again to test them
    files = [f.name for f in (tmp_path / "v" / "rows-0").glob("*.parquet")]
    assert 64 < len(files) <= 128  # of one bucket each
    stored = read_vectors(spark, str(tmp_path / "v"))
    assert stored.select("doc_id").distinct().count() == 300 and stored.filter("size(embedding) <> 64").count() == 0


def test_a_long_run_of_capitals_is_ingested(spark, tmp_path):
    from siftwell.sources.store import read_vectors

    text = "Thouinger " * 20000
    spark.createDataFrame([(1, text), (2, "Some Name9 met Other Name. Yes.")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    docs = J.table_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    J.stream_ingest(docs, str(tmp_path / "v"), str(tmp_path / "state")).awaitTermination()
    got = {r.doc_id: r for r in read_vectors(spark, str(tmp_path / "v")).collect()}
    assert got["1"].content == text[:500] and got["2"].key_entities == ["Some", "Other Name", "Yes"]
