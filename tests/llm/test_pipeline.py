"""The classifier's held-out accuracy, the pipeline's stages on their own input, and the registered queries."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from siftwell.llm import cotrain, packing, quality, simhash
from siftwell.llm.queries import QUERIES, SQL

from .edge import TEXTS, documents, empty
from .test_resemblance import roots
from .test_texts import base_counts, brute

FOLDER = "/root/testdata/sf0.01"
TABLES = "documents pages benchmark labels conversations embeddings".split()


def read(spark, name, folder=FOLDER):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def test_classifier_on_unseen_documents(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    model = cotrain.train(docs, labels.filter("doc_id % 2 = 0"))
    rows = cotrain.score(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    wrong = sum(r.kept != (r.quality == 1) for r in rows)
    assert len(rows) > 150 and wrong <= 0.03 * len(rows)
    assert sum(r.quality == 1 and not r.kept for r in rows) <= 0.01 * len(rows)
    assert all(0 <= x <= 1 for r in rows for x in (r.text_score, r.meta_score, r.score))


def test_classifier_edges(spark):
    df = documents(spark, extra=True)
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 1), (None, 1), (5, None)], "doc_id long, quality int")
    model = cotrain.train(df, labels)
    rows = cotrain.score(df, model).collect()
    assert len(rows) == len(TEXTS) + 3
    good = read(spark, "labels")
    model = cotrain.train(read(spark, "documents"), good)
    out = cotrain.keep_good(df, model)
    assert out.columns == df.columns and 0 < out.count() < df.count()
    assert cotrain.train(df, good.limit(0)) is None and cotrain.train(empty(spark), good) is None
    assert cotrain.keep_good(df, None).count() == df.count()
    assert cotrain.score(empty(spark), model).count() == 0
    bare = cotrain.score(df.select("doc_id", "text"), model)
    assert bare.filter("score is null").count() == 0


def test_exchange_teaches_the_other_view():
    """One view knows the class, the other cannot learn it from few labels: pseudo-labels bring it there."""
    import numpy as np

    rng = np.random.default_rng(0)
    n = 4000
    y = rng.random(n) < 0.5
    text = np.column_stack([y + rng.normal(0, 0.15, n), rng.random(n)])
    slots = np.column_stack([np.where(rng.random(n) < 0.9, y, ~y) * 32 + rng.integers(0, 32, n), np.full(n, 64), np.full(n, 80)])
    label = np.where(np.arange(n) < 120, y, -1)
    folds = rng.random(n)
    accuracy = []
    for rounds in (0, 4):
        model = cotrain.learn(text, slots, label.astype(int), folds, cotrain.CoTraining(rounds=rounds))
        z = np.array(model.meta)[slots].sum(axis=1) + model.meta[-1]
        accuracy.append(((z > 0) == y)[label < 0].mean())
    assert accuracy[1] > accuracy[0] + 0.03 and accuracy[1] > 0.85


def test_stages(spark, tmp_path):
    """Each stage against plain Python on what the stage before kept."""
    docs = read(spark, "documents")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality_rules", "quality_classifier", "near_duplicates", "decontamination", "best_fit_packing"]

    def next_docs(name, docs):
        path = str(tmp_path / name)
        stage[name](spark, docs, FOLDER).write.parquet(path)
        return spark.read.parquet(path)

    clean = next_docs("quality_rules", docs)
    assert clean.columns == docs.columns
    raw = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id: r.text for r in clean.collect()}
    for i, text in raw.items():
        n, _, _, _, repeated = base_counts(text)
        assert i not in kept or (n >= 20 and 100 * repeated <= 30 * n)
        lines = text.split("\n")
        assert i not in kept or all(x in lines for x in kept[i].split("\n"))
    good = next_docs("quality_classifier", clean)
    assert good.columns == docs.columns and set(r.doc_id for r in good.collect()) <= set(kept)
    labels = {r.doc_id: r.quality for r in read(spark, "labels").collect()}
    assert not {r.doc_id for r in clean.join(good, "doc_id", "left_anti").collect() if labels.get(r.doc_id) == 1}
    single = next_docs("near_duplicates", good)
    texts = {r.doc_id: r.text for r in good.collect()}
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(roots(texts).values()))
    left = next_docs("decontamination", single)
    texts = {r.doc_id: r.text for r in single.collect()}
    items = [(r.item_id, r.text) for r in read(spark, "benchmark").collect()]
    grams = [{tuple(w) for w in zip(*[t.lower().split()[k:] for k in range(3)])} for _, t in items]
    near = {i: t for i, t in texts.items() if any(g & {tuple(w) for w in zip(*[t.lower().split()[k:] for k in range(3)])} for g in grams)}
    bad = {d for d, _ in brute(near.items(), items)}
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(texts) - bad) and bad
    packed = next_docs("best_fit_packing", left)
    sizes = {r.doc_id: r.n_tokens for r in packing.with_sizes(left).collect()}
    total = {r.doc_id: r.n for r in packed.groupBy("doc_id").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    assert total == sizes


def test_stages_take_edge_cases(spark):
    for df in (documents(spark, extra=True), documents(spark, extra=True).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, FOLDER)
            assert name == "best_fit_packing" or out.columns == df.columns
            out.count()
    assert simhash.keep_first(empty(spark)).count() == quality.clean(empty(spark)).count() == 0


def test_registered():
    names = set(entry.queries())
    assert set(QUERIES) | {"pipeline"} <= names and set(SQL) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(set(SQL) - {"op5_interleaved_shards"}))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    folder = FOLDER.replace("0.01", "0.001")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    rel = con.execute(SQL[name])
    names = [d[0] for d in rel.description]
    want = sorted(map(str, (tuple(r[names.index(c)] for c in sorted(names)) for r in rel.fetchall())))
    df = QUERIES[name](spark, folder)
    assert sorted(df.columns) == sorted(names)
    assert sorted(str(tuple(r[c] for c in sorted(names))) for r in df.collect()) == want and want
