"""Merkle manifest against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from siftwell.llm import merkle

from .edge import TEXTS, documents, empty


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, grown=0):
    out = []
    for value in (row.doc_id, row.source, row.lang, None if row.n_chars is None else row.n_chars + grown, row.text):
        out.append("-" if value is None else f"{len(str(value).encode())}:{value}")
    return h(*out)


def proofs(nodes, fan):
    """Root, and per node the siblings of each level as (left, right)."""
    paths = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        parents, owners = [], []
        for a in range(0, len(nodes), fan):
            run = nodes[a : a + fan]
            for j in range(len(run)):
                for i in under[a + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            parents.append(h(*run))
            owners.append([i for j in range(len(run)) for i in under[a + j]])
        nodes, under = parents, owners
    return nodes[0], paths


def plain(rows, fan=2):
    """(doc_id, leaf) to lists of (subroot, root, proof), by literal building of all levels."""
    groups = defaultdict(list)
    for r in rows:
        groups[r.lang].append((r.doc_id is not None, r.doc_id or 0, leaf_of(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {}
    for g in order:
        members = sorted(groups[g], key=lambda m: m[:3])
        built[g] = members, *proofs([m[2] for m in members], fan)
    root, above = proofs([built[g][1] for g in order], fan)
    out = defaultdict(list)
    for g, upper in zip(order, above):
        members, subroot, paths = built[g]
        for m, path in zip(members, paths):
            out[m[3].doc_id, m[2]].append((subroot, root, path + upper))
    return out


def same(spark, df, shape):
    rows = df.select("doc_id", "text", "lang", "source", "n_chars").collect()
    want = plain(rows, shape.fan_out)
    got = merkle.digests(df, shape).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id, leaf_of(r)].append(r)
    for r in got:
        proof = next(p for p in want[r.doc_id, r.leaf] if h("".join(a + b for a, b in p[2])) == r.proof_sha256)
        assert (r.subroot, r.root) == proof[:2]
        source = by_id[r.doc_id, r.leaf][0]
        chosen = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
        node = leaf_of(source, 1 if chosen and source.n_chars is not None else 0)
        for a, b in proof[2]:
            node = h(a, node, b)
        assert r.folded_root == node and r.verified == (node == r.root)
        assert r.verified == (not chosen or source.n_chars is None)


@pytest.mark.parametrize("shape", [merkle.Shape(), merkle.Shape(3, 2)])
def test_edges(spark, shape):
    same(spark, documents(spark, extra=True), shape)


def test_many(spark):
    """Groups over several rounds of blocks, one of a single leaf, a row that repeats a hundred times, the largest number."""
    rng = random.Random(9)
    rows = [(i, rng.choice(TEXTS[3:8]), rng.choices(["en", "de", None, "é"], [70, 20, 9, 1])[0], "s", rng.randint(0, 99)) for i in range(700)]
    rows += [(7, "again", "en", None, 1)] * 100 + [(5000, "x", "single", "s", 2**63 - 1), (None, "y", "single2", None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, documents(spark).schema).repartition(5)
    same(spark, df, merkle.Shape(2, 3))
    same(spark, df, merkle.Shape(5, 2))


def test_empty_and_single(spark):
    assert merkle.digests(empty(spark)).count() == 0
    one = documents(spark).filter("doc_id = 3")
    row = merkle.digests(one).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == h("") and row.verified


def test_general(spark):
    """Other columns pass through, a proof folds to the root, a changed leaf does not."""
    from pyspark.sql import functions as F

    leaves = spark.range(50).select("id", (F.col("id") % 3).alias("kind"), F.sha2(F.col("id").cast("string"), 256).alias("d"), F.lit(1).alias("pos"), F.lit(2).alias("g"))
    out = merkle.manifest(leaves, "id", "kind", "d", merkle.Shape(4, 2))
    assert out.columns == ["id", "kind", "d", "pos", "g", "subroot", "root", "proof"]
    got = out.withColumn("good", merkle.fold(F.col("d"), F.col("proof")) == F.col("root")).withColumn(
        "bad", merkle.fold(F.lit("0"), F.col("proof")) == F.col("root")).collect()
    assert len(got) == 50 and all(r.good and not r.bad and r.pos == 1 and r.g == 2 for r in got)
    with pytest.raises(ValueError):
        merkle.Shape(2, 13)
