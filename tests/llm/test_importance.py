"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.llm import importance

from .edge import documents, empty


def runs(text, longest=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)], len(w)


def buckets(text, spec):
    return Counter(zlib.crc32(f.encode()) % spec.buckets for f in runs(text, spec.longest)[0])


def kernel(texts, spec=importance.Resampling()):
    got = [Counter() for _ in texts]
    for a, _, bucket, count in importance.features(texts, spec):
        for i, part in enumerate(np.split(bucket, np.cumsum(count)[:-1])):
            got[a + i].update(part.tolist())
    return got


def test_spans():
    """Words at, under and over the table's reach, words without end, other characters than ASCII, empty texts between."""
    rng = random.Random(3)
    letters = "abC9 .é日\n-"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(200)]
    texts += ["", "x" * 1000 + " y " + "é" * 5000, "日本" * 300 + " a b " + "q" * 63 + " " + "q" * 64, "a " * 100_000, "", "z" * 1_000_000 + " q", ".", "\x00a\x00"]
    spec = importance.Resampling()
    assert kernel(texts) == [buckets(t, spec) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aB 9é")), max_size=200), max_size=4), st.integers(1, 4))
def test_any_text(texts, longest):
    spec = importance.Resampling(buckets=977, longest=longest)
    assert kernel(texts, spec) == [buckets(t, spec) for t in texts]


def plain(docs, target, spec):
    ours, theirs = Counter(), Counter()
    for _, t in docs:
        ours.update(buckets(t, spec))
    for t in target:
        theirs.update(buckets(t, spec))
    S, T, B = sum(ours.values()), sum(theirs.values()), spec.buckets
    out = []
    for key, text in docs:
        mine = buckets(text, spec)
        weight = sum(n * math.floor(1000 * math.log((theirs[b] + 1) * (S + B) / ((ours[b] + 1) * (T + B)))) for b, n in mine.items())
        h = int(hashlib.sha256(f"{spec.seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, sum(mine.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, runs(text)[1]])
    able = sorted((r for r in out if r[5] >= spec.least_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, r in enumerate(able[: len(able) * spec.percent // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("spec", [importance.Resampling(), importance.Resampling(buckets=100, percent=50, seed="s")])
def test_documents(spark, spec):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), "en", "s", 1) for i in range(150)]
    df = documents(spark, extra=True)
    more = spark.createDataFrame(rows, documents(spark).schema)
    docs = df.unionByName(more, allowMissingColumns=True)
    target = spark.createDataFrame([(1, "w1 w2 w3 w4"), (2, None), (3, "The river bends"), (4, "")], "item_id long, text string")
    got = importance.resample(docs, target, spec=spec)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [r.text for r in target.collect()], spec)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert any(r[4] for r in want)


def test_hot_scores(spark):
    """Rows that all tie are ranked without gaps; empty tables give empty and even results."""
    text = " ".join(f"w{i}" for i in range(25))
    same = spark.createDataFrame([(7, text, "en", "s", 1)] * 300, documents(spark).schema)
    ranks = [r["rank"] for r in importance.resample(same, empty(spark)).collect()]
    assert sorted(r for r in ranks if r) == list(range(1, 16)) and len(ranks) == 300
    assert importance.resample(empty(spark), documents(spark)).count() == 0
