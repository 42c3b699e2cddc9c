"""One id on several rows: no row is lost for what another one holds."""

import random

from siftwell.llm import cotrain, decontaminate, resemblance, simhash

from .edge import SCHEMA

rng = random.Random(11)


def prose(n=60):
    return " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))


A, B, C, ITEM = prose(), prose(), prose(), prose()
ROWS = [
    (1, A), (1, B), (1, A), (2, A), (2, C), (3, C), (None, A), (None, A), (4, ITEM), (4, prose()), (5, None), (5, ""), (6, None), (6, prose()), (6, ITEM),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], SCHEMA)


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def kept():
    """Of equal texts (none and empty ones too) the row with the smallest id; all rows without an id."""
    first = {}
    for k, t in ROWS:
        if k is not None and (t or "") not in first or k is not None and k < first[t or ""][0]:
            first[t or ""] = (k, t)
    return list(first.values()) + [r for r in ROWS if r[0] is None]


def test_near_duplicates(spark):
    for keep in (simhash.keep_first, resemblance.keep_first):
        got = pairs(keep(table(spark)))
        blank = [r for r in got if not r[1]]
        assert len(blank) == 1 and blank[0][0] == 5
        assert [r for r in got if r[1]] == sorted((r for r in kept() if r[1]), key=repr)


def test_decontamination(spark):
    benchmark = spark.createDataFrame([(9, ITEM)], "item_id long, text string")
    assert pairs(decontaminate.drop_copies(table(spark), benchmark)) == sorted((r for r in ROWS if r[1] != ITEM), key=repr)


def test_training_does_not_depend_on_order(spark):
    rows = [(i % 40, prose(30 + i % 7) if i % 2 else "junk | " * 40) for i in range(160)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    models = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        models.append(cotrain.train(table(spark, rows).repartition(seed + 2), labels))
    assert models[0] == models[1]
