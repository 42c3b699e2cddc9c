"""Packing sizes are tokens: against the tokenizers library."""

from collections import Counter

from tokenizers import Tokenizer

from siftwell.llm import packing
from siftwell.llm.queries import QUERIES, VOCABULARY

FOLDER = "/root/testdata/sf0.001"


def test_sizes_are_tokens_and_end(spark):
    encode = Tokenizer.from_file(VOCABULARY).encode
    texts = ["", "two words", "日本語のテキスト" * 3000, None, "unbreakable" * 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: len(encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    sizes = packing.with_sizes(docs)
    assert {r.doc_id: r.n_tokens for r in sizes.collect()} == want
    pieces = Counter(r.doc_id for r in packing.best_fit(sizes).collect())
    assert pieces == {i: -(-n // 4096) for i, n in want.items()} and pieces[2] > 1


def test_query_fills_sequences_with_tokens(spark):
    encode = Tokenizer.from_file(VOCABULARY).encode
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    total, used = Counter(), Counter()
    for r in QUERIES["op9_best_fit"](spark, FOLDER).collect():
        total[r.doc_id] += r.n_tokens
        used[r.group, r.bin, r.bin_length] += r.n_tokens
    assert total == {r.doc_id: len(encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs}
    assert all(n <= key[2] for key, n in used.items())


def test_rows_alike_are_dealt_to_all_groups(spark):
    """A repeated id and a null id, each far more rows than a group should hold."""
    rows = [(7, 5)] * 600 + [(None, 5)] * 600 + [(i, 5) for i in range(100, 700)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    out = packing.best_fit(df, group_rows=100).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    groups = Counter(r.group for r in out)
    assert len(groups) == 18 and max(groups.values()) < 200
