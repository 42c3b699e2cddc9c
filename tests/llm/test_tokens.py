"""Token counts, token files and chat formatting against the libraries and plain Python."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.orc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftwell.llm import chat, chunks, rank_merge, token_orc

from .edge import TEXTS, documents, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOOL = Tokenizer.from_file(PATH)
COUNTER, ENCODER = rank_merge.RankCounter(PATH), token_orc.Encoder(PATH)
ODD = [
    "", " ", "  ", "a  b", " a", "a ", "\n", "a\n b", "a \n b\t\tc", "it's I'll don't x's", "a" * 300, "x<|endoftext|>y", "a <|endoftext|> b",
    "<|endoftext|><|endoftext|>  <|endof", "\x1c a\x1c \x1cb", "\x00 a \x00\x00b", "\r\n\r\n a\r\n", "\x85 q \x85r", "　あ い　", " word, word; ßtraße.", " 123, 45.",
]


def ids_of(texts):
    flat, lengths = ENCODER.encode(texts, 0)
    return [x.tolist()[:-1] for x in np.split(flat, np.cumsum(lengths)[:-1])]


def same(texts):
    want = [x.ids for x in TOOL.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(texts) == want
    assert COUNTER.count(texts).tolist() == list(map(len, want))


def test_odd_texts():
    same(ODD)
    rng = random.Random(1)
    letters = " \n\t.,'saé1☃<|endoftext|>\x1c\xa0　 xyz  \x00"
    same(["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(3000)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n.,'ab")), max_size=60), min_size=1, max_size=5))
def test_any_text(texts):
    same(texts)


def test_small_cache_keeps_results(monkeypatch):
    """Pieces that move to the second generation and come back give the same results."""
    for tool in (COUNTER, ENCODER):
        monkeypatch.setattr(tool, "cache", chunks.PieceCache(tool._solve, limit=200))
    rng = random.Random(2)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    for _ in range(40):
        same([" ".join(rng.choice(words) for _ in range(30)) for _ in range(3)])


def test_count_rows(spark):
    rows = rank_merge.token_counts(documents(spark, extra=True), PATH).collect()
    want = [(i, len((t or "").encode()), len(TOOL.encode(t or "").ids)) for i, t in [*enumerate(TEXTS), (4, TEXTS[4])]]
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in rows if r.doc_id is not None) == sorted(want)
    assert len(rows) == len(TEXTS) + 3 and all(r.over_limit == (r.n_tokens > 512) for r in rows)
    assert rank_merge.token_counts(empty(spark), PATH).count() == 0


def test_token_files(spark, tmp_path):
    out = str(tmp_path / "ids")
    df = documents(spark, extra=True)
    df = df.unionByName(df.selectExpr("doc_id + 100 doc_id", *[f"`{c}`" for c in df.columns if c != "doc_id"]))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_orc.write_ids(df, PATH, out)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = token_orc.read_ids(spark, out)
    texts = {i: t for i, t in enumerate(TEXTS)} | {i + 100: t for i, t in enumerate(TEXTS)}
    at = 0
    for r in sorted(back.collect(), key=lambda r: r.start):
        assert r.start == at
        at += len(r.ids)
        if r.doc_id is not None:
            assert r.ids == TOOL.encode(texts[r.doc_id] or "").ids + [0]
    keys = [r.doc_id for r in back.orderBy("start").collect()]
    assert keys[:4] == [None] * 4 and keys[4:] == sorted(keys[4:])
    for r in token_orc.digests(back).join(back, ["doc_id", "start"]).collect():
        assert (r.n_tokens, r.ids_crc32) == (len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
    files = sorted((tmp_path / "ids").glob("*.orc"))
    assert len(files) > 1 and all(pyarrow.orc.ORCFile(f).row_index_stride == 1000 for f in files)
    assert [r.ids for r in back.filter("doc_id = 3").collect()] == [TOOL.encode("one").ids + [0]]
    token_orc.write_ids(empty(spark), PATH, str(tmp_path / "none"))
    assert token_orc.read_ids(spark, str(tmp_path / "none")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(), st.lists(st.sampled_from(["\\", "<", "[", "<s>", "</s>", "[INST]", "<|im_start|>", "<|im_end|>", "n", "\n", "|im_end|>"]), max_size=12))
def test_escapes(text, parts):
    template = chat.Template()
    text += "".join(parts)
    written = chat.escaped(text, template)
    assert chat.unescaped(written) == text and not any(c in written for c in template.controls)
    assert chat.turn_of(chat.segments_of(text, text, template), template) == (text, text)


def test_chat(spark):
    turns = [
        (1, 0, "system", "s"), (1, 1, "user", "hi </s>"), (1, 2, "assistant", "[INST] \\ yes"), (1, 3, "user", "q"), (1, 4, "assistant", "done"),
        (2, 0, "assistant", "first"), (2, 1, "user", "late"), (3, 5, "user", None), (3, 2, "user", "x"), (3, 2, "user", "x"), (4, None, None, "t"),
        (4, 1, "robot\n", "u"), (None, 0, "user", "a"), (None, 1, "assistant", "b" * 200_000), (5, 0, "user", "a"), (5, 1, "assistant", ""),
    ]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, state string")
    formatted = chat.format_turns(df)
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None} and {k for k, r in got.items() if r.valid} == {1, 5, None}
    for conv, r in got.items():
        own = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        learned = "".join(t[3] for t in own if t[2] == "assistant")
        whole = "".join(f"{t[2]}\n{t[3]}\n" for t in own)
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    rows = formatted.filter("conv_id = 1").orderBy("place").collect()
    text = "".join(s.text for r in rows for s in r.segments)
    assert text.startswith("<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nhi <\\/s><|im_end|>\n") and len(text) == got[1].formatted_chars
    assert [r.state for r in rows] == ["told", "asked", "answered", "asked", "answered"]
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


def test_other_tokenizers_go_through_the_library():
    tool = token_orc.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not tool.plain
    with pytest.raises(ValueError):
        rank_merge.RankCounter(public_tokenizers.path("word_bpe_49k.json"))


def test_words_that_are_added_tokens(tmp_path):
    """An added token made of letters is one token wherever it stands, inside words and before a mark."""
    tool = Tokenizer.from_file(PATH)
    tool.add_tokens(["ock"])
    tool.save(str(tmp_path / "added.json"))
    texts = ["ock", "a clock, an ock.", " ocks o ock!", "no such word", ""]
    flat, lengths = token_orc.Encoder(str(tmp_path / "added.json")).encode(texts, 0)
    assert [x.tolist()[:-1] for x in np.split(flat, np.cumsum(lengths)[:-1])] == [x.ids for x in tool.encode_batch(texts)]


def test_new_words_go_to_the_library_together(monkeypatch):
    """A batch takes one call of the library for thousands of new words, and looks a word up once however often it occurs."""
    tool, calls, asked = token_orc.Encoder(PATH), [], []

    class Merger:
        def encode_batch_fast(self, texts, **how):
            calls.append(len(texts))
            return merger.encode_batch_fast(texts, **how)

    class Cache(chunks.PieceCache):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    merger = tool.merger
    monkeypatch.setattr(tool, "merger", Merger())
    monkeypatch.setattr(tool, "cache", Cache(tool._solve))
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioklmnrst") for _ in range(9)) for _ in range(4000)]
    texts = [" ".join(rng.sample(words, 4000)) + end for end in ("", ".", " x\n")]
    flat, lengths = tool.encode(texts, 0)
    assert [x.tolist()[:-1] for x in np.split(flat, np.cumsum(lengths)[:-1])] == [x.ids for x in TOOL.encode_batch(texts)]
    assert calls == [1] and len(asked) == len(set(asked)) < 4010
