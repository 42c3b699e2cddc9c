"""Chunkers against plain loops over the same sentences."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siftwell.functions import rules as R
from siftwell.operators import chunk as C

WORDS = ["However", "then", "alpha", "beta", "First", "he", "said", "it", '"quote"', "über", "naïve", "thus", "end"]


def split(text):
    return [s for s in re.sub(r"([.!?])\s+", "\\1\x01", text).split("\x01") if s]


def make_text(seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(rnd.randint(1, 40)):
        sentence = " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 14)))
        out.append(sentence + rnd.choice([".", "!", "?", ".\n\n", ""]))
    return " ".join(out)


TEXTS = ["", "Short.", "no stop at all " * 30, "Same. " * 10, "Ünïcode 🙂 text. Second 🙂 one!"] + [make_text(i) for i in range(25)]


def greedy(text, size, lap):
    chunks, cur, count = [], "", 0
    for s in split(text):
        if cur and count + len(s) > size:
            chunks.append(cur)
            cur = cur[-lap:] + " " + s
            count = len(cur)
        else:
            cur = f"{cur} {s}" if cur else s
            count += len(s)
    return [c.strip() for c in chunks + [cur] if c.strip()]


def kept(buf, lap, at_least_one=False):
    out = []
    for s in reversed(buf):
        if sum(map(len, out)) + len(s) > lap:
            break
        out.insert(0, s)
    return out or (buf[-1:] if at_least_one else [])


def chars(text, target, most, least, lap):
    chunks, cur, mark = [], "", 0
    for ch in text:
        cur += ch
        if ch in ".!?":
            mark = len(cur)
        if len(cur) >= target and mark:
            chunks.append(cur[:mark])
            cur, mark = cur[max(0, mark - lap):], 0
        if len(cur) >= most:
            chunks.append(cur)
            cur, mark = "", 0
    if cur and (len(cur) >= least or not chunks):
        chunks.append(cur)
    elif cur:
        chunks[-1] += cur
    return chunks


def rows_by_doc(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.doc_id, r.chunk_index)):
        out.setdefault(r.doc_id, []).append(r.content)
    return [out.get(i, []) for i in range(len(TEXTS))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")


def config(target, most, least, lap):
    return F.struct(F.lit(target).alias("target"), F.lit(most).alias("max"), F.lit(least).alias("min"), F.lit(lap).alias("overlap"))


@pytest.mark.parametrize("size,lap", [(120, 30), (60, 15)])
def test_greedy(docs, size, lap):
    assert rows_by_doc(C.chunk_greedy(docs, "doc_id", "text", size, lap)) == [greedy(t, size, lap) for t in TEXTS]


@pytest.mark.parametrize("target,most,least,lap", [(60, 120, 20, 15), (100, 80, 10, 40), (50, 50, 5, 0)])
def test_chars(docs, target, most, least, lap):
    got = rows_by_doc(C.chunk_chars(docs, "doc_id", "text", config(target, most, least, lap)))
    assert got == [chars(t, target, most, least, lap) for t in TEXTS]


def test_whole_sentence_overlap(spark):
    text = " ".join(f"Sentence number {i} has some words in it." for i in range(120))
    df = spark.createDataFrame([(0, text)], "doc_id int, text string")
    rows = C.chunk_sentence_overlap(df, "doc_id", "text").orderBy("chunk_index").collect()
    want, cur, count, buf = [], "", 0, []
    for s in split(text):
        if cur and count + len(s) > 750:
            want.append(cur)
            buf = kept(buf, 100)
            cur = " ".join(buf + [s])
            count = len(cur)
        else:
            cur = f"{cur} {s}" if cur else s
            count += len(s)
        buf = buf + [s]
    assert [r.content for r in rows] == want + [cur]


def is_break(cur, nxt):
    low = nxt.strip().lower()
    c, n = cur.strip(), nxt.strip()
    return (
        "\n\n" in c or any(low.startswith(m) for m in R.TRANSITION_MARKERS)
        or (c.endswith(('"', "'")) and not n.startswith('"')) or any(m in low[:50] for m in R.TIME_MARKERS)
        or bool(re.match(R.SPEAKER_START, n)) or bool(re.match(R.SPEAKER_QUOTE, n)))


def good(cur, nxt):
    c, n = cur.strip(), nxt.strip()
    return (
        (c.endswith(".") and (not n or n[0].isupper())) or any(w in c.lower() for w in R.CONCLUSION_WORDS)
        or any(n.lower().startswith(w) for w in R.TOPIC_STARTS))


def test_semantic(docs):
    target, most, least, lap = 150, 220, 30, 40
    want = []
    for text in TEXTS:
        chunks, buf, sents = [], [], split(text)
        for i, s in enumerate(sents):
            cur = " ".join(buf)
            if cur and ((i and is_break(sents[i - 1], s) and len(cur) >= least) or len(cur) + len(s) > most):
                chunks.append(cur.strip())
                buf = kept(buf, lap, True)
            buf = buf + [s]
            cur = " ".join(buf)
            if len(cur) >= target and i + 1 < len(sents) and good(s, sents[i + 1]):
                chunks.append(cur.strip())
                buf = []
        cur = " ".join(buf)
        if cur.strip() and (len(cur) >= least or not chunks):
            chunks.append(cur.strip())
        elif cur.strip():
            chunks[-1] += " " + cur.strip()
        want.append(chunks)
    assert rows_by_doc(C.chunk_semantic(docs, "doc_id", "text", config(target, most, least, lap))) == want


def test_strict_breakpoint_never_sees_a_capital(spark):
    df = spark.createDataFrame([("One.", "Two.")], "a string, b string")
    row = df.select(C.good_breakpoint(F.col("a"), F.col("b")).alias("x"), C.good_breakpoint(F.col("a"), F.col("b"), strict=True).alias("y")).first()
    assert (row.x, row.y) == (True, False)


def test_sections_and_importance(spark):
    text = "# Introduction\nsome words here. More words.\n## Details\nbody\n# Appendix"
    starts = [(0, 1, "Introduction"), (text.index("## D"), 2, "Details"), (text.index("# App"), 1, "Appendix")]
    df = spark.createDataFrame([(0, text, starts)], "doc_id int, text string, s array<struct<start:int,level:int,heading:string>>")
    rows = C.sections(df, "doc_id", "text", "s").orderBy("section_index").collect()
    assert [r.section for r in rows] == [text[:starts[1][0]].strip(), "## Details\nbody", "# Appendix"]
    scored = C.sections(df, "doc_id", "text", "s").select(C.section_importance(F.col("level"), F.col("heading"), F.col("section")).alias("x")).collect()
    assert [round(r.x, 2) for r in scored] == [2.0, 1.75, 1.9]
    routed = C.route_chunker(df, "doc_id", "text", "s").collect()
    assert {r.chunk_type for r in routed} == {"section"} and all(0 <= r.importance <= 2 for r in routed)


def test_neighbours(spark):
    rows = [(0, i, f"h{i}", "paragraph", f"s{i}") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id int, chunk_index int, heading string, chunk_type string, context_summary string")
    got = C.chunk_neighbours(df, "doc_id").orderBy("chunk_index").collect()
    assert [r.prev_context and r.prev_context.heading for r in got] == [None, "h0", "h1"]
    assert [r.relative_position for r in got] == [1 / 3, 2 / 3, 1.0]
