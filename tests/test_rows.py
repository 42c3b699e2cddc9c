"""Extraction, screening, logs, prompts, lifecycle and sources on literal rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from siftwell.functions.text import estimate_tokens, first_sentence, is_title, proper_nouns, sentences, words
from siftwell.operators import describe as D, extract as X, lifecycle as L, logs as G, prompt as P, screen as S
from siftwell.sources import corpus as C, events as E

BLOCK = ("doc_id int, id string, pos long, block_type string, text_type string, text string, page int, row_index int, column_index int, "
         "entity_types array<string>, relationships array<struct<type:string,ids:array<string>>>")


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_text(spark):
    lit = F.lit
    row = one(spark, tokens=estimate_tokens(lit("Hello, world!")), sents=sentences(lit("One. Two! Three")), first=first_sentence(lit("One. Two")),
              none=first_sentence(lit("")), title=is_title(lit("A Title Here")), low=is_title(lit("A title")), w=words(lit("  a  b\n")))
    assert (row.tokens, row.sents, row.first, row.none, row.title, row.low, row.w) == (3, ["One.", "Two!", "Three"], "One.", None, True, False, ["a", "b"])


def test_headings(spark):
    md = "# One\ntext\n## Two\n\n### Three ###\n####### no\n#nope\n## Two again"
    df = spark.createDataFrame([(0, md)], "doc_id int, t string")
    rows = X.md_headings(df, "doc_id", "t").orderBy("start").collect()
    assert [(r.level, r.heading, r.start) for r in rows] == [
        (1, "One", 0), (2, "Two", md.index("## Two")), (3, "Three ###", md.index("###")), (2, "Two again", md.index("## Two again"))]
    html = '<H1 class="a">A <b>b</b></h1><h2>x</h3><h3>C</h3>'
    rows = X.html_headings(spark.createDataFrame([(0, html)], "doc_id int, t string"), "doc_id", "t").collect()
    assert [(r.level, r.heading, r.start) for r in rows] == [(1, "A b", 0), (3, "C", html.index("<h3>"))]


def test_blocks(spark):
    link = lambda kind, *ids: [(kind, list(ids))]
    rows = [
        (0, "p", 0, "CELL", None, None, 1, None, None, None, link("CHILD", "c2", "c1", "gone")),
        (0, "c1", 1, "WORD", None, "one", 1, None, None, None, None), (0, "c2", 2, "WORD", None, "two", 1, None, None, None, None),
        (0, "k", 3, "KEY_VALUE_SET", None, "Title", 1, None, None, ["KEY"], link("VALUE", "v")),
        (0, "v", 4, "KEY_VALUE_SET", None, None, 1, None, None, ["VALUE"], link("CHILD", "c1")),
        (0, "k2", 5, "KEY_VALUE_SET", None, "Lost", 1, None, None, ["KEY"], None),
        (0, "t", 6, "TABLE", None, None, 1, None, None, None, None),
        (0, "x1", 7, "CELL", None, "a", 1, 1, 1, None, link("CHILD", "t")), (0, "x2", 8, "CELL", None, "b", 1, 3, 2, None, link("CHILD", "t")),
    ]
    blocks = spark.createDataFrame(rows, BLOCK)
    texts = {r.id: r.block_text for r in X.block_children_text(blocks).collect()}
    assert texts["p"] == "two one" and texts["k2"] == "Lost" and texts["t"] == ""
    pairs = X.key_value_pairs(blocks)
    assert [(r.field, r.value) for r in pairs.collect()] == [("Title", "one")]
    assert X.form_metadata(pairs).first().title == "one"
    grid = X.table_grid(blocks).first()
    assert (grid.row_count, grid.column_count, grid.grid) == (3, 2, [["a"], [], ["", "b"]])


def test_table_over_the_limit_is_marked(spark):
    rows = [(0, "t", 0, "TABLE", None, None, 1, None, None, None, None), (0, "x", 1, "CELL", None, "a", 1, 1001, 1, None, [("CHILD", ["t"])])]
    grid = X.table_grid(spark.createDataFrame(rows, BLOCK)).first()
    assert (grid.within_limits, grid.grid) == (False, None)


def test_tables_of_hashed_blocks_need_no_shuffle(spark):
    child = lambda *ids: [("CHILD", list(ids))]
    block = lambda doc, id, pos, kind, text=None, row=None, col=None, links=None: (doc, id, pos, kind, None, text, 1, row, col, None, links)
    rows = [
        block(0, "t", 0, "TABLE"), block(0, "t", 1, "TABLE"), block(1, "u", 0, "TABLE"), block(None, "t", 0, "TABLE"),
        block(0, "a", 2, "CELL", "old", 1, 1, child("t")), block(0, "b", 3, "CELL", "new", 1, 1, child("t", "t")),
        block(0, "c", 4, "CELL", None, 2, 2, child("w2", "w1", "t", "gone")), block(0, "w1", 5, "WORD", "one"), block(0, "w2", 6, "WORD", "two"),
        block(0, "d", 7, "CELL", "", 2, 1, [("CHILD", ["w1"]), ("CHILD", ["t"])]), block(0, "e", 8, "CELL", "lost", 1, 3, child("no table")),
        block(0, "f", 9, "CELL", "", 3, 1, child("t")), block(None, "g", 9, "CELL", "x", 1, 1, child("t")),
    ]
    blocks = spark.createDataFrame(rows, BLOCK).repartition(3, "doc_id")
    cells, grids = X.table_cells(blocks), X.table_grid(blocks)
    assert {(r.doc_id, r.table_id, r.row_index, r.column_index): r.cell for r in cells.collect()} == {
        (0, "t", 1, 1): "new", (0, "t", 2, 2): "two one", (0, "t", 2, 1): "one", (0, "t", 3, 1): ""}
    found = sorted(map(str, grids.drop("within_limits").collect()))
    grid = "Row(doc_id=0, table_id='t', row_count=3, column_count=2, grid=[['new'], ['one', 'two one'], ['']])"
    assert found == [grid, grid, "Row(doc_id=1, table_id='u', row_count=0, column_count=0, grid=None)",
                     "Row(doc_id=None, table_id='t', row_count=0, column_count=0, grid=None)"]
    for df in (cells, grids):
        assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_cells_are_sorted_without_their_links(spark):
    plan = X.table_cells(spark.createDataFrame([], BLOCK))._jdf.queryExecution().optimizedPlan()
    windows, nodes = [], [plan]
    for node in nodes:
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        windows += [node] if node.nodeName() == "Window" else []
    out = windows[-1].children().apply(0).output()
    assert {out.apply(i).name() for i in range(out.size())} <= {"doc_id", "node", "parent", "child_pos", "text", "at", "wanting", "table", "mine"}


def test_markup(spark):
    row = one(spark, x=X.strip_markup(F.lit('<p onclick="go()">a</p><script>b</script> data:image/png;base64,zz data:text &#39; &#60; eval (')))
    assert row.x == "<p>a</p> data:image/png;base64,zz text &#39;  "


def test_description(spark):
    text = '"Where is the king?" asked Ann Lee. "I do not know," said Bob.'
    row = spark.createDataFrame([(text,)], "content string").transform(D.describe).first()
    assert row.chunk_type == "dialogue" and row.topics == ["royalty"] and row.importance_score == 2.0
    assert row.key_entities[:2] == ["Ann Lee", "Bob"]
    whole = one(spark, loose=D.chunk_type(F.lit("strengthen it")), strict=D.chunk_type(F.lit("strengthen it"), whole_word=True))
    assert (whole.loose, whole.strict) == ("action", "paragraph")


def test_runs_of_capitals(spark):
    text = "Ann Lee met Bob9 Ray. Per \n Ole Dag_ saw Éva Mo Ni, ToM Ida"
    row = one(spark, runs=proper_nouns(F.lit(text)), none=proper_nouns(F.lit(None).cast("string")), long=proper_nouns(F.repeat(F.lit("Aabc "), F.lit(50000))))
    assert (row.runs, row.none) == (["Ann Lee", "Ray", "Per \n Ole", "Mo Ni", "Ida"], None)
    assert [len(x) for x in row.long] == [5 * 50000 - 1]


@pytest.mark.parametrize("dim", [5, 16, 40, 64])
def test_hash_vectors_repeat(spark, dim):
    row = one(spark, v=D.hash_embedding(F.lit("some text"), dim), none=D.hash_embedding(F.lit(None).cast("string"), dim))
    digest = hashlib.md5(b"some text").digest()
    assert row.v == [(digest[0 if i % 16 == 15 else i % 16] / 255.0 - 0.5) * 0.2 for i in range(dim)]
    assert row.none == [None] * dim


def test_keywords_break_ties_by_place(spark):
    df = spark.createDataFrame([(1, "zebra apple apple zebra mango the the the the"), (2, "")], "doc_id int, t string")
    rows = D.keyword_top(df, "doc_id", "t").orderBy("rank").collect()
    assert [r.term for r in rows] == ["zebra", "apple", "mango"]
    asked = {r.doc_id: r.questions for r in D.follow_up_questions(df, "doc_id", "t").collect()}
    assert asked[1][0] == "Tell me more about zebra" and asked[2][0] == "Can you explain more about that?"


@pytest.mark.parametrize("text,reason", [("", "empty"), ("  ", "empty"), ("x" * 2001, "too_long"), ("<SCRIPT>", "unsafe"), ("eval(1)", "unsafe"), ("${x}", "unsafe"), ("  fine ", None)])
def test_screen(spark, text, reason):
    row = S.screen_message(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert row.reason == reason and row.clean_text == (text.strip() if reason is None else None)


def test_frames_and_spam(spark):
    row = one(spark, missing=S.screen_frame(F.lit("sendMessage"), F.lit(None).cast("string")), other=S.screen_frame(F.lit("x"), F.lit("hi")),
              beat=S.screen_frame(F.lit("heartbeat"), F.lit(None).cast("string")), spam=S.prefilter_reason(F.lit("aaaaaaaaaaaa")),
              fine=S.prefilter_reason(F.lit("damn it")), rude=S.prefilter_reason(F.lit("damn damn Damn damn")),
              red=S.redact_log(F.lit("my access_token")), plain=S.redact_log(F.lit("all good")))
    assert row.missing == ["Message is required"] and row.other == ["Unknown action: x"] and row.beat == []
    assert (row.spam, row.fine, row.rude) == ("spam", None, "profanity")
    assert row.red.endswith(": token") and row.plain == "all good"


def test_logs(spark):
    lines = [("a", i, x) for i, x in enumerate(["ok", "Permission denied", "AccessDenied here", "end", "tail"])] + [("b", 0, "error: x"), ("b", 1, "FAILED: y"), ("c", 0, "ok")]
    df = spark.createDataFrame(lines, "file string, line_no long, line string")
    hits = G.match_signatures(df)
    assert [(r.file, r.error_type, r.match_line) for r in hits.collect()] == [("a", "aws_permissions", 2)]
    assert sorted(r.line_no for r in G.log_context(df, hits).collect()) == [0, 1, 2, 3, 4]
    assert [(r.file, r.excerpt) for r in G.generic_errors(df, hits).collect()] == [("b", "error: x")]
    row = one(spark, a=G.classify_error(F.lit("X"), F.lit("bad signature")), b=G.retryable_call(F.lit("ClientError"), F.lit("")), c=G.retryable_ingest(F.lit("ClientError"), F.lit("")))
    assert (row.a, row.b, row.c) == ("SIGNING_ERROR", True, False)


def test_prompt(spark):
    blocks = spark.createDataFrame([(1, i, "x" * 40) for i in range(1, 5)], "query_id int, rank int, block string")
    assert [r["rank"] for r in P.budget_context(blocks, 25).collect()] == [1, 2]
    asked = spark.createDataFrame([(1, "Why?")], "query_id int, query_text string")
    short = P.optimize_prompt(blocks, asked, 90).first().prompt
    assert "User question: Why?" in short and short.count("x" * 40) < 4
    frames = spark.createDataFrame([(1, 2, "chunk", "b"), (1, 1, "chunk", "a"), (1, 3, "end", "ab"), (2, 1, "error", None)], "connection_id int, seq int, type string, text string")
    rows = {r.connection_id: (r.text, r.matches_end, r.failed) for r in P.assemble_frames(frames).collect()}
    assert rows == {1: ("ab", True, False), 2: ("", False, True)}


def test_lifecycle(spark):
    rows = spark.createDataFrame([("a", "d1", "2024-01-01", 1), ("b", "d2", "2024-06-01", 2)], "key string, doc_id string, d string, v int").select("key", "doc_id", F.col("d").cast("timestamp").alias("created_at"), "v")
    assert [r.key for r in L.expire_vectors(rows, "2024-06-10").collect()] == ["b"]
    assert L.expire_vectors(rows, "2024-06-10", dry_run=True).first().would_delete == 1
    assert [r.key for r in L.delete_documents(rows, spark.createDataFrame([("d1",)], "doc_id string")).collect()] == ["b"]
    newer = rows.filter("key = 'a'").withColumn("v", F.lit(9))
    assert {r.key: r.v for r in L.upsert_vectors(rows, newer).collect()} == {"a": 9, "b": 2}


def test_corpus_reading(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# Title\nbody")
    (tmp_path / "sub" / "b.html").write_text("<p>hi</p>")
    (tmp_path / "skip.exe").write_text("x")
    rows = {r.doc_id: r.text for r in C.corpus_text(C.read_text_corpus(spark, str(tmp_path))).collect()}
    assert rows == {"a.md": "# Title\nbody", "sub_b.html": "hi"}
    rejected = C.rejected_files(spark, str(tmp_path), max_bytes=9).collect()
    assert sorted((r.size, r.reject_reason) for r in rejected) == [(1, "unsupported_type"), (12, "file_too_large")]
    assert C.read_text_corpus(spark, str(tmp_path), max_bytes=9).count() == 1


def test_events(spark):
    df = spark.createDataFrame([('{"level": "INFO", "line": 3, "cache_event": true, "x": "y"}',), ("not json",)], "v string")
    rows = df.select(E.parse_event(F.col("v")).alias("e")).collect()
    assert rows[0].e.level == "INFO" and rows[0].e.line == 3 and rows[0].e.family == "cache_event" and rows[0].e.extra["x"] == "y"
    assert rows[1].e is None
