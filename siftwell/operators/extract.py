"""Extraction: headings, titles, layout blocks, forms, tables, markup removal.

Everything here is a projection, or a join on (document, block) keys; no
operator gathers more than one size-guarded document in one place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import rules as R
from ..functions.text import fold_out, let, strip

OPEN, CLOSE = "\u0001", "\u0002"
MD_HEADING = r"(?md)^(#{1,6})\s+([^\n]+)"
HTML_HEADING = r"(?i)<h([1-6])[^>]*>([^\n]*?)</h\1>"
MAX_TABLE_ROWS, MAX_TABLE_COLUMNS = 1000, 100


def _matches(text: Column, pattern: str) -> Column:
    """Array of (offset, match) of a pattern, in scan order and without overlaps.

    Matches are fenced by two control characters and the text is split at the
    fences, so every second piece is a match and offsets are running lengths.
    """
    clean = F.translate(text, OPEN + CLOSE, "\u001a\u001a")
    pieces = F.split(F.regexp_replace(clean, pattern, OPEN + "$0" + CLOSE), f"[{OPEN}{CLOSE}]")

    def step(acc, piece):
        hit = F.array(F.struct(acc["at"].alias("start"), acc["i"].alias("place")))
        done = F.when(acc["i"] % 2 == 1, hit).otherwise(acc["done"])
        return F.struct((acc["at"] + F.length(piece)).alias("at"), (acc["i"] + 1).alias("i"), done.alias("done"))

    def found(p):
        places = fold_out(p, {"at": F.lit(0), "i": F.lit(0)}, ("start", "place"), step, lambda acc: acc["done"])
        return F.transform(places, lambda x: F.struct(x["start"].alias("start"), p[x["place"]].alias("text")))

    return let(pieces, found)


def md_heading_array(text: Column) -> Column:
    """Markdown headings as an array of (start, level, heading), built inside the row."""
    return F.transform(_matches(text, MD_HEADING), lambda hit: F.struct(
        hit["start"].alias("start"),
        F.length(F.regexp_extract(hit["text"], MD_HEADING, 1)).alias("level"),
        strip(F.regexp_extract(hit["text"], MD_HEADING, 2)).alias("heading"),
    ))


def html_heading_array(html: Column) -> Column:
    """HTML headings with inner tags removed, as an array of (start, level, heading)."""
    return F.transform(_matches(html, HTML_HEADING), lambda hit: F.struct(
        hit["start"].alias("start"),
        F.regexp_extract(hit["text"], HTML_HEADING, 1).cast("int").alias("level"),
        strip(F.regexp_replace(F.regexp_extract(hit["text"], HTML_HEADING, 2), "<[^>]*>", "")).alias("heading"),
    ))


def _sections(text: Column, pattern: str, level: Callable, heading: Callable) -> Column:
    """Every second piece of the fenced text is a heading; the piece after it is its body."""
    clean = F.translate(text, OPEN + CLOSE, "\u001a\u001a")
    pieces = F.split(F.regexp_replace(clean, pattern, OPEN + "$0" + CLOSE), f"[{OPEN}{CLOSE}]")

    def build(p):
        hits = F.filter(F.transform(p, lambda x, i: F.when(i % 2 == 1, F.struct(x.alias("hit"), p[i + 1].alias("rest")))), lambda s: s.isNotNull())
        return F.transform(hits, lambda s: F.struct(
            level(s["hit"]).alias("level"), heading(s["hit"]).alias("heading"),
            strip(F.concat(s["hit"], s["rest"])).alias("section")))

    return let(pieces, build)


def md_section_array(text: Column) -> Column:
    """Markdown sections as an array of (level, heading, section), each with the text up to the next heading."""
    return _sections(text, MD_HEADING, lambda h: F.length(F.regexp_extract(h, MD_HEADING, 1)),
                     lambda h: strip(F.regexp_extract(h, MD_HEADING, 2)))


def html_section_array(html: Column) -> Column:
    """HTML sections as an array of (level, heading, section)."""
    return _sections(html, HTML_HEADING, lambda h: F.regexp_extract(h, HTML_HEADING, 1).cast("int"),
                     lambda h: strip(F.regexp_replace(F.regexp_extract(h, HTML_HEADING, 2), "<[^>]*>", "")))


def _heading_rows(df: DataFrame, key: str, headings: Column) -> DataFrame:
    return df.select(key, F.posexplode(headings).alias("heading_index", "h")).select(key, "heading_index", "h.*")


def md_headings(df: DataFrame, key: str, text: str) -> DataFrame:
    """Markdown headings: key, heading_index, start, level, heading."""
    return _heading_rows(df, key, md_heading_array(F.col(text)))


def html_headings(df: DataFrame, key: str, html: str) -> DataFrame:
    """HTML headings: key, heading_index, start, level, heading."""
    return _heading_rows(df, key, html_heading_array(F.col(html)))


def resolve_title(file_name: Column, headings: Column, json_title: Column | None = None) -> Column:
    """The JSON title, else the first heading where it is level 1, else the file name."""
    own = json_title if json_title is not None else F.lit(None).cast("string")
    first = F.try_element_at(headings, F.lit(1))
    return F.coalesce(F.nullif(own, F.lit("")), F.when(first["level"] == 1, first["heading"]), file_name)


def heading_level_estimate(text_type: Column, text: Column) -> Column:
    """1 for a block marked as heading, 2 for text ending with a colon, else 3."""
    return (
        F.when(text_type == "HEADING", 1)
        .when(strip(F.coalesce(text, F.lit(""))).endswith(":"), 2)
        .otherwise(3)
    )


def _links(blocks: DataFrame, kind: str) -> Column:
    """Ids of a block's first relationship of a kind."""
    return F.try_element_at(F.filter("relationships", lambda r: r["type"] == kind), F.lit(1))["ids"]


def block_children_text(blocks: DataFrame) -> DataFrame:
    """Own text of a block, or its children's texts in link order: doc_id, id, block_text."""
    has_text = F.coalesce(F.col("text"), F.lit("")) != ""
    own = blocks.filter(has_text).select("doc_id", "id", F.col("text").alias("block_text"))
    wanting = blocks.filter(~has_text).select(
        "doc_id", "id", F.posexplode_outer(_links(blocks, "CHILD")).alias("child_pos", "child_id"))
    texts = own.select("doc_id", F.col("id").alias("child_id"), F.col("block_text").alias("child_text"))
    part = F.when(F.col("child_text").isNotNull(), F.struct("child_pos", "child_text"))
    gathered = wanting.join(texts, ["doc_id", "child_id"], "left").groupBy("doc_id", "id").agg(
        F.array_sort(F.collect_list(part)).alias("parts"))
    return own.unionByName(gathered.select(
        "doc_id", "id", F.array_join(F.transform("parts", lambda p: p["child_text"]), " ").alias("block_text")))


def key_value_pairs(blocks: DataFrame) -> DataFrame:
    """Form fields: doc_id, field, value, pos. A repeated field keeps its last value."""
    is_key = (F.col("block_type") == "KEY_VALUE_SET") & F.array_contains("entity_types", "KEY")
    texts = block_children_text(blocks.filter("block_type in ('KEY_VALUE_SET', 'WORD', 'LINE')"))
    keys = blocks.filter(is_key).select(
        "doc_id", "id", "pos", F.try_element_at(_links(blocks, "VALUE"), F.lit(1)).alias("value_id")
    )
    fields = keys.join(texts.withColumnRenamed("block_text", "field"), ["doc_id", "id"])
    values = texts.select("doc_id", F.col("id").alias("value_id"), F.col("block_text").alias("value"))
    pairs = fields.join(values, ["doc_id", "value_id"]).filter("field <> '' and value <> ''")
    return pairs.groupBy("doc_id", "field").agg(F.max_by("value", "pos").alias("value"), F.max("pos").alias("pos"))


def _placed_cells(blocks: DataFrame) -> DataFrame:
    """Cells at their place and the blocks of tables: doc_id, table_id, row_index, column_index, cell, blocks.

    ``blocks`` is null for a cell; for a table's own row it is the number of its
    TABLE blocks, and that row has no place. Cells of ids that are no table are
    among them. Every step groups by document and one more key and joins nothing,
    so blocks that come hashed by document are not shuffled at all.
    """
    has_text = F.coalesce(F.col("text"), F.lit("")) != ""
    kind = F.col("block_type")
    rows = blocks.filter(kind.isin("TABLE", "CELL", "WORD", "LINE") & ((kind == "TABLE") | (F.col("doc_id").isNotNull() & F.col("id").isNotNull())))
    linked = F.filter("relationships", lambda r: r["type"] == "CHILD")
    rows = rows.select(
        "doc_id", "id", (kind == "TABLE").alias("table"), F.when((kind != "TABLE") & has_text, F.col("text")).alias("text"),
        F.when((kind != "TABLE") & ~has_text, F.coalesce(_links(blocks, "CHILD"), F.array().cast("array<string>"))).alias("children"),
        F.when(kind == "CELL", F.struct(
            "pos", "row_index", "column_index",
            F.array_distinct(F.flatten(F.transform(linked, lambda r: r["ids"]))).alias("tables"))).alias("at"),
    )

    # a row per block at its id, and one per child without which its text is not known, at the child's id;
    # the latter is sorted too and takes nothing of its block along but the id
    wanting = F.col("children").isNotNull()
    own = F.struct(
        F.when(~F.col("table"), F.col("id")).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("int").alias("child_pos"),
        "text", "at", wanting.alias("wanting"), F.when(F.col("table"), F.struct("id")).alias("table"))
    no = {f.name: F.lit(None).cast(f.dataType) for f in rows.select(own.alias("x")).schema["x"].dataType}
    asked = F.transform(F.coalesce("children", F.array().cast("array<string>")), lambda c, i: F.struct(
        c.alias("node"), F.col("id").alias("parent"), i.alias("child_pos"), no["text"].alias("text"), no["at"].alias("at"),
        F.lit(False).alias("wanting"), no["table"].alias("table")))
    rows = rows.select("doc_id", F.explode(F.concat(F.array(own), F.filter(asked, lambda x: x["node"].isNotNull()))).alias("x")).select("doc_id", "x.*")
    mine = F.col("parent").isNull()
    at_node = W.partitionBy("doc_id", "node")
    rows = rows.select(
        "doc_id", F.coalesce("parent", "node").alias("node"), "child_pos", mine.alias("mine"), "at", "wanting", "table",
        F.collect_list("text").over(at_node).alias("texts"),
    ).filter(F.when(F.col("mine"), F.col("at").isNotNull() | F.col("wanting") | F.col("table").isNotNull()).otherwise(F.size("texts") > 0))

    parts = F.flatten(F.collect_list(F.when(~F.col("mine"), F.transform("texts", lambda t: F.struct(F.col("child_pos").alias("pos"), t.alias("text"))))).over(at_node))
    rows = rows.select(
        "doc_id", "at", "table", "texts", F.max("wanting").over(at_node).alias("wanting"), parts.alias("parts"),
    ).filter(F.col("at").isNotNull() | F.col("table").isNotNull())
    gathered = F.array_join(F.transform(F.array_sort("parts"), lambda p: p["text"]), " ")
    texts = F.when(F.col("wanting"), F.concat("texts", F.array(gathered))).otherwise(F.col("texts"))
    rows = rows.select(
        "doc_id", "at", "table", F.when(F.col("table").isNull(), texts).otherwise(F.array(F.lit(None).cast("string"))).alias("texts"),
        F.explode(F.when(F.col("table").isNull(), F.col("at.tables")).otherwise(F.array("table.id"))).alias("table_id"),
    ).filter(F.col("table").isNotNull() | F.col("table_id").isNotNull())
    rows = rows.select("doc_id", "table_id", F.col("table").isNotNull().alias("is_table"), "at.pos", "at.row_index", "at.column_index",
                       F.explode("texts").alias("block_text"))
    return rows.groupBy("doc_id", "table_id", "is_table", "row_index", "column_index").agg(
        F.max_by("block_text", "pos").alias("cell"), F.count(F.when(F.col("is_table"), 1)).alias("n"),
    ).select("doc_id", "table_id", "row_index", "column_index", "cell", F.when(F.col("is_table"), F.col("n")).alias("blocks"))


def table_cells(blocks: DataFrame) -> DataFrame:
    """Every cell of every table in long form, whatever its size: doc_id, table_id, row_index, column_index, cell.

    Of several cells at one place the last in reading order counts.
    """
    known = F.count("blocks").over(W.partitionBy("doc_id", "table_id"))
    rows = _placed_cells(blocks).withColumn("known", known).filter("known > 0 and blocks is null")
    return rows.select("doc_id", "table_id", "row_index", "column_index", "cell")


def table_grid(blocks: DataFrame) -> DataFrame:
    """Cell blocks as rows of text: doc_id, table_id, row_count, column_count, within_limits, grid.

    Gaps are empty strings and rows stay ragged. Tables over the size limit are
    marked and carry no grid; ``table_cells`` has their cells.
    """
    # cells beyond the limits stay out of the grid, so one table is a bounded group
    inside = (F.col("row_index") <= MAX_TABLE_ROWS) & (F.col("column_index") <= MAX_TABLE_COLUMNS)
    line = F.transform(
        F.sequence(F.lit(1), F.array_max(F.map_keys("cells"))),
        lambda c: F.coalesce(F.try_element_at("cells", c), F.lit("")),
    )
    rows = (
        _placed_cells(blocks).groupBy("doc_id", "table_id", "row_index")
        .agg(F.collect_list(F.when(inside, F.struct("column_index", "cell"))).alias("cells"),
             F.max("column_index").alias("column_index"), F.sum("blocks").alias("blocks"))
        .withColumn("cells", F.when(F.size("cells") > 0, F.map_from_entries("cells")))
        .groupBy("doc_id", "table_id")
        .agg(F.collect_list(F.when(F.col("cells").isNotNull(), F.struct("row_index", line.alias("cells")))).alias("rows"),
             F.max("row_index").alias("row_count"), F.max("column_index").alias("column_count"), F.sum("blocks").alias("blocks"))
        .filter("blocks > 0")
        .withColumn("within_limits", (F.col("row_count") <= MAX_TABLE_ROWS) & (F.col("column_count") <= MAX_TABLE_COLUMNS))
        .withColumn("rows", F.when(F.size("rows") > 0, F.map_from_entries("rows")))
    )
    grid = F.when(F.col("within_limits") & F.col("rows").isNotNull(), F.transform(
        F.sequence(F.lit(1), F.col("row_count")),
        lambda r: F.coalesce(F.try_element_at("rows", r), F.array().cast("array<string>")),
    ))
    # a row per TABLE block, as ids may repeat
    return rows.select(
        "doc_id", "table_id",
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.coalesce("column_count", F.lit(0)).alias("column_count"),
        F.coalesce("within_limits", F.lit(True)).alias("within_limits"),
        grid.alias("grid"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("blocks"))).alias("_nth"),
    ).drop("_nth")


def page_lines(blocks: DataFrame) -> DataFrame:
    """LINE and TABLE blocks in reading order with text offset and heading mark.

    The windows run per document, and documents are bounded by the size guard.
    """
    order = W.partitionBy("doc_id").orderBy("pos")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = blocks.filter("block_type in ('LINE', 'TABLE')").select(
        "doc_id", "pos", "block_type", "text_type", text.alias("text"), F.nullif(F.col("page"), F.lit(0)).alias("page")
    )
    lines = lines.withColumn("table_no", F.count(F.when(F.col("block_type") == "TABLE", 1)).over(order))
    emitted = (
        F.when(F.col("block_type") == "TABLE", F.concat(F.lit("[TABLE "), F.col("table_no"), F.lit("]\n")))
        .when(F.col("text") != "", F.concat("text", F.lit("\n")))
        .otherwise("")
    )
    page_so_far = F.coalesce(
        F.last(F.when(F.col("block_type") == "LINE", F.col("page")), ignorenulls=True).over(before), F.lit(1)
    )
    lines = lines.withColumn("emitted", emitted).withColumn("page_so_far", page_so_far)
    short_label = (F.length(strip(F.col("text"))) < 100) & strip(F.col("text")).endswith(":")
    heading = (
        (F.col("block_type") == "LINE")
        & (F.col("text") != "")
        & (
            (F.coalesce("text_type", F.lit("")) == "HEADING")
            | F.coalesce(F.col("page") != F.col("page_so_far"), F.lit(False))
            | short_label
        )
    )
    return lines.withColumn("is_heading", heading).withColumn(
        "start", F.coalesce(F.sum(F.length("emitted")).over(before), F.lit(0)).cast("int")
    )


def page_headings(blocks: DataFrame) -> DataFrame:
    """Headings found in layout lines: doc_id, pos, heading, level, start."""
    return page_lines(blocks).filter("is_heading").select(
        "doc_id", "pos", F.col("text").alias("heading"),
        heading_level_estimate(F.col("text_type"), F.col("text")).alias("level"), "start",
    )


def page_structure(blocks: DataFrame) -> DataFrame:
    """Per document: page_count (the last page seen), heading_count, first_heading and text_length."""
    lines = page_lines(blocks)
    return lines.groupBy("doc_id").agg(
        F.coalesce(F.max_by("page", F.when(F.col("page").isNotNull() & (F.col("block_type") == "LINE"), F.col("pos"))), F.lit(1)).alias("page_count"),
        F.count(F.when(F.col("is_heading"), 1)).alias("heading_count"),
        F.min_by("text", F.when(F.col("is_heading"), F.col("pos"))).alias("first_heading"),
        F.sum(F.length("emitted")).alias("text_length"),
    )


def form_metadata(pairs: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Title, author and date per document, from form fields; query answers override them.

    ``pairs`` has doc_id, field, value, pos; ``answers`` has doc_id, question, answer, pos.
    """
    name = F.lower(F.col("field"))
    kind = F.when(name.contains("title"), "title").when(name.contains("author"), "author").when(name.contains("date"), "date")
    found = pairs.select("doc_id", kind.alias("kind"), "value", "pos", F.lit(0).alias("rank"))
    if answers is not None:
        asked = (
            F.when(F.col("question") == "What is the document title?", "title")
            .when(F.col("question") == "Who is the author of this document?", "author")
            .when(F.col("question") == "What is the date of this document?", "date")
        )
        found = found.unionByName(
            answers.select("doc_id", asked.alias("kind"), F.col("answer").alias("value"), "pos", F.lit(1).alias("rank"))
        )
    weight = F.struct("rank", "pos")
    picks = [
        F.max_by("value", F.when(F.col("kind") == k, weight)).alias(k) for k in ("title", "author", "date")
    ]
    return found.filter("kind is not null and coalesce(value, '') <> ''").groupBy("doc_id").agg(*picks)


def strip_markup(html: Column, rules: list[str] | None = None) -> Column:
    """The removals one after the other, each over the whole text."""
    for pattern in rules or R.MARKUP_REMOVALS:
        html = F.regexp_replace(html, pattern, "")
    return html
