"""Extraction: X1 to X10. Layout blocks are derived from the star-schema tables and documents."""

from pyspark.sql import Window as W, functions as F

from ..functions import rules as R
from ..operators import extract as X
from ..session import tasks_for
from . import shared, sqltext as S
from .registry import query

BLOCK = "array<struct<type:string,ids:array<string>>>"
COLUMNS = {
    "block_type": "string", "text_type": "string", "text": "string", "page": "int", "row_index": "int", "column_index": "int",
    "entity_types": "array<string>", "relationships": BLOCK,
}


def _blocks(df, **values):
    """Block rows: given columns, the others null."""
    cols = [(values[c] if c in values else F.lit(None)).cast(ty).alias(c) for c, ty in COLUMNS.items()]
    return df.select(values["doc_id"].alias("doc_id"), values["id"].alias("id"), values["pos"].cast("bigint").alias("pos"), *cols)


def _link(kind, ids):
    return F.array(F.struct(F.lit(kind).alias("type"), ids.alias("ids")))


@query("md_headings", sql=rf"""
WITH p AS (SELECT doc_id, string_split_regex(regexp_replace({shared.MD_SQL}, '(?m)^(#{{1,6}})\s+([^\n]+)', chr(1) || '\0' || chr(2), 'g'), '[\x01\x02]') AS pieces FROM documents),
u AS (SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM p),
o AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM u)
SELECT doc_id, (i // 2 - 1)::INT AS heading_index, start, length(regexp_extract(piece, '^(#+)\s', 1))::INT AS level,
       {S.strip(r"regexp_extract(piece, '^#{1,6}\s+([^\n]+)', 1)")} AS heading FROM o WHERE i % 2 = 0""")
def _(t):
    return X.md_headings(shared.markdown(t), "doc_id", "md")


HTML_ALT = "|".join(rf"<h{i}[^>]*>[^\n]*?</h{i}>" for i in range(1, 7))
HTML_PIECES = rf"""p AS (SELECT page_id, url, string_split_regex(regexp_replace(html, '(?i){HTML_ALT}', chr(1) || '\0' || chr(2), 'g'), '[\x01\x02]') AS pieces FROM pages),
u AS (SELECT page_id, url, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM p),
o AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM u),
heads AS (SELECT page_id, (i // 2 - 1)::INT AS heading_index, start, substr(piece, 3, 1)::INT AS level, {S.strip("regexp_replace(piece, '<[^>]*>', '', 'g')")} AS heading FROM o WHERE i % 2 = 0)"""


@query("html_headings", sql=f"WITH {HTML_PIECES} SELECT * FROM heads")
def _(t):
    return X.html_headings(t.pages, "page_id", "html")


@query("resolve_title", sql=f"""
WITH {HTML_PIECES}
SELECT p.page_id, CASE WHEN p.page_id % 5 = 0 THEN 'json ' || p.page_id WHEN h.level = 1 THEN h.heading ELSE list_last(string_split(p.url, '/')) END AS title
FROM pages p LEFT JOIN heads h ON p.page_id = h.page_id AND h.heading_index = 0""")
def _(t):
    own = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("json "), F.col("page_id").cast("string")))
    title = X.resolve_title(F.substring_index("url", "/", -1), X.html_heading_array(F.col("html")), own)
    return t.pages.select("page_id", title.alias("title"))


LINES = r"""doc_lines AS (
  SELECT doc_id, (i - 1)::BIGINT AS pos, CASE WHEN i % 10 = 0 THEN 'TABLE' ELSE 'LINE' END AS block_type,
         CASE WHEN i % 7 = 0 THEN 'HEADING' END AS text_type, CASE WHEN i % 10 > 0 THEN CASE WHEN i % 4 = 0 THEN line || ':' ELSE line END END AS text,
         ((i - 1) // 5 + 1)::INT AS page
  FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)))"""


def _line_blocks(t):
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).withColumn("i", F.col("p") + 1)
    text = F.when(F.col("i") % 10 > 0, F.when(F.col("i") % 4 == 0, F.concat("line", F.lit(":"))).otherwise(F.col("line")))
    return _blocks(
        rows, doc_id=F.col("doc_id"), id=F.col("p").cast("string"), pos=F.col("p"),
        block_type=F.when(F.col("i") % 10 == 0, "TABLE").otherwise("LINE"), text_type=F.when(F.col("i") % 7 == 0, "HEADING"),
        text=text, page=F.floor(F.col("p") / 5) + 1)


PAGE_SQL = rf"""{LINES},
l1 AS (SELECT *, coalesce(text, '') AS tx, count(CASE WHEN block_type = 'TABLE' THEN 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS table_no,
   coalesce(last_value(CASE WHEN block_type = 'LINE' THEN page END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS so_far FROM doc_lines),
l2 AS (SELECT *, CASE WHEN block_type = 'TABLE' THEN '[TABLE ' || table_no || ']' || chr(10) WHEN tx <> '' THEN tx || chr(10) ELSE '' END AS emitted,
   block_type = 'LINE' AND tx <> '' AND (coalesce(text_type, '') = 'HEADING' OR page <> so_far OR (length({S.strip('tx')}) < 100 AND suffix({S.strip('tx')}, ':'))) AS is_heading FROM l1),
l3 AS (SELECT *, coalesce(sum(length(emitted)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM l2)"""


@query("heading_level_estimate", sql=f"""
WITH {LINES} SELECT doc_id, pos, CASE WHEN text_type = 'HEADING' THEN 1 WHEN suffix({S.strip("coalesce(text, '')")}, ':') THEN 2 ELSE 3 END AS level FROM doc_lines""")
def _(t):
    return _line_blocks(t).select("doc_id", "pos", X.heading_level_estimate(F.col("text_type"), F.col("text")).alias("level"))


@query("page_structure", sql=f"""
WITH {PAGE_SQL}
SELECT doc_id, coalesce(arg_max(CASE WHEN block_type = 'LINE' THEN page END, CASE WHEN block_type = 'LINE' THEN pos END), 1) AS page_count,
       count(CASE WHEN is_heading THEN 1 END) AS heading_count, arg_min(tx, CASE WHEN is_heading THEN pos END) AS first_heading,
       sum(length(emitted))::BIGINT AS text_length FROM l3 GROUP BY doc_id""")
def _(t):
    return X.page_structure(_line_blocks(t))


@query("page_headings", sql=f"""
WITH {PAGE_SQL}
SELECT doc_id, pos, tx AS heading, CASE WHEN text_type = 'HEADING' THEN 1 WHEN suffix({S.strip('tx')}, ':') THEN 2 ELSE 3 END AS level, start FROM l3 WHERE is_heading""")
def _(t):
    return X.page_headings(_line_blocks(t))


@query("block_children_text", sql="""
SELECT p_partkey AS doc_id, 'parent' AS id, CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE replace(p_name, ' ', ' ') END AS block_text FROM part
UNION ALL SELECT p_partkey, 'word' || i, w FROM (SELECT p_partkey, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM (SELECT p_partkey, string_split(p_name, ' ') AS ws FROM part))""")
def _(t):
    words = F.split("p_name", " ")
    ids = F.transform(words, lambda w, i: F.concat(F.lit("word"), i.cast("string")))
    parents = _blocks(t.part, doc_id=F.col("p_partkey"), id=F.lit("parent"), pos=F.lit(0), block_type=F.lit("CELL"),
                      text=F.when(F.col("p_partkey") % 4 == 0, F.col("p_type")), relationships=_link("CHILD", ids))
    split = t.part.select("p_partkey", F.posexplode(words).alias("i", "w"))
    children = _blocks(split, doc_id=F.col("p_partkey"), id=F.concat(F.lit("word"), F.col("i").cast("string")), pos=F.col("i") + 1,
                       block_type=F.lit("WORD"), text=F.col("w"))
    return X.block_children_text(parents.unionByName(children))


FORM_FIELDS = [("Document Title", "c_name", 1), ("Author", "c_mktsegment", 1), ("Issue date", "c_nationkey", 1), ("Author", "c_custkey", 2)]
FORMS_SQL = "forms AS (" + " UNION ALL ".join(
    f"SELECT c_custkey AS doc_id, '{name}' AS field, {col}::VARCHAR AS value, {10 * n}::BIGINT AS pos FROM customer WHERE c_custkey % {step} = 0"
    for n, (name, col, step) in enumerate(FORM_FIELDS, 1)) + ")"


def _forms(t):
    out = None
    for n, (name, col, step) in enumerate(FORM_FIELDS, 1):
        rows = t.customer.filter(F.col("c_custkey") % step == 0)
        doc = F.col("c_custkey")
        key, value, word = F.lit(f"k{n}"), F.lit(f"v{n}"), F.lit(f"w{n}")
        part = (
            _blocks(rows, doc_id=doc, id=key, pos=F.lit(10 * n), block_type=F.lit("KEY_VALUE_SET"), text=F.lit(name),
                    entity_types=F.array(F.lit("KEY")), relationships=_link("VALUE", F.array(value)))
            .unionByName(_blocks(rows, doc_id=doc, id=value, pos=F.lit(10 * n + 1), block_type=F.lit("KEY_VALUE_SET"),
                                 entity_types=F.array(F.lit("VALUE")), relationships=_link("CHILD", F.array(word))))
            .unionByName(_blocks(rows, doc_id=doc, id=word, pos=F.lit(10 * n + 2), block_type=F.lit("WORD"), text=F.col(col).cast("string"))))
        out = part if out is None else out.unionByName(part)
    return out


@query("key_value_pairs", sql=f"""
WITH {FORMS_SQL} SELECT doc_id, field, arg_max(value, pos) AS value, max(pos) AS pos FROM forms WHERE value <> '' GROUP BY doc_id, field""")
def _(t):
    return X.key_value_pairs(_forms(t))


@query("form_metadata", sql=f"""
WITH {FORMS_SQL}, a AS (SELECT c_custkey AS doc_id, 'answer ' || c_custkey AS answer FROM customer WHERE c_custkey % 3 = 0)
SELECT doc_id, coalesce(max(a.answer), max(CASE WHEN field = 'Document Title' THEN value END)) AS title,
       arg_max(value, CASE WHEN field = 'Author' THEN pos END) AS author, max(CASE WHEN field = 'Issue date' THEN value END) AS date
FROM forms LEFT JOIN a USING (doc_id) GROUP BY doc_id""")
def _(t):
    answers = t.customer.filter("c_custkey % 3 = 0").select(
        F.col("c_custkey").alias("doc_id"), F.lit("What is the document title?").alias("question"),
        F.concat(F.lit("answer "), F.col("c_custkey").cast("string")).alias("answer"), F.lit(0).cast("bigint").alias("pos"))
    return X.form_metadata(X.key_value_pairs(_forms(t)), answers)


# Block ids come from these four columns, so lines that agree in them are one line.
CELL_SQL = """lines AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus FROM lineitem GROUP BY ALL),
cells AS (
  SELECT doc_id, r, c, arg_max(cell, pos) AS cell FROM (
    SELECT l_orderkey AS doc_id, l_linenumber AS r, 1 AS c, l_returnflag AS cell, l_partkey * 100000 + l_suppkey AS pos FROM lines
    UNION ALL SELECT l_orderkey, l_linenumber, 3, l_linestatus || ' line', l_partkey * 100000 + l_suppkey FROM lines WHERE l_returnflag <> 'R') GROUP BY ALL)"""


@query("table_grid", sql=f"""
WITH {CELL_SQL},
sizes AS (SELECT doc_id, max(r) AS row_count, max(c) AS column_count FROM cells GROUP BY doc_id),
rws AS (SELECT s.doc_id, g.r, s.row_count, s.column_count, (SELECT max(c) FROM cells x WHERE x.doc_id = s.doc_id AND x.r = g.r) AS width
        FROM sizes s, LATERAL (SELECT unnest(range(1, s.row_count + 1)) AS r) g),
txt AS (SELECT rws.doc_id, rws.r, row_count, column_count, coalesce(string_agg(coalesce(cells.cell, ''), '|' ORDER BY h.c), '') AS line
        FROM rws LEFT JOIN LATERAL (SELECT unnest(range(1, coalesce(rws.width, 0) + 1)) AS c) h ON true
        LEFT JOIN cells ON cells.doc_id = rws.doc_id AND cells.r = rws.r AND cells.c = h.c GROUP BY ALL)
SELECT doc_id, 't' AS table_id, row_count::INT AS row_count, column_count::INT AS column_count, true AS within_limits, string_agg(line, '/' ORDER BY r) AS grid
FROM txt GROUP BY doc_id, row_count, column_count""")
def _(t):
    grid = X.table_grid(_table_blocks(t))
    joined = F.transform("grid", lambda r: F.array_join(r, "|"))
    return grid.withColumn("grid", F.array_join(joined, "/"))


@query("table_cells", sql=f"WITH {CELL_SQL} SELECT doc_id, 't' AS table_id, r::INT AS row_index, c::INT AS column_index, cell FROM cells")
def _(t):
    return X.table_cells(_table_blocks(t))


def _block(**values):
    """A block but its document as a struct: given columns, the others null."""
    cols = [(values[c] if c in values else F.lit(None)).cast(ty).alias(c) for c, ty in COLUMNS.items()]
    return F.struct(values["id"].alias("id"), values["pos"].cast("bigint").alias("pos"), *cols)


TASK_BYTES = 512 * 1024  # of files: a line is some 6 to 10 bytes there, and two kilobytes or so while its blocks are sorted


def _table_blocks(t):
    """A table per order. Lines are shuffled once, by order; all blocks of a line, and the table at its order's first, come of one row."""
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    lines = t.lineitem.select(*cols, "l_returnflag", "l_linestatus")
    lines = lines.repartition(tasks_for(lines, TASK_BYTES), "l_orderkey").groupBy(*cols).agg(
        F.max("l_returnflag").alias("l_returnflag"), F.max("l_linestatus").alias("l_linestatus"))
    head = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*cols[1:])) == 1
    base = lines.withColumn("uid", F.concat_ws("_", *cols[1:])).withColumn("head", head)
    pos = F.col("l_partkey") * 100000 + F.col("l_suppkey")
    table = _block(id=F.lit("t"), pos=F.lit(0), block_type=F.lit("TABLE"))
    first = _block(id=F.concat(F.lit("a"), F.col("uid")), pos=pos, block_type=F.lit("CELL"), text=F.col("l_returnflag"),
                   row_index=F.col("l_linenumber"), column_index=F.lit(1), relationships=_link("CHILD", F.array(F.lit("t"))))
    w1, w2 = F.concat(F.lit("w"), F.col("uid")), F.concat(F.lit("x"), F.col("uid"))
    third = _block(id=F.concat(F.lit("c"), F.col("uid")), pos=pos, block_type=F.lit("CELL"),
                   row_index=F.col("l_linenumber"), column_index=F.lit(3), relationships=_link("CHILD", F.array(F.lit("t"), w1, w2)))
    words = [_block(id=w1, pos=pos, block_type=F.lit("WORD"), text=F.col("l_linestatus")),
             _block(id=w2, pos=pos, block_type=F.lit("WORD"), text=F.lit("line"))]
    kept = F.col("l_returnflag") != "R"
    blocks = F.array(F.when(F.col("head"), table), first, *[F.when(kept, b) for b in (third, *words)])
    return base.select(F.col("l_orderkey").alias("doc_id"), F.explode(F.filter(blocks, lambda b: b.isNotNull())).alias("b")).select("doc_id", "b.*")


# The SQL leaves out the two rules that look ahead; both engines run the other twelve.
SAFE_RULES = [r for r in R.MARKUP_REMOVALS if "(?!" not in r]


def _removals(t):
    for rule in SAFE_RULES:
        t = f"regexp_replace({t}, '{rule.replace(chr(39), chr(39) * 2)}', '', 'g')"
    return t


@query("strip_markup_shared_rules", sql=f"SELECT page_id, {_removals('html')} AS clean FROM pages")
def _(t):
    return t.pages.select("page_id", X.strip_markup(F.col("html"), SAFE_RULES).alias("clean"))


# The SQL engine has no look-ahead: what a rule must spare gets a private character inside, which goes after the rule.
SPARED = {
    "data:(?!": ("(?i)(data)(:image/(?:png|jpg|jpeg|gif|svg\\+xml);base64,)", "(?i)data:"),
    "&#(?!": ("(&)(#39;)", "(?i)&#x?[0-9a-f]+;?"),
}


def _all_removals(t):
    for rule in R.MARKUP_REMOVALS:
        found = next((v for k, v in SPARED.items() if k in rule), None)
        if "<script" in rule:
            t = f"regexp_replace({t}, '(?is)<script\\b.*?</script>', '', 'g')"
        elif found:
            t = f"replace(regexp_replace(regexp_replace({t}, '{found[0]}', '\\1' || chr(57344) || '\\2', 'g'), '{found[1]}', '', 'g'), chr(57344), '')"
        else:
            t = f"regexp_replace({t}, '{rule.replace(chr(39), chr(39) * 2)}', '', 'g')"
    return t


# A page with something for every rule.
ODD_HTML = """html || CASE page_id % 3 WHEN 0 THEN ' <a href="data:text/html,x" onclick="go()"> &#39; &#65; &#x4a; eval (1)'
  WHEN 1 THEN ' data:image/png;base64,AA DATA:IMAGE/GIF;base64,B data:image/bmp;base64, javascript:x @import' ELSE ' &#39 &#391; <SCRIPT src=a>x<b</Script >y</script>z onload=a expression (' END"""


@query("strip_markup_rules", sql=f"SELECT page_id, {_all_removals('h')} AS clean FROM (SELECT page_id, {ODD_HTML} AS h FROM pages)")
def _(t):
    return t.pages.select("page_id", F.expr(ODD_HTML).alias("h")).select("page_id", X.strip_markup(F.col("h")).alias("clean"))
