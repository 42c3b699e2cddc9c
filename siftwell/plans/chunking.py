"""Chunking: C1 to C16.

The SQL folds over sentence texts, where the library folds over offsets.
"""

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import sentences
from ..operators import chunk as C, describe as D, extract as X
from . import shared, sqltext as S
from .registry import query

SENTS = f"s AS (SELECT doc_id, {S.sents('text')} AS sents FROM documents)"
ROWS = "SELECT doc_id, (i - 1)::INT AS chunk_index, content FROM (SELECT doc_id, unnest(done) AS content, generate_subscripts(done, 1) AS i FROM folded) WHERE content <> ''"


@query("split_sentences", sql=f"WITH {SENTS} SELECT doc_id, (i - 1)::INT AS sentence_index, sentence FROM (SELECT doc_id, unnest(sents) AS sentence, generate_subscripts(sents, 1) AS i FROM s)")
def _(t):
    return C.split_sentences(t.documents, "doc_id", "text")


LINE_COUNT = "(length(x) - length(replace(x, chr(10), '')) + 1)"
DIALOGUE = f"(len(regexp_extract_all(x, '\"[^\"]*\"'))::DOUBLE / greatest(len({S.words('x')}), 1))"
PROFILE_SQL = f"""SELECT doc_id, (CASE WHEN {DIALOGUE} > 0.1 THEN 800 WHEN (length(x) - {LINE_COUNT} + 1)::DOUBLE / {LINE_COUNT} > 100 THEN 1200
  WHEN (length(x) - length(replace(x, chr(10) || chr(10), ''))) // 2 > {LINE_COUNT} * 0.3 THEN 1100 ELSE 1000 END)::INT AS target,
  8000::INT AS "max", 100::INT AS "min", (CASE WHEN {DIALOGUE} > 0.1 THEN 240 ELSE 200 END)::INT AS overlap FROM src"""


@query("chunk_profile", sql=f"""
WITH src AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, ' ', '" "') WHEN doc_id % 3 = 1 THEN replace(text, ' ', chr(10) || chr(10)) ELSE text END AS x FROM documents)
{PROFILE_SQL}""")
def _(t):
    x = (F.when(F.col("doc_id") % 3 == 0, F.replace(F.col("text"), F.lit(" "), F.lit('" "')))
         .when(F.col("doc_id") % 3 == 1, F.replace(F.col("text"), F.lit(" "), F.lit("\n\n"))).otherwise(F.col("text")))
    return t.documents.select("doc_id", C.chunk_profile(x).alias("p")).select("doc_id", "p.*")


GREEDY_SQL = f"""{SENTS},
folded AS (SELECT doc_id, list_append(f.done, {S.strip('f.cur')}) AS done FROM (
  SELECT doc_id, list_reduce(list_transform(sents, lambda z: {{'cur': z, 'size': length(z), 'done': []::VARCHAR[]}}), lambda a, z:
    CASE WHEN a.size + z.size > 750 AND a.cur <> '' THEN {{'cur': right(a.cur, 100) || ' ' || z.cur, 'size': length(right(a.cur, 100)) + 1 + z.size, 'done': list_append(a.done, {S.strip('a.cur')})}}
         WHEN a.cur <> '' THEN {{'cur': a.cur || ' ' || z.cur, 'size': a.size + z.size, 'done': a.done}}
         ELSE {{'cur': z.cur, 'size': a.size + z.size, 'done': a.done}} END,
    {{'cur': '', 'size': 0::BIGINT, 'done': []::VARCHAR[]}}) AS f FROM s WHERE len(sents) > 0))"""


@query("chunk_greedy", sql=f"WITH {GREEDY_SQL} {ROWS}")
def _(t):
    return C.chunk_greedy(t.documents, "doc_id", "text")


def _kept(buf, lap):
    return f"list_filter({buf}, lambda z, i: list_sum(list_transform({buf}[i:], lambda y: length(y))) <= {lap})"


OVERLAP_SQL = f"""{SENTS.replace('sents FROM', 'sents, CASE WHEN length(text) > 500000 THEN 600 WHEN length(text) > 100000 THEN 700 ELSE 750 END AS lim, CASE WHEN length(text) > 500000 THEN 75 WHEN length(text) > 100000 THEN 90 ELSE 100 END AS lap FROM')},
folded AS (SELECT doc_id, list_append(f.done, {S.strip('f.cur')}) AS done FROM (
  SELECT doc_id, list_reduce(list_transform(sents, lambda z: {{'cur': z, 'size': length(z), 'buf': []::VARCHAR[], 'done': []::VARCHAR[]}}), lambda a, z:
    CASE WHEN a.size + z.size > lim AND a.cur <> '' THEN {{
           'cur': array_to_string(list_append({_kept('a.buf', 'lap')}, z.cur), ' '),
           'size': length(array_to_string(list_append({_kept('a.buf', 'lap')}, z.cur), ' ')),
           'buf': list_append({_kept('a.buf', 'lap')}, z.cur), 'done': list_append(a.done, {S.strip('a.cur')})}}
         ELSE {{'cur': CASE WHEN a.cur <> '' THEN a.cur || ' ' || z.cur ELSE z.cur END, 'size': a.size + z.size, 'buf': list_append(a.buf, z.cur), 'done': a.done}} END,
    {{'cur': '', 'size': 0::BIGINT, 'buf': []::VARCHAR[], 'done': []::VARCHAR[]}}) AS f FROM s WHERE len(sents) > 0))"""


@query("chunk_sentence_overlap", sql=f"WITH {OVERLAP_SQL} {ROWS}")
def _(t):
    return C.chunk_sentence_overlap(t.documents, "doc_id", "text")


def _flags(cur, nxt):
    c, n = S.strip(cur), S.strip(nxt)
    low = f"lower({n})"
    return {
        "paragraph": f"(contains({c}, chr(10) || chr(10)) OR suffix({c}, chr(10)))",
        "transition": S.starts(low, R.TRANSITION_MARKERS),
        "quote_end": f"((suffix({c}, '\"') OR suffix({c}, '''')) AND NOT starts_with({n}, '\"'))",
        "time_marker": S.either(f"substr({low}, 1, 50)", R.TIME_MARKERS),
        "speaker": f"(regexp_matches({n}, '{R.SPEAKER_START}') OR regexp_matches({n}, '{R.SPEAKER_QUOTE}'))",
    }


FLAGS = _flags("cur", "nxt")


@query("semantic_breakpoints", sql=f"""
WITH {SENTS}, u AS (SELECT doc_id, unnest(sents) AS nxt, generate_subscripts(sents, 1) - 1 AS sentence_index FROM s),
p AS (SELECT *, lag(nxt) OVER (PARTITION BY doc_id ORDER BY sentence_index) AS cur FROM u),
f AS (SELECT doc_id, sentence_index::INT AS sentence_index, {', '.join(f'{v} AS {k}' for k, v in FLAGS.items())} FROM p WHERE cur IS NOT NULL)
SELECT * FROM f WHERE {' OR '.join(FLAGS)}""")
def _(t):
    return C.semantic_breakpoints(t.documents, "doc_id", "text")


def _good(cur, nxt):
    c, n = S.strip(cur), S.strip(nxt)
    opens = rf"({n} = '' OR regexp_matches({n}, '^\p{{Lu}}'))"
    return f"((suffix({c}, '.') AND {opens}) OR {S.either(f'lower({c})', R.CONCLUSION_WORDS)} OR {S.starts(f'lower({n})', R.TOPIC_STARTS)})"


@query("good_breakpoint", sql=f"""
WITH {SENTS}, u AS (SELECT doc_id, unnest(sents) AS cur, generate_subscripts(sents, 1) AS i FROM s),
p AS (SELECT *, lead(cur) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM u)
SELECT doc_id, count(*) AS pairs, count(CASE WHEN {_good('cur', 'nxt')} THEN 1 END) AS good FROM p WHERE nxt IS NOT NULL GROUP BY doc_id""")
def _(t):
    n = F.greatest(F.size("s") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("s", 1, n), F.slice("s", 2, n), lambda a, b: C.good_breakpoint(a, b))
    rows = t.documents.select("doc_id", sentences(F.col("text")).alias("s")).select("doc_id", pairs.alias("p")).filter(F.size("p") > 0)
    return rows.select("doc_id", F.size("p").cast("bigint").alias("pairs"), F.size(F.filter("p", lambda x: x)).cast("bigint").alias("good"))


LAST = 'list_slice(sents, len(sents), len(sents))'


@query("semantic_overlap", sql=f"""
WITH {SENTS} SELECT doc_id, array_to_string(CASE WHEN len({_kept('sents', 200)}) > 0 THEN {_kept('sents', 200)} ELSE {LAST} END, ' ') AS overlap FROM s""")
def _(t):
    rows = t.documents.select("doc_id", sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.array_join(C.semantic_overlap(F.col("s"), F.lit(200)), " ").alias("overlap"))


CONNECT = R.REFERENCE_STARTS + R.CONTINUATION_STARTS


@query("contextual_overlap", sql=f"""
WITH {SENTS.replace('s AS', 'w AS')}, s AS (SELECT doc_id, sents[1:(len(sents) + 1) // 2] AS sents, coalesce(sents[(len(sents) + 1) // 2 + 1], '') AS following FROM w)
SELECT doc_id, array_to_string(CASE WHEN {S.starts('lower(following)', CONNECT)} OR len({_kept('sents', 200)}) = 0 THEN {LAST} ELSE {_kept('sents', 200)} END, ' ') AS overlap FROM s""")
def _(t):
    """The first half of each document as a chunk, the sentence after it as what follows."""
    rows = t.documents.select("doc_id", sentences(F.col("text")).alias("w")).withColumn("half", F.expr("(size(w) + 1) div 2").cast("int"))
    rows = rows.select("doc_id", F.slice("w", F.lit(1), F.col("half")).alias("s"), F.coalesce(F.get("w", F.col("half")), F.lit("")).alias("following"))
    return rows.select("doc_id", F.array_join(C.contextual_overlap(F.col("s"), F.lit(200), F.col("following")), " ").alias("overlap"))


def _semantic_sql(source, target, most, least, lap, contextual=False, close=True):
    """Fold over sentence texts; ``source`` has id columns and sents."""
    brk = "(" + " OR ".join(_flags("p", "z").values()) + ")"
    last = "a.buf[len(a.buf):len(a.buf)]"
    fit = _kept("a.buf", lap)
    kept = f"(CASE WHEN len({fit}) > 0 THEN {fit} ELSE {last} END)"
    if contextual:
        kept = f"(CASE WHEN z.conn THEN {last} ELSE {kept} END)"
    items = (
        f"list_transform(sents, lambda z, i: {{'cur': z, 'brk': i > 1 AND {_inline(brk, 'sents[i - 1]')}, 'good': "
        + (f"i < len(sents) AND {_good('z', 'sents[i + 1]')}" if close else "false")
        + f", 'conn': {S.starts('lower(z)', CONNECT) if contextual else 'false'}, 'buf': []::VARCHAR[], 'done': []::VARCHAR[]}})"
    )
    state = lambda cur, buf, done: f"{{'cur': {cur}, 'brk': false, 'good': false, 'conn': false, 'buf': {buf}, 'done': {done}}}"
    must = f"(a.cur <> '' AND ((z.brk AND length(a.cur) >= {least}) OR length(a.cur) + length(z.cur) > {most}))"
    after = f"(CASE WHEN {must} THEN list_append({kept}, z.cur) ELSE list_append(a.buf, z.cur) END)"
    text = f"array_to_string({after}, ' ')"
    done = f"(CASE WHEN {must} THEN list_append(a.done, {S.strip('a.cur')}) ELSE a.done END)"
    step = (
        f"CASE WHEN z.good AND length({text}) >= {target} THEN {state(repr(''), '[]::VARCHAR[]', f'list_append({done}, {S.strip(text)})')} "
        f"ELSE {state(text, after, done)} END"
    )
    zero = state("''", "[]::VARCHAR[]", "[]::VARCHAR[]")
    tail = S.strip("f.cur")
    finish = (
        f"CASE WHEN {tail} = '' THEN f.done WHEN length(f.cur) >= {least} OR len(f.done) = 0 THEN list_append(f.done, {tail}) "
        f"ELSE list_append(f.done[:len(f.done) - 1], f.done[len(f.done)] || ' ' || {tail}) END"
    )
    return f"(SELECT * EXCLUDE (f, sents), {finish} AS done FROM (SELECT *, list_reduce({items}, lambda a, z: {step}, {zero}) AS f FROM {source} WHERE len(sents) > 0))"


def _inline(expr, previous):
    """The break flags with the previous sentence put in place of its name."""
    return expr.replace("regexp_replace(p,", f"regexp_replace({previous},")


SMALL = {"target": 400, "max": 600, "min": 60, "overlap": 80}


def _cfg(**over):
    values = {**SMALL, **over}
    return F.struct(*[F.lit(values[k]).alias(k) for k in ("target", "max", "min", "overlap")])


@query("chunk_semantic", sql=f"""
WITH {SENTS}, folded AS {_semantic_sql('s', 400, 600, 60, 80)}
SELECT doc_id, (i - 1)::INT AS chunk_index, content, CASE WHEN i = 1 AND length(first_line) < 100 THEN first_line END AS heading FROM (
  SELECT doc_id, unnest(done) AS content, generate_subscripts(done, 1) AS i, list_filter(string_split(done[1], chr(10)), lambda x: {S.strip('x')} <> '')[1] AS first_line FROM folded)""")
def _(t):
    return C.chunk_semantic(t.documents, "doc_id", "text", _cfg()).drop("total_chunks")


MD_HEADS = rf"""p AS (SELECT doc_id, {shared.MD_SQL} AS md FROM documents),
q AS (SELECT doc_id, md, string_split_regex(regexp_replace(md, '(?m)^(#{{1,6}})\s+([^\n]+)', chr(1) || '\0' || chr(2), 'g'), '[\x01\x02]') AS pieces FROM p),
u AS (SELECT doc_id, md, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM q),
o AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM u),
heads AS (SELECT doc_id, md, start, length(regexp_extract(piece, '^(#+)\s', 1))::INT AS level, {S.strip(r"regexp_extract(piece, '^#{1,6}\s+([^\n]+)', 1)")} AS heading FROM o WHERE i % 2 = 0),
sliced AS (SELECT doc_id, (row_number() OVER w - 1)::INT AS section_index, level, heading,
   {S.strip("substr(md, start + 1, coalesce(lead(start) OVER w, length(md)) - start)")} AS section FROM heads WINDOW w AS (PARTITION BY doc_id ORDER BY start)),
sections AS (SELECT * FROM sliced WHERE section <> '')"""


def _md(t):
    return shared.markdown(t).withColumn("structure", X.md_section_array(F.col("md")))


@query("sections", sql=f"WITH {MD_HEADS} SELECT * FROM sections")
def _(t):
    return C.sections(_md(t), "doc_id", "md", "structure")


@query("sections_by_offset", sql=f"WITH {MD_HEADS} SELECT * FROM sections")
def _(t):
    md = shared.markdown(t).withColumn("structure", X.md_heading_array(F.col("md")))
    return C.sections(md, "doc_id", "md", "structure")


IMPORTANCE = f"""least(2.0::DOUBLE, 1.0::DOUBLE + (7 - least(level, 6)) * 0.15::DOUBLE + CASE WHEN {S.either('lower(heading)', R.SECTION_KEYWORDS)} THEN 0.3::DOUBLE ELSE 0 END
  + CASE WHEN len({S.words('section')}) > 0 AND len(regexp_extract_all(section, '[.!?]+'))::DOUBLE / len({S.words('section')}) * 100 BETWEEN 3 AND 8 THEN 0.2::DOUBLE ELSE 0 END)"""


@query("section_importance", sql=f"WITH {MD_HEADS} SELECT doc_id, section_index, round({IMPORTANCE}, 6) AS importance FROM sections")
def _(t):
    rows = C.sections(_md(t), "doc_id", "md", "structure")
    value = C.section_importance(F.col("level"), F.col("heading"), F.col("section"))
    return rows.select("doc_id", "section_index", F.round(value, 6).alias("importance"))


@query("section_config", sql=f"""
WITH {MD_HEADS}, w AS (SELECT *, {IMPORTANCE} AS imp FROM sections)
SELECT doc_id, section_index, (CASE WHEN imp > 1.5 THEN 1300 WHEN length(section) > 900 THEN 900 ELSE 1000 END)::INT AS target,
  (CASE WHEN imp > 1.5 THEN 360 ELSE 300 END)::INT AS "max", 100::INT AS "min", (CASE WHEN imp > 1.5 THEN 300 ELSE 200 END)::INT AS overlap FROM w""")
def _(t):
    rows = C.sections(_md(t), "doc_id", "md", "structure")
    imp = C.section_importance(F.col("level"), F.col("heading"), F.col("section"))
    cfg = C.section_config(_cfg(target=1000, max=300, min=100, overlap=200), imp, F.length("section"))
    return rows.select("doc_id", "section_index", cfg.alias("c")).select("doc_id", "section_index", "c.*")


STRUCT_SQL = f"""{MD_HEADS}, w AS (SELECT *, {IMPORTANCE} AS imp FROM sections),
cfgd AS (SELECT *, CASE WHEN imp > 1.5 THEN 360 ELSE 300 END AS most, CASE WHEN imp > 1.5 THEN 120 ELSE 80 END AS lap FROM w),
long AS (SELECT * EXCLUDE (section), {S.sents('section')} AS sents FROM cfgd WHERE length(section) > most),
folded AS {_semantic_sql('long', 0, 'most', 60, 'lap', contextual=True, close=False)},
structured AS (
  SELECT doc_id, section_index, level, heading, round(imp, 6) AS importance, 0::INT AS chunk_index, 1::INT AS total_chunks, section AS content, 'section' AS chunk_type FROM cfgd WHERE length(section) <= most
  UNION ALL SELECT doc_id, section_index, level, heading, round(greatest(imp * (1.0::DOUBLE - (i - 1) * 0.1::DOUBLE), 0.5::DOUBLE), 6), (i - 1)::INT, n::INT, content, 'section_chunk'
  FROM (SELECT *, unnest(done) AS content, generate_subscripts(done, 1) AS i, len(done) AS n FROM folded))"""


@query("chunk_structured", sql=f"WITH {STRUCT_SQL} SELECT * FROM structured")
def _(t):
    rows = C.chunk_structured(_md(t), "doc_id", "md", "structure", _cfg(max=300))
    return rows.withColumn("importance", F.round("importance", 6))


@query("chunk_chars")
def _(t):
    return C.chunk_chars(t.documents, "doc_id", "text", _cfg())


@query("route_chunker", sql=f"""
WITH src AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {shared.MD_SQL} ELSE text END AS x FROM documents),
prof AS ({PROFILE_SQL}), plain AS (SELECT doc_id, target, overlap, {S.sents('x')} AS sents FROM src JOIN prof USING (doc_id) WHERE doc_id % 2 = 1),
folded AS {_semantic_sql('plain', 'target', 8000, 100, 'overlap')},
{MD_HEADS}, w AS (SELECT *, {IMPORTANCE} AS imp FROM sections WHERE doc_id % 2 = 0),
routed AS (SELECT doc_id, section_index, 0 AS chunk_index, 'section' AS chunk_type, round(imp, 6) AS importance, section AS content FROM w
  UNION ALL SELECT doc_id, 0, i - 1, 'text_chunk', 1.0, content FROM (SELECT *, unnest(done) AS content, generate_subscripts(done, 1) AS i FROM folded))
SELECT doc_id, section_index::INT AS section_index, chunk_index::INT AS chunk_index, chunk_type, importance::DOUBLE AS importance, content FROM routed
WHERE chunk_type <> 'section' OR length(content) <= 8000""")
def _(t):
    md = _md(t)
    docs = md.join(t.documents.select("doc_id", "text"), "doc_id").select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("md")).otherwise(F.col("text")).alias("x"),
        F.when(F.col("doc_id") % 2 == 0, F.col("structure")).alias("structure"))
    return C.route_chunker(docs, "doc_id", "x", "structure").withColumn("importance", F.round("importance", 6)).drop("heading")


@query("chunk_neighbours", sql=f"""
WITH {GREEDY_SQL}, c AS ({ROWS}),
d AS (SELECT *, {S.heading('content')} AS heading, {S.kind('content')} AS chunk_type FROM c),
e AS (SELECT *, substr({S.summary('content', 'heading', 'chunk_type')}, 1, 50) AS brief FROM d)
SELECT doc_id, chunk_index, lag(chunk_type || '/' || heading || '/' || brief) OVER w AS prev, lead(chunk_type || '/' || heading || '/' || brief) OVER w AS next,
  (row_number() OVER w)::INT AS chunk_position, count(*) OVER (PARTITION BY doc_id) AS total_chunks,
  round((row_number() OVER w)::DOUBLE / count(*) OVER (PARTITION BY doc_id), 6) AS relative_position FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)""")
def _(t):
    chunks = D.describe(C.chunk_greedy(t.documents, "doc_id", "text"))
    rows = C.chunk_neighbours(chunks, "doc_id")
    brief = lambda c: F.concat(F.col(f"{c}.chunk_type"), F.lit("/"), F.col(f"{c}.heading"), F.lit("/"), F.col(f"{c}.summary"))
    return rows.select("doc_id", "chunk_index", brief("prev_context").alias("prev"), brief("next_context").alias("next"), "chunk_position",
                       "total_chunks", F.round("relative_position", 6).alias("relative_position"))
