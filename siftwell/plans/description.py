"""Chunk description: M1 to M13, on whole documents."""

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import estimate_tokens
from ..functions.vectors import valid_embedding
from ..operators import describe as D
from . import sqltext as S
from .registry import query


@query("chunk_heading", sql=f"SELECT doc_id, {S.heading('text')} AS heading FROM documents")
def _(t):
    return t.documents.select("doc_id", D.chunk_heading(F.col("text")).alias("heading"))


@query("chunk_type", sql=f"SELECT doc_id, {S.kind('text')} AS chunk_type FROM documents")
def _(t):
    return t.documents.select("doc_id", D.chunk_type(F.col("text")).alias("chunk_type"))


def _word_kind(t):
    return (
        f"CASE WHEN {S.count_of(t, chr(34))} >= 2 THEN 'dialogue' WHEN {S.has_word(t, R.OPENING_MARKERS)} THEN 'narrative_opening' "
        f"WHEN {S.has_word(t, R.ACTION_MARKERS)} THEN 'action' WHEN {S.has_word(t, R.DESCRIPTION_MARKERS)} THEN 'description' "
        f"WHEN contains({t}, '?') OR {S.has_word(t, R.QUESTION_MARKERS)} THEN 'question' ELSE 'paragraph' END")


@query("chunk_type_whole_word", sql=f"SELECT doc_id, {_word_kind('text')} AS chunk_type FROM documents")
def _(t):
    return t.documents.select("doc_id", D.chunk_type(F.col("text"), whole_word=True).alias("chunk_type"))


@query("key_entities", sql=f"SELECT doc_id, array_to_string({S.entities('text')}, '|') AS entities FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(D.key_entities(F.col("text")), "|").alias("entities"))


@query("topics", sql=f"SELECT doc_id, array_to_string({S.topics('text')}, '|') AS topics FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(D.topics(F.col("text")), "|").alias("topics"))


@query("importance_local", sql=f"""
WITH d AS (SELECT doc_id, text, {S.kind('text')} AS kind, {S.entities('text')} AS entities FROM documents)
SELECT doc_id, round({S.importance('text', 'kind', 'entities')}, 6) AS importance FROM d""")
def _(t):
    x = F.col("text")
    return t.documents.select("doc_id", F.round(D.importance_local(x, D.chunk_type(x), D.key_entities(x)), 6).alias("importance"))


@query("importance_chunk", sql=f"""
WITH d AS (SELECT doc_id, text, len({S.sents('text')}) AS n, doc_id % 8 AS level, doc_id % 3 AS idx FROM documents)
SELECT doc_id, round(least(2.0::DOUBLE, 1.0::DOUBLE + CASE WHEN level <> 0 THEN (7 - least(level, 6)) * 0.1::DOUBLE ELSE 0 END + CASE WHEN idx = 0 THEN 0.2::DOUBLE ELSE 0 END
  + {' + '.join(f"CASE WHEN contains(lower(text), '{k}') THEN 0.1::DOUBLE ELSE 0 END" for k in R.CHUNK_KEYWORDS)}
  + CASE WHEN length(text)::DOUBLE / greatest(n, 1) BETWEEN 10 AND 30 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN n BETWEEN 3 AND 10 THEN 0.1::DOUBLE ELSE 0 END), 6) AS importance FROM d""")
def _(t):
    value = D.importance_chunk(F.col("doc_id") % 8, F.col("text"), F.col("doc_id") % 3)
    return t.documents.select("doc_id", F.round(value, 6).alias("importance"))


@query("context_summary", sql=f"""
WITH d AS (SELECT doc_id, text, {S.kind('text')} AS kind, {S.heading('text')} AS heading FROM documents)
SELECT doc_id, {S.summary('text', 'heading', 'kind')} AS summary FROM d""")
def _(t):
    x = F.col("text")
    rows = t.documents.select("doc_id", "text", D.chunk_heading(x).alias("heading"), D.chunk_type(x).alias("kind"))
    return rows.select("doc_id", D.context_summary(x, F.col("heading"), F.col("kind")).alias("summary"))


TOP3 = f"""u AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents)),
c AS (SELECT doc_id, term, count(*) AS uses, min(pos) AS first_pos FROM u WHERE length(term) > 3 AND term NOT IN ({S.text_list(R.KEYWORD_STOP_WORDS)}) GROUP BY ALL),
top3 AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY uses DESC, first_pos))::INT AS rank, term, uses FROM c)"""


@query("keyword_top3", sql=f"WITH {TOP3} SELECT * FROM top3 WHERE rank <= 3")
def _(t):
    return D.keyword_top(t.documents, "doc_id", "text")


@query("follow_up_questions", sql=f"""
WITH {TOP3}, a AS (SELECT doc_id, list('Tell me more about ' || term ORDER BY rank) AS own FROM top3 WHERE rank <= 3 GROUP BY doc_id)
SELECT doc_id, array_to_string(list_concat(coalesce(own, []::VARCHAR[]), [{S.text_list(R.FOLLOW_UPS)}])[1:3], ' / ') AS questions FROM documents LEFT JOIN a USING (doc_id)""")
def _(t):
    rows = D.follow_up_questions(t.documents, "doc_id", "text")
    return rows.select("doc_id", F.array_join("questions", " / ").alias("questions"))


@query("estimate_tokens", sql="SELECT doc_id, (length(text) // 4)::BIGINT AS tokens FROM documents")
def _(t):
    return t.documents.select("doc_id", estimate_tokens(F.col("text")).alias("tokens"))


EMBED_TEXT = f"""d AS (SELECT doc_id, text, {S.sents('text')} AS s, substr(text, 1, 3000) AS cut FROM documents),
e AS (SELECT *, len(s) // 3 AS third, regexp_extract(cut, '(?s)^(.*[.!?])', 1) AS upto FROM d),
f AS (SELECT *, array_to_string(list_concat(s[1:third], s[len(s) - third + 1:]), ' ') AS ends, CASE WHEN length(upto) - 1 > 2400 THEN upto ELSE cut END AS trimmed FROM e),
et AS (SELECT doc_id, CASE WHEN length(text) <= 3000 THEN text WHEN len(s) > 4 AND length(ends) <= 3000 THEN ends ELSE trimmed END AS text FROM f)"""


@query("embedding_text", sql=f"WITH {EMBED_TEXT} SELECT * FROM et")
def _(t):
    return t.documents.select("doc_id", D.embedding_text(F.col("text")).alias("text"))


HASH = "list_transform(range(64), lambda i: ((('0x' || substr(md5(text), (CASE WHEN i % 16 = 15 THEN 0 ELSE i % 16 END) * 2 + 1, 2))::INT) / 255.0::DOUBLE - 0.5::DOUBLE) * 0.2::DOUBLE)"


def _vector_stats(c):
    return [
        F.size(c).alias("dim"), F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
        F.round(F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 6).alias("checksum"),
    ]


STATS = "len(v)::INT AS dim, round(list_sum(v), 6) AS total, round(list_sum(list_transform(v, lambda x, i: x * i)), 6) AS checksum"


@query("hash_embedding", sql=f"WITH h AS (SELECT doc_id, {HASH} AS v FROM documents) SELECT doc_id, {STATS} FROM h")
def _(t):
    rows = t.documents.select("doc_id", D.hash_embedding(F.col("text"), 64).alias("v"))
    return rows.select("doc_id", *_vector_stats("v"))


@query("embed_pluggable", sql=f"""
WITH {EMBED_TEXT} SELECT doc_id, 2::INT AS dim, round(length(text) + 1.5 * (CASE WHEN contains(text, 'e') THEN 1 ELSE 0 END), 6)::DOUBLE AS total FROM et""")
def _(t):
    import pandas as pd

    @F.pandas_udf("array<double>")
    def tiny(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: [float(len(s)), 1.5 * ("e" in s)])

    rows = D.embed(t.documents, "text", tiny)
    return rows.select("doc_id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("valid_embedding", sql="""
SELECT vec_id, CASE vec_id % 6 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN false ELSE true END AS valid FROM embeddings""")
def _(t):
    e, m = F.col("embedding"), F.col("vec_id") % 6
    spoiled = (
        F.when(m == 0, F.transform(e, lambda x: x * 0)).when(m == 1, F.transform(e, lambda x: F.lit(float("inf")).cast("float")))
        .when(m == 2, F.slice(e, 1, 10)).when(m == 3, F.concat(F.slice(e, 1, 63), F.array(F.lit(float("nan")).cast("float")))).otherwise(e))
    return t.embeddings.select("vec_id", valid_embedding(spoiled, 64).alias("valid"))
