"""Keyword and hybrid scores: K1 to K6."""

from pyspark.sql import Window as W, functions as F

from ..functions import rules as R
from ..functions.text import tokens
from ..operators import keyword as K, vector as V
from ..session import scratch_path
from ..sources.postings import PostingStore
from . import shared, sqltext as S
from .registry import query


@query("tokens", sql=f"""
SELECT doc_id, unnest({S.toks('text')}) AS token, generate_subscripts({S.toks('text')}, 1)::INT - 1 AS pos FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))


SEARCH_TEXT = "concat_ws(' ', nullif(content, ''), nullif(heading, ''), nullif(doc_id::VARCHAR, ''))"


@query("search_text", sql=f"WITH {shared.VECTORS} SELECT key, {SEARCH_TEXT} AS text FROM vectors")
def _(t):
    return shared.described_vectors(t).select("key", K.search_text(F.col("content"), F.col("heading"), F.col("doc_id")).alias("text"))


@query("term_stats", sql=f"""
SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({S.toks('text')})) AS term FROM documents) GROUP BY term""")
def _(t):
    return K.term_stats(t.documents, "doc_id", "text")


@query("corpus_stats", sql=f"""
SELECT count(*) AS total_docs, sum(len({S.toks('text')}))::BIGINT AS total_tokens, round(avg(len({S.toks('text')})), 6) AS avg_length FROM documents""")
def _(t):
    return K.corpus_stats(t.documents, "text").withColumn("avg_length", F.round("avg_length", 6))


@query("postings", sql=f"""
SELECT key, term, count(*) AS tf FROM (SELECT doc_id AS key, unnest({S.toks('text')}) AS term FROM documents) GROUP BY ALL""")
def _(t):
    return K.postings(t.documents.withColumnRenamed("doc_id", "key"), "key", "text")


NEAR = f"""WITH {shared.VECTORS}, {shared.QUERY_SET}, {shared.PAIRS},
near AS (SELECT query_id, key, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, key) AS rank FROM pairs QUALIFY rank <= 20),
cand AS (SELECT n.*, v.content, v.heading, v.doc_id, {SEARCH_TEXT} AS text FROM near n JOIN vectors v USING (key))"""


def bm25_sql(running: bool, source: str = "cand") -> str:
    """Chain of CTEs from ``source`` (query_id, key, rank, text) to ``scored`` (query_id, key, bm25)."""
    frame = "PARTITION BY query_id" + (" ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW" if running else "")
    term = "PARTITION BY query_id, term" + (" ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW" if running else "")
    return f"""sized AS (SELECT query_id, key, rank, {S.toks('text')} AS tk FROM {source}),
st AS (SELECT *, len(tk) AS n_tokens, count(*) OVER ({frame}) AS n_docs, avg(len(tk)) OVER ({frame}) AS avg_tokens FROM sized),
qt AS (SELECT query_id, term, count(*) AS uses FROM (SELECT query_id, unnest({S.toks('query_text')}) AS term FROM questions) GROUP BY ALL),
tf AS (SELECT query_id, key, rank, n_tokens, n_docs, avg_tokens, term, count(*) AS tf FROM (SELECT * EXCLUDE (tk), unnest(tk) AS term FROM st) GROUP BY ALL),
hit AS (SELECT tf.*, uses FROM tf JOIN qt USING (query_id, term)),
dfs AS (SELECT *, count(*) OVER ({term}) AS df FROM hit),
part AS (SELECT query_id, key, sum(uses * ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (n_tokens / avg_tokens)))) AS raw FROM dfs GROUP BY ALL),
scored AS (SELECT c.query_id, c.key, greatest(0, coalesce(raw, 0))::DOUBLE AS bm25 FROM {source} c LEFT JOIN part USING (query_id, key))"""


def _candidates(t, k=20):
    near = V.knn_topk(shared.vectors(t), shared.query_set(t), k)
    hits = V.attach_metadata(near, shared.vectors(t))
    return hits.withColumn("text", K.search_text(F.col("content"), F.col("heading"), F.col("doc_id")))


@query("bm25", sql=f"{NEAR}, {bm25_sql(False)} SELECT query_id, key, round(bm25, 6) AS bm25 FROM scored")
def _(t):
    return K.bm25(_candidates(t), shared.query_set(t)).withColumn("bm25", F.round("bm25", 6))


@query("bm25_running", sql=f"{NEAR}, {bm25_sql(True)} SELECT query_id, key, round(bm25, 6) AS bm25 FROM scored")
def _(t):
    return K.bm25(_candidates(t), shared.query_set(t), running=True).withColumn("bm25", F.round("bm25", 6))


HYBRID = "round(similarity * 0.7::DOUBLE + least(1.0::DOUBLE, bm25 / 10) * 0.3::DOUBLE, 9)"


@query("hybrid_score", sql=f"""
{NEAR}, {bm25_sql(False)}, h AS (SELECT query_id, key, similarity, bm25, {HYBRID} AS hybrid FROM cand JOIN scored USING (query_id, key))
SELECT query_id, key, round(least(1.0::DOUBLE, bm25 / 10), 6) AS keyword_score, round(hybrid, 6) AS hybrid_score,
  (row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, key))::INT AS hybrid_rank FROM h QUALIFY hybrid_rank <= 5""")
def _(t):
    rows = K.hybrid_search(_candidates(t), shared.query_set(t), 5)
    return rows.select("query_id", "key", F.round("keyword_score", 6).alias("keyword_score"), F.round("hybrid_score", 6).alias("hybrid_score"), "hybrid_rank")


@query("empty_query_passthrough", sql=f"""
{NEAR.replace(f'text || {shared.PHRASE_CASE} AS query_text', f"CASE WHEN item_id % 2 = 0 THEN '?!' ELSE text || {shared.PHRASE_CASE} END AS query_text")}, {bm25_sql(False)},
h AS (SELECT query_id, key, rank, CASE WHEN query_id % 2 = 1 THEN {HYBRID} END AS hybrid FROM cand JOIN scored USING (query_id, key))
SELECT query_id, key, round(hybrid, 6) AS hybrid_score, (row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC NULLS LAST, CASE WHEN hybrid IS NULL THEN rank END, key))::INT AS hybrid_rank
FROM h QUALIFY hybrid_rank <= 5""")
def _(t):
    q = shared.query_set(t).withColumn("query_text", F.when(F.col("query_id") % 2 == 0, "?!").otherwise(F.col("query_text")))
    rows = K.hybrid_search(_candidates(t), q, 5)
    return rows.select("query_id", "key", F.round("hybrid_score", 6).alias("hybrid_score"), "hybrid_rank")


INDEXED = f"""kept AS (SELECT doc_id::VARCHAR AS key, CASE WHEN doc_id % 10 = 5 THEN 'again river ' || text ELSE text END AS text FROM documents WHERE doc_id % 10 <> 3),
sized AS (SELECT key, {S.toks('text')} AS tk FROM kept),
whole AS (SELECT count(*) AS n_docs, avg(len(tk)) AS avg_tokens FROM sized),
qt AS (SELECT query_id, term, count(*) AS uses FROM (SELECT item_id AS query_id, unnest({S.toks('text')}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT key, n_tokens, term, count(*) AS tf FROM (SELECT key, len(tk) AS n_tokens, unnest(tk) AS term FROM sized) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
part AS (SELECT query_id, key, sum(uses * ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (n_tokens / avg_tokens)))) AS raw
  FROM tf JOIN qt USING (term) JOIN dfs USING (term), whole GROUP BY ALL)"""


def _index(t):
    """Built from nine tenths; the rest added, a tenth removed, a tenth replaced."""
    docs = t.documents.select("doc_id", "text")
    store = PostingStore(t.spark, scratch_path(t.spark, "postings"))
    store.add(docs.filter("doc_id % 10 < 9"), "doc_id", "text")
    store.add(docs.filter("doc_id % 10 = 9"), "doc_id", "text")
    store.remove(docs.filter("doc_id % 10 = 3"), "doc_id")
    store.add(docs.filter("doc_id % 10 = 5").withColumn("text", F.concat(F.lit("again river "), "text")), "doc_id", "text")
    return store


@query("bm25_index", sql=f"""
WITH {INDEXED}, r AS (SELECT query_id, key, raw, (row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, key))::INT AS rank FROM part WHERE raw > 0)
SELECT query_id, key, round(raw, 6) AS bm25, rank FROM r WHERE rank <= 10""")
def _(t):
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return _index(t).bm25(asked, 10).withColumn("bm25", F.round("bm25", 6))


@query("posting_stats", sql=f"WITH {INDEXED.split('qt AS')[0].rstrip().rstrip(',')} SELECT count(*) AS total_docs, sum(len(tk))::BIGINT AS total_tokens, round(avg(len(tk)), 6) AS avg_length FROM sized")
def _(t):
    """Statistics after the changes and a compaction."""
    store = _index(t)
    store.compact()
    return store.stats().withColumn("avg_length", F.round("avg_length", 6))
