"""Query analysis and staged retrieval: R1 to R9."""

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import retrieve as Q, vector as V
from . import keywords, search, shared, sqltext as S
from .registry import query

# --- analysis over every conversation turn, with a phrase by turn to reach each rule ---

ASK = "text || CASE (conv_id + turn) % 7 WHEN 0 THEN ' What is this?' WHEN 1 THEN ' compare it' WHEN 2 THEN ' last year' WHEN 3 THEN ' how, and versus what date?' WHEN 4 THEN ' ?' ELSE '' END"


def analysis_sql(source: str) -> str:
    flag = lambda words: S.has_word("query_text", words)
    return f"""an AS (SELECT *, len({S.words('query_text')})::INT AS word_count, contains(query_text, '?') AS has_questions, {flag(R.SPECIFIC_WORDS)} AS has_specifics,
  {flag(R.COMPARE_WORDS)} AS has_comparisons, {flag(R.TEMPORAL_WORDS)} AS has_temporal, {S.has_proper('query_text')} AS has_entities FROM {source}),
analysed AS (SELECT *, CASE WHEN has_specifics THEN 'specific' WHEN has_comparisons THEN 'comparative' WHEN has_temporal THEN 'temporal' ELSE 'general' END AS query_type,
  least(1.0::DOUBLE, (word_count / 20.0::DOUBLE) * 0.3::DOUBLE + has_questions::INT * 0.2::DOUBLE + has_specifics::INT * 0.2::DOUBLE + has_comparisons::INT * 0.15::DOUBLE
    + has_temporal::INT * 0.1::DOUBLE + has_entities::INT * 0.05::DOUBLE) AS complexity FROM an),
ca AS (SELECT *, CASE WHEN complexity > 0.7::DOUBLE THEN 'complex' WHEN complexity > 0.4::DOUBLE THEN 'medium' ELSE 'simple' END AS category FROM analysed),
cb AS (SELECT *, CASE WHEN category = 'complex' THEN 0.25::DOUBLE ELSE 0.4::DOUBLE END AS t0, CASE category WHEN 'complex' THEN 12 WHEN 'medium' THEN 9 ELSE 6 END AS l0,
  CASE WHEN category = 'complex' THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END AS f0 FROM ca),
cc AS (SELECT *, CASE WHEN query_type = 'comparative' THEN least(t0, 0.3::DOUBLE) WHEN query_type = 'specific' AND has_entities THEN greatest(t0, 0.4::DOUBLE) ELSE t0 END AS stage1_threshold,
  (CASE WHEN query_type = 'comparative' THEN greatest(l0, 9) ELSE l0 END)::INT AS stage1_limit, CASE WHEN query_type = 'specific' THEN greatest(f0, 0.5::DOUBLE) ELSE f0 END AS base_final FROM cb),
planned AS (SELECT *, greatest(0.15::DOUBLE, round(stage1_threshold - 0.1::DOUBLE, 9)) AS fallback_threshold FROM cc)"""


TURNS = f"turns AS (SELECT conv_id, turn, {ASK} AS query_text FROM conversations)"


def _turns(t):
    return t.conversations.select("conv_id", "turn", F.expr(ASK).alias("query_text"))


FLAGS = "word_count, has_questions, has_specifics, has_comparisons, has_temporal, has_entities, query_type"


@query("analyze_query", sql=f"WITH {TURNS}, {analysis_sql('turns')} SELECT conv_id, turn, {FLAGS}, round(complexity, 6) AS complexity FROM analysed")
def _(t):
    return Q.analyze_query(_turns(t)).drop("query_text").withColumn("complexity", F.round("complexity", 6))


@query("stage1_plan", sql=f"""
WITH {TURNS}, {analysis_sql('turns')}
SELECT conv_id, turn, category, stage1_limit, round(stage1_threshold, 6) AS stage1_threshold, round(fallback_threshold, 6) AS fallback_threshold, round(base_final, 6) AS base_final FROM planned""")
def _(t):
    plan = Q.stage1_plan(Q.analyze_query(_turns(t)))
    return plan.select("conv_id", "turn", "category", "stage1_limit", *[F.round(c, 6).alias(c) for c in ("stage1_threshold", "fallback_threshold", "base_final")])


# --- the stages over the question set ---

PLAN = f"WITH {shared.VECTORS}, {shared.QUERY_SET}, {shared.PAIRS}, {analysis_sql('questions')}"
SEARCH_TEXT = keywords.SEARCH_TEXT
BOOST = f"""CASE WHEN chunk_type IN ({S.text_list(R.BOOSTED_TYPES)}) THEN 1.1::DOUBLE ELSE 1 END * CASE WHEN len(key_entities) > 0 OR len(topics) > 0 THEN 1.05::DOUBLE ELSE 1 END"""


def stage1_sql(hybrid: bool) -> str:
    pool = "least(stage1_limit * 3, 50)" if hybrid else "stage1_limit"
    head = f"""near AS (SELECT query_id, key, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, key) AS near_rank FROM pairs),
pooled AS (SELECT n.* EXCLUDE (near_rank), p.* EXCLUDE (query_id, embedding) FROM near n JOIN planned p USING (query_id) WHERE near_rank <= {pool} AND similarity >= 0.15::DOUBLE),
eff AS (SELECT *, CASE WHEN max(similarity) OVER (PARTITION BY query_id) >= stage1_threshold THEN stage1_threshold ELSE fallback_threshold END AS used_threshold FROM pooled),
cut AS (SELECT * FROM eff WHERE similarity >= used_threshold),
hits AS (SELECT c.*, v.* EXCLUDE (key, embedding, label, created_at), round(similarity * importance_score * {BOOST}, 9) AS score FROM cut c JOIN vectors v USING (key)),
cand AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank, {SEARCH_TEXT} AS text FROM hits)"""
    if not hybrid:
        return head + ", stage1 AS (SELECT *, NULL::DOUBLE AS keyword_score, NULL::DOUBLE AS hybrid_score FROM cand WHERE rank <= stage1_limit)"
    return f"""{head}, {keywords.bm25_sql(False)},
hyb AS (SELECT c.*, least(1.0::DOUBLE, bm25 / 10) AS keyword_score, {keywords.HYBRID} AS hybrid_score FROM cand c JOIN scored USING (query_id, key)),
stage1 AS (SELECT * FROM hyb QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, key) <= stage1_limit)"""


CROSS = f"""least(1.0::DOUBLE, greatest(0.0::DOUBLE, similarity
  + len(list_intersect(list_distinct({S.words('lower(query_text)')}), {S.words('lower(content)')}))::DOUBLE / greatest(len(list_distinct({S.words('lower(query_text)')})), 1) * 0.2::DOUBLE
  + CASE WHEN query_type = 'specific' AND has_entities AND {S.has_proper('content')} THEN 0.1::DOUBLE WHEN query_type = 'comparative' AND {S.has_word('content', R.CONTENT_COMPARE_WORDS)} THEN 0.15::DOUBLE
         WHEN query_type = 'temporal' AND {S.has_word('content', R.CONTENT_TEMPORAL_WORDS)} THEN 0.1::DOUBLE ELSE 0 END
  + (CASE WHEN importance_score > 1.2::DOUBLE THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN len({S.words('lower(content)')}) BETWEEN 50 AND 300 THEN 0.05::DOUBLE WHEN len({S.words('lower(content)')}) < 20 THEN -0.1::DOUBLE ELSE 0 END)))"""


def chain(hybrid: bool) -> str:
    score = "hybrid_score" if hybrid else CROSS
    return f"""{PLAN}, {stage1_sql(hybrid)},
rr AS (SELECT *, round({score}, 9) AS rerank_score FROM stage1),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, key))::INT AS final_rank FROM rr),
tops AS (SELECT query_id, max(CASE WHEN final_rank = 1 THEN rerank_score END) AS s1, max(CASE WHEN final_rank = 3 THEN rerank_score END) AS s3 FROM ranked GROUP BY query_id),
thr AS (SELECT r.*, least(base_final, CASE WHEN s3 IS NOT NULL AND s1 - s3 > 0.2::DOUBLE THEN s3 + 0.05::DOUBLE ELSE base_final END) AS final_threshold FROM ranked r JOIN tops USING (query_id)),
final AS (SELECT * FROM thr WHERE final_rank <= 3 AND (rerank_score >= final_threshold OR final_rank = 1))"""


HYBRID, SEMANTIC = chain(True), chain(False)


def _plan(t):
    return Q.stage1_plan(Q.analyze_query(shared.query_set(t)))


def _rounded(df, ids, *cols):
    return df.select(*ids, *[F.round(c, 6).alias(c) for c in cols])


@query("stage1_candidates", sql=f"{HYBRID} SELECT query_id, key, round(similarity, 6) AS similarity, round(keyword_score, 6) AS keyword_score, round(hybrid_score, 6) AS hybrid_score FROM stage1")
def _(t):
    return _rounded(Q.stage1_candidates(shared.vectors(t), _plan(t)), ["query_id", "key"], "similarity", "keyword_score", "hybrid_score")


@query("stage1_candidates_semantic", sql=f"{SEMANTIC} SELECT query_id, key, round(similarity, 6) AS similarity, round(score, 6) AS score FROM stage1")
def _(t):
    return _rounded(Q.stage1_candidates(shared.vectors(t), _plan(t), False), ["query_id", "key"], "similarity", "score")


@query("fallback_threshold", sql=f"{HYBRID} SELECT query_id, key, round(similarity, 6) AS similarity, round(used_threshold, 6) AS used_threshold FROM cut")
def _(t):
    plan = _plan(t)
    near = V.knn_topk(shared.vectors(t), plan, R.HYBRID_POOL, min_score=0.15).join(plan.select(*Q.PLAN), "query_id")
    near = near.filter(F.col("rank") <= F.least(F.col("stage1_limit") * 3, F.lit(50)))
    return _rounded(Q.fallback_threshold(near), ["query_id", "key"], "similarity", "used_threshold")


@query("cross_encode", sql=f"{SEMANTIC} SELECT query_id, key, round({CROSS}, 6) AS relevance FROM cand")
def _(t):
    hits = Q.stage1_candidates(shared.vectors(t), _plan(t), False)
    score = Q.cross_encode(*[F.col(c) for c in ("query_text", "content", "similarity", "importance_score", "query_type", "has_entities")])
    return hits.select("query_id", "key", F.round(score, 6).alias("relevance"))


@query("rerank", sql=f"{SEMANTIC} SELECT query_id, key, final_rank, round(rerank_score, 6) AS rerank_score FROM ranked")
def _(t):
    return _rounded(Q.rerank(Q.stage1_candidates(shared.vectors(t), _plan(t), False)), ["query_id", "key", "final_rank"], "rerank_score")


@query("final_threshold", sql=f"{HYBRID} SELECT query_id, key, final_rank, round(final_threshold, 6) AS final_threshold FROM thr")
def _(t):
    ranked = Q.final_threshold(Q.rerank(Q.stage1_candidates(shared.vectors(t), _plan(t))))
    return _rounded(ranked, ["query_id", "key", "final_rank"], "final_threshold")


FINAL = "SELECT query_id, final_rank, key, query_type, category, chunk_type, round(similarity, 6) AS similarity, round(rerank_score, 6) AS rerank_score, round(final_threshold, 6) AS final_threshold FROM final"
IDS = ["query_id", "final_rank", "key", "query_type", "category", "chunk_type"]


@query("final_results", sql=f"{SEMANTIC} {FINAL}")
def _(t):
    return _rounded(Q.retrieve(shared.vectors(t), shared.query_set(t), use_hybrid=False), IDS, "similarity", "rerank_score", "final_threshold")


@query("retrieve", sql=f"{HYBRID} {FINAL}")
def _(t):
    return _rounded(Q.retrieve(shared.vectors(t), shared.query_set(t)), IDS, "similarity", "rerank_score", "final_threshold")


@query("retrieve_single_stage", sql=f"""
{PLAN}, near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, key) AS near_rank FROM pairs),
cut AS (SELECT n.query_id, n.key, round(n.similarity * v.importance_score * {BOOST}, 9) AS score FROM near n JOIN vectors v USING (key) WHERE near_rank <= 5 AND similarity >= 0.3::DOUBLE)
SELECT query_id, key, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key))::INT AS rank FROM cut""")
def _(t):
    hits = Q.retrieve(shared.vectors(t), shared.query_set(t), 5, multi_stage=False, threshold=0.3)
    return hits.select("query_id", "key", F.round("score", 6).alias("score"), "rank")


ALLOWED = f"""{shared.PAIRS.replace('pairs AS (', 'all_pairs AS (', 1)}, seen AS (SELECT query_id, {search.SEEN} FROM questions),
pairs AS (SELECT p.* FROM all_pairs p JOIN vectors v USING (key) JOIN seen s USING (query_id) WHERE {search.SEES})"""


@query("retrieve_filtered", sql=f"{HYBRID.replace(shared.PAIRS, ALLOWED, 1)} {FINAL}")
def _(t):
    """All stages, with filters of each question's own."""
    found = Q.retrieve(search.undated(shared.vectors(t)), search.asking(t))
    return _rounded(found, IDS, "similarity", "rerank_score", "final_threshold")
