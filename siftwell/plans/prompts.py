"""Context and prompts: P1 to P6."""

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import prompt as P, retrieve as Q, vector as V
from . import retrieval, shared, sqltext as S
from .registry import query

BLOCK = f"""'Document ' || n || ': "' || doc_id || '"' || CASE WHEN heading <> '' THEN ' - ' || heading ELSE '' END || chr(10) || 'Type: ' || {S.label('chunk_type')}
  || CASE WHEN context_summary <> '' THEN ' - ' || context_summary ELSE '' END
  || CASE WHEN len(key_entities) > 0 THEN chr(10) || 'Key entities: ' || array_to_string(key_entities[1:3], ', ') ELSE '' END
  || CASE WHEN len(topics) > 0 THEN chr(10) || 'Topics: ' || array_to_string(topics, ', ') ELSE '' END || chr(10) || 'Content: ' || content"""
PARTS = ["doc_id", "heading", "chunk_type", "context_summary", "key_entities", "topics", "content"]


def _block(rank):
    return P.context_block(F.col(rank), *[F.col(c) for c in PARTS])


@query("doc_context_block", sql=f"WITH {shared.VECTORS} SELECT key, {BLOCK.replace('|| n ||', '|| key ||')} AS block FROM vectors")
def _(t):
    return shared.described_vectors(t).select("key", _block("key").alias("block"))


BLOCKS = f"{retrieval.HYBRID}, blocks AS (SELECT query_id, final_rank AS n, {BLOCK.replace('|| n ||', '|| final_rank ||')} AS block FROM final)"
RULE = R.ANSWER_RULE.replace("'", "''")


def _blocks(t):
    hits = Q.retrieve(shared.vectors(t), shared.query_set(t))
    return hits.select("query_id", F.col("final_rank").alias("rank"), _block("final_rank").alias("block"))


@query("build_prompt", sql=f"""
{BLOCKS}, j AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY n) AS body FROM blocks GROUP BY query_id)
SELECT query_id, CASE WHEN body IS NOT NULL THEN '{R.CONTEXT_INTRO}' || chr(10) || chr(10) || body || chr(10) || chr(10) ELSE '' END
  || chr(10) || 'User question: ' || query_text || chr(10) || chr(10) || '{RULE}' AS prompt FROM questions LEFT JOIN j USING (query_id)""")
def _(t):
    return P.build_prompt(_blocks(t), shared.query_set(t))


@query("optimize_prompt", sql=f"""
{BLOCKS}, s AS (SELECT query_id, n, block, sum(length(block) + 2) OVER (PARTITION BY query_id ORDER BY n) AS so_far FROM blocks),
k AS (SELECT s.* FROM s JOIN questions USING (query_id) WHERE (length('{R.CONTEXT_INTRO}') + 2 + so_far + length(chr(10) || 'User question: ' || query_text || chr(10) || chr(10) || '{RULE}')) // 4 <= 600),
j AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY n) AS body FROM k GROUP BY query_id),
p AS (SELECT query_id, CASE WHEN body IS NOT NULL THEN '{R.CONTEXT_INTRO}' || chr(10) || chr(10) || body || chr(10) || chr(10) ELSE '' END
  || chr(10) || 'User question: ' || query_text || chr(10) || chr(10) || '{RULE}' AS prompt FROM questions LEFT JOIN j USING (query_id))
SELECT query_id, CASE WHEN length(prompt) // 4 <= 600 THEN prompt ELSE substr(prompt, 1, 2400) END AS prompt FROM p""")
def _(t):
    return P.optimize_prompt(_blocks(t), shared.query_set(t), 600)


@query("build_prompt_plain", sql=f"""
{retrieval.HYBRID}, j AS (SELECT query_id, string_agg(content, chr(10) || chr(10) ORDER BY final_rank) AS body FROM final GROUP BY query_id)
SELECT query_id, coalesce(body, '') AS prompt FROM questions LEFT JOIN j USING (query_id)""")
def _(t):
    hits = Q.retrieve(shared.vectors(t), shared.query_set(t)).select("query_id", F.col("final_rank").alias("rank"), F.col("content").alias("block"))
    return P.build_prompt(hits, shared.query_set(t), plain=True)


@query("budget_context", sql="""
WITH b AS (SELECT conv_id AS query_id, turn AS rank, (length(text) // 4)::BIGINT AS tokens FROM conversations),
r AS (SELECT *, (sum(tokens) OVER (PARTITION BY query_id ORDER BY rank))::BIGINT AS tokens_so_far FROM b)
SELECT * FROM r WHERE tokens_so_far <= 400""")
def _(t):
    rows = t.conversations.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.col("text").alias("block"))
    return P.budget_context(rows, 400).drop("block")


@query("rag_prompt_flags", sql=f"""
WITH p AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Context: ' ELSE '' END || text AS prompt,
  CASE doc_id % 4 WHEN 0 THEN 'amazon.nova-lite-v1:0' WHEN 1 THEN 'anthropic.claude-3-5-haiku-20241022-v1:0' WHEN 2 THEN 'anthropic.claude-sonnet-4-20250514-v1:0' ELSE 'meta.other' END AS model_id FROM documents),
f AS (SELECT doc_id, {S.either('prompt', R.RAG_INDICATORS)} AS is_rag,
  length(prompt) // 4 >= CASE WHEN starts_with(model_id, 'amazon.nova') THEN 1000 WHEN contains(model_id, 'claude-3-5-haiku') THEN 2048 ELSE 1024 END AS meets_minimum,
  model_id IN ({S.text_list(R.CACHE_MODELS)}) AS model_caches FROM p)
SELECT *, is_rag AND meets_minimum AND model_caches AS cache_worthy FROM f""")
def _(t):
    models = ["amazon.nova-lite-v1:0", "anthropic.claude-3-5-haiku-20241022-v1:0", "anthropic.claude-sonnet-4-20250514-v1:0", "meta.other"]
    model = F.element_at(F.array(*[F.lit(m) for m in models]), (F.col("doc_id") % 4 + 1).cast("int"))
    prompt = F.concat(F.when(F.col("doc_id") % 3 == 0, "Context: ").otherwise(""), F.col("text"))
    rows = t.documents.select("doc_id", prompt.alias("prompt"), model.alias("model_id"))
    return P.rag_prompt_flags(rows, "prompt", "model_id").drop("prompt", "model_id")


# A conversation as one stream: start, its replies as chunks, then end (cut short for every fifth) or error.
FRAMES = """replies AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
frames AS (
  SELECT conv_id AS connection_id, -1::BIGINT AS seq, 'start' AS type, NULL AS text FROM conversations WHERE turn = 0
  UNION ALL SELECT conv_id, turn, 'chunk', text FROM replies
  UNION ALL SELECT conv_id, 1000000, CASE WHEN conv_id % 7 = 0 THEN 'error' ELSE 'end' END, CASE WHEN conv_id % 5 = 0 THEN 'cut' ELSE string_agg(text, '' ORDER BY turn) END FROM replies GROUP BY conv_id)"""


def _frames(t):
    c = t.conversations
    replies = c.filter("role = 'assistant'").select("conv_id", "turn", "text")
    start = c.filter("turn = 0").select(F.col("conv_id").alias("connection_id"), F.lit(-1).cast("bigint").alias("seq"), F.lit("start").alias("type"), F.lit(None).cast("string").alias("text"))
    chunks = replies.select(F.col("conv_id").alias("connection_id"), F.col("turn").alias("seq"), F.lit("chunk").alias("type"), "text")
    whole = replies.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "").alias("w"))
    end = whole.select(
        F.col("conv_id").alias("connection_id"), F.lit(1000000).cast("bigint").alias("seq"), F.when(F.col("conv_id") % 7 == 0, "error").otherwise("end").alias("type"),
        F.when(F.col("conv_id") % 5 == 0, "cut").otherwise(F.col("w")).alias("text"))
    return start.unionByName(chunks).unionByName(end)


@query("assemble_frames", sql=f"""
WITH {FRAMES}, a AS (SELECT connection_id, coalesce(string_agg(CASE WHEN type = 'chunk' THEN text END, '' ORDER BY seq), '') AS text, count(CASE WHEN type = 'chunk' THEN 1 END) AS chunks,
  max(CASE WHEN type = 'end' THEN text END) AS end_text, bool_or(type = 'end') AS complete, bool_or(type = 'error') AS failed FROM frames GROUP BY connection_id)
SELECT *, coalesce(text = end_text, false) AS matches_end FROM a""")
def _(t):
    return P.assemble_frames(_frames(t))


MODEL_OF = "CASE doc_id % 5 WHEN 0 THEN 'amazon.nova-lite-v1:0' WHEN 1 THEN 'anthropic.claude' WHEN 2 THEN 'ai21.jamba' WHEN 3 THEN 'meta.llama3' ELSE 'other' END"


@query("extract_completion", sql="""
SELECT doc_id, CASE WHEN doc_id % 5 < 4 THEN text END AS answer, CASE WHEN doc_id % 5 < 4 THEN text END AS delta FROM documents""")
def _(t):
    x = F.col("text")
    full = (
        F.when(F.col("doc_id") % 5 == 0, F.to_json(F.struct(F.struct(F.struct(F.array(F.struct(x)).alias("content")).alias("message")).alias("output"))))
        .when(F.col("doc_id") % 5 == 1, F.to_json(F.struct(x.alias("completion"))))
        .when(F.col("doc_id") % 5 == 2, F.to_json(F.struct(F.array(F.struct(F.struct(x.alias("content")).alias("message"))).alias("choices"))))
        .when(F.col("doc_id") % 5 == 3, F.to_json(F.struct(x.alias("generation")))).otherwise("{}"))
    delta = (
        F.when(F.col("doc_id") % 5 == 0, F.to_json(F.struct(F.struct(F.struct(x).alias("delta")).alias("contentBlockDelta"))))
        .when(F.col("doc_id") % 5 == 2, F.to_json(F.struct(F.array(F.struct(F.struct(x.alias("content")).alias("delta"))).alias("choices"))))
        .otherwise(full))
    rows = t.documents.select("doc_id", full.alias("body"), delta.alias("part"), F.expr(MODEL_OF).alias("model"))
    return rows.select("doc_id", P.extract_completion(F.col("body"), F.col("model")).alias("answer"),
                       P.extract_completion(F.col("part"), F.col("model"), delta=True).alias("delta"))
