"""Screening: G1 to G8. Messages are conversation turns and pages, some with an added phrase by row number."""

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import screen as G
from . import sqltext as S
from .registry import query

ADDED = {1: " <script>x</script>", 2: " please eval(1)", 3: " $' || '{name}", 4: " see https://example.org/x", 5: " aaaaaaaaaaaaaaaa", 6: " damn damn shit Damn",
         7: " what does the document say", 8: " onclick = go()", 9: " my api_key and password", 10: " Data:text/html"}
MSG = ("CASE WHEN n % 13 = 0 THEN '   ' WHEN n % 13 = 11 THEN repeat(text || ' ', 40) WHEN n % 13 = 12 THEN 'hi' ELSE text || CASE n % 13 "
       + " ".join(f"WHEN {k} THEN '{v}'" for k, v in ADDED.items()) + " ELSE '' END END")
MESSAGES = f"messages AS (SELECT conv_id, turn, {MSG} AS message, conv_id % 17 AS verdict FROM (SELECT *, conv_id * 5 + turn AS n FROM conversations))"


def _messages(t):
    rows = t.conversations.withColumn("n", F.col("conv_id") * 5 + F.col("turn"))
    return rows.select("conv_id", "turn", F.expr(MSG).alias("message"))


def _match(t, patterns):
    return "(" + " OR ".join(f"regexp_matches({t}, '(?i){p}')" for p in patterns) + ")"


@query("screen_message", sql=f"""
WITH {MESSAGES}, r AS (SELECT conv_id, turn, message, CASE WHEN {S.strip('message')} = '' THEN 'empty' WHEN length(message) > 2000 THEN 'too_long' WHEN {_match('message', R.UNSAFE_INPUT)} THEN 'unsafe' END AS reason FROM messages)
SELECT conv_id, turn, reason, CASE WHEN reason IS NULL THEN {S.strip('message')} END AS clean_text FROM r""")
def _(t):
    return G.screen_message(_messages(t), "message").drop("message")


# RE2 has no look-ahead; on this data a script block and its plain form match alike.
FRAME_RULES = [r"<script\b.*</script>", *R.UNSAFE_FRAME[1:]]
ACTION = "CASE WHEN turn % 5 = 4 THEN 'heartbeat' WHEN turn % 5 = 3 THEN 'dance' ELSE 'sendMessage' END"


@query("screen_frame", sql=f"""
WITH {MESSAGES}, f AS (SELECT conv_id, turn, {ACTION} AS action, CASE WHEN conv_id % 9 > 0 THEN message END AS m FROM messages)
SELECT conv_id, turn, array_to_string(list_filter([
  CASE WHEN action = 'sendMessage' AND m IS NULL THEN 'Message is required' END,
  CASE WHEN action = 'sendMessage' AND m IS NOT NULL AND {S.strip('m')} = '' THEN 'Message cannot be empty' END,
  CASE WHEN action = 'sendMessage' AND {S.strip('m')} <> '' AND length(m) > 4000 THEN 'Message too long (maximum 4000 characters)' END,
  CASE WHEN action = 'sendMessage' AND {S.strip('m')} <> '' AND length(m) <= 4000 AND {_match('m', FRAME_RULES)} THEN 'Message contains potentially unsafe content' END,
  CASE WHEN action NOT IN ('sendMessage', 'heartbeat') THEN 'Unknown action: ' || action END], lambda e: e IS NOT NULL), '; ') AS errors FROM f""")
def _(t):
    rows = _messages(t).select("conv_id", "turn", F.expr(ACTION).alias("action"), F.when(F.col("conv_id") % 9 > 0, F.col("message")).alias("m"))
    return rows.select("conv_id", "turn", F.array_join(G.screen_frame(F.col("action"), F.col("m")), "; ").alias("errors"))


REPEAT = "(" + " OR ".join(f"contains(message, repeat('{c}', 11))" for c in "abcdefghijklmnopqrstuvwxyz .-=_*") + ")"
PROFANE = " + ".join(f"len(regexp_extract_all(message, '(?i)\\b{w}\\b'))" for w in R.PROFANE_WORDS)


@query("prefilter_spam", sql=f"""
WITH {MESSAGES}
SELECT conv_id, turn, CASE WHEN {REPEAT} OR regexp_matches(message, '{R.SPAM_SPECIAL}') OR regexp_matches(message, '{R.SPAM_URL}') THEN 'spam' WHEN {PROFANE} > 3 THEN 'profanity'
  WHEN length(message) > 2000 THEN 'too_long' WHEN {_match('message', R.SPAM_INJECTION)} THEN 'injection' END AS reason FROM messages""")
def _(t):
    return _messages(t).select("conv_id", "turn", G.prefilter_reason(F.col("message")).alias("reason"))


@query("xss_flags", sql=f"""
SELECT page_id, array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches(html, '(?i){p}') THEN {i} END" for i, p in enumerate(R.XSS_PATTERNS, 1))}], lambda x: x IS NOT NULL), ',') AS flags FROM pages""")
def _(t):
    return t.pages.select("page_id", F.array_join(F.transform(G.xss_flags(F.col("html")), lambda x: x.cast("string")), ",").alias("flags"))


@query("needs_moderation", sql=f"""
WITH {MESSAGES} SELECT conv_id, turn, length({S.strip('message')}) >= 18 AND NOT {S.either('lower(message)', R.DOCUMENT_KEYWORDS)} AS needed FROM messages""")
def _(t):
    return _messages(t).select("conv_id", "turn", G.needs_moderation(F.col("message")).alias("needed"))


@query("moderation_rollup", sql=f"""
WITH r AS (SELECT doc_id, md5(text) AS digest, CASE WHEN length({S.strip('text')}) < 18 THEN 'short_input' WHEN {S.either('lower(text)', R.DOCUMENT_KEYWORDS)} THEN 'document_query' ELSE 'moderated' END AS rule FROM documents),
j AS (SELECT r.*, CASE WHEN rule = 'moderated' AND toxic = 1 THEN 1 ELSE 0 END AS blocked FROM r LEFT JOIN labels USING (doc_id)),
g AS (SELECT rule, count(*) AS messages, sum(blocked)::BIGINT AS blocked, (CASE WHEN rule = 'moderated' THEN count(*) - count(DISTINCT digest) ELSE 0 END)::BIGINT AS cached FROM j GROUP BY rule)
SELECT *, round(blocked::DOUBLE / messages, 6) AS blocked_rate, round(cached::DOUBLE / messages, 6) AS cached_rate FROM g""")
def _(t):
    rows = G.moderation_rollup(t.documents, "text", t.labels, "doc_id", "toxic")
    return rows.select(
        "rule", F.col("messages").cast("bigint"), F.col("blocked").cast("bigint"), F.col("cached").cast("bigint"),
        F.round("blocked_rate", 6).alias("blocked_rate"), F.round("cached_rate", 6).alias("cached_rate"))


@query("sensitive_key", sql=f"""
WITH {MESSAGES} SELECT conv_id, turn, {S.either('lower(message)', R.CACHE_SENSITIVE)} AS cache_blocked, {S.either('lower(message)', R.REQUEST_SENSITIVE)} AS request_blocked FROM messages""")
def _(t):
    m = F.col("message")
    return _messages(t).select("conv_id", "turn", G.sensitive_key(m).alias("cache_blocked"), G.sensitive_key(m, R.REQUEST_SENSITIVE).alias("request_blocked"))


@query("redact_log", sql=f"""
WITH {MESSAGES} SELECT conv_id, turn, CASE {' '.join(f"WHEN contains(lower(message), '{w}') THEN '[REDACTED] Log message contained sensitive information: {w}'" for w in R.LOG_SENSITIVE)} ELSE message END AS line FROM messages""")
def _(t):
    return _messages(t).select("conv_id", "turn", G.redact_log(F.col("message")).alias("line"))
