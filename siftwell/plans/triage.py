"""Log triage: L1 to L7."""

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import logs as L
from . import shared, sqltext as S
from .registry import query

NAMES = ["OperationalError", "ClientError", "ValueError", "ThrottlingException", "TimeoutError", "RuntimeError", "ServiceUnavailableException"]
TEXTS = ["Invalid argument", "rate limit reached", "access denied for user", "signature does not match", "connection reset", "Too Many Requests", "all good", "credential missing", "temporary outage"]
ERRORS_CASES = (
    "CASE CAST(event_id % 7 AS INT) " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES)) + " END",
    "CASE CAST(k % 9 AS INT) " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(TEXTS)) + " END")
ERRORS = f"errs AS (SELECT event_id, {ERRORS_CASES[0]} AS name, {ERRORS_CASES[1]} AS message FROM (SELECT *, (props->>'$.k')::INT AS k FROM events))"


def _errors(t):
    return t.events.withColumn("k", shared.props_k()).select("event_id", F.expr(ERRORS_CASES[0]).alias("name"), F.expr(ERRORS_CASES[1]).alias("message"))


CLASSIFY = f"""CASE WHEN {S.either('name', ['DatabaseError', 'OperationalError', 'IntegrityError'])} THEN 'DATABASE_ERROR' WHEN {S.either('name', ['ClientError', 'BotoCoreError', 'NoCredentialsError'])} THEN 'BEDROCK_ERROR'
  WHEN {S.either('lower(message)', ['validation', 'invalid'])} THEN 'VALIDATION_ERROR' WHEN {S.either('lower(message)', ['throttl', 'rate limit', 'too many requests'])} THEN 'RATE_LIMIT_ERROR'
  WHEN {S.either('lower(message)', ['unauthorized', 'forbidden', 'access denied', 'signature', 'credential'])} THEN CASE WHEN {S.either('lower(message)', ['signature', 'signing', 'sigv4'])} THEN 'SIGNING_ERROR' ELSE 'AUTHORIZATION_ERROR' END
  ELSE 'INTERNAL_SERVER_ERROR' END"""


@query("classify_error", sql=f"WITH {ERRORS} SELECT event_id, {CLASSIFY} AS error_type FROM errs")
def _(t):
    return _errors(t).select("event_id", L.classify_error(F.col("name"), F.col("message")).alias("error_type"))


# Written out here, so that a wrong constant in the library shows.
STATUS = """WHEN 'VALIDATION_ERROR' THEN 400 WHEN 'AUTHENTICATION_ERROR' THEN 401 WHEN 'AUTHORIZATION_ERROR' THEN 403 WHEN 'RATE_LIMIT_ERROR' THEN 429
  WHEN 'DATABASE_ERROR' THEN 500 WHEN 'BEDROCK_ERROR' THEN 502 WHEN 'WEBSOCKET_ERROR' THEN 500 WHEN 'EXTERNAL_SERVICE_ERROR' THEN 502
  WHEN 'CONFIGURATION_ERROR' THEN 500 WHEN 'SIGNING_ERROR' THEN 500 WHEN 'INTERNAL_SERVER_ERROR' THEN 500"""
FRIENDLY = """WHEN 'VALIDATION_ERROR' THEN 'Please check your input and try again.'
  WHEN 'AUTHENTICATION_ERROR' THEN 'Authentication failed. Please check your credentials.'
  WHEN 'AUTHORIZATION_ERROR' THEN 'You don''t have permission to perform this action.'
  WHEN 'RATE_LIMIT_ERROR' THEN 'Too many requests. Please wait a moment and try again.'
  WHEN 'DATABASE_ERROR' THEN 'We''re experiencing technical difficulties. Please try again later.'
  WHEN 'BEDROCK_ERROR' THEN 'AI service is temporarily unavailable. Please try again later.'
  WHEN 'WEBSOCKET_ERROR' THEN 'Connection error occurred. Please refresh and try again.'
  WHEN 'EXTERNAL_SERVICE_ERROR' THEN 'External service is temporarily unavailable. Please try again later.'
  WHEN 'CONFIGURATION_ERROR' THEN 'Service configuration error. Please contact support.'
  WHEN 'SIGNING_ERROR' THEN 'Request authentication failed. Please try again.'
  WHEN 'INTERNAL_SERVER_ERROR' THEN 'An unexpected error occurred. Please try again later.'"""


@query("error_dimension", sql=f"""
WITH {ERRORS}, c AS (SELECT CASE WHEN event_id % 10 = 0 THEN 'strange_error' ELSE {CLASSIFY} END AS error_type FROM errs)
SELECT error_type, (CASE error_type {STATUS} ELSE 500 END)::INT AS status_code, CASE error_type {FRIENDLY} ELSE '{R.DEFAULT_ERROR_MESSAGE}' END AS user_message, count(*) AS errors FROM c GROUP BY ALL""")
def _(t):
    kind = F.when(F.col("event_id") % 10 == 0, "strange_error").otherwise(L.classify_error(F.col("name"), F.col("message")))
    counted = _errors(t).select(kind.alias("error_type")).groupBy("error_type").agg(F.count(F.lit(1)).alias("errors"))
    return L.with_error_dimension(counted)


@query("retryable", sql=f"""
WITH {ERRORS} SELECT event_id, lower(name) IN ({S.text_list(R.RETRYABLE_INGEST_NAMES)}) OR {S.either('lower(message)', R.RETRYABLE_INGEST_WORDS)} AS ingest,
  name IN ({S.text_list(R.RETRYABLE_CALL_NAMES)}) OR {S.either('lower(message)', R.RETRYABLE_CALL_WORDS)} AS call FROM errs""")
def _(t):
    name, message = F.col("name"), F.col("message")
    return _errors(t).select("event_id", L.retryable_ingest(name, message).alias("ingest"), L.retryable_call(name, message).alias("call"))


PRIORITY = "CASE " + " ".join(f"WHEN regexp_matches(line, '(?i){p}') THEN {i}" for i, (p, _, _) in enumerate(R.LOG_SIGNATURES, 1)) + " END"


def _pick(place):
    return "CASE priority " + " ".join(f"WHEN {i} THEN '{s[place]}'" for i, s in enumerate(R.LOG_SIGNATURES, 1)) + " END"


MATCHES = f"""{shared.LOG_LINES}, pr AS (SELECT *, {PRIORITY} AS priority FROM log_lines),
best AS (SELECT file, min(priority) AS priority FROM pr WHERE priority IS NOT NULL GROUP BY file),
matches AS (SELECT b.file, b.priority::INT AS priority, {_pick(0).replace('priority', 'b.priority', 1)} AS pattern, {_pick(1).replace('priority', 'b.priority', 1)} AS error_type,
  {_pick(2).replace('priority', 'b.priority', 1)} AS title, min(line_no) AS match_line FROM best b JOIN pr ON pr.file = b.file AND pr.priority = b.priority GROUP BY ALL)"""


@query("match_signatures", sql=f"WITH {MATCHES} SELECT * FROM matches")
def _(t):
    return L.match_signatures(shared.log_lines(t))


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


ADVICE = "CASE error_type " + " ".join(f"WHEN '{k}' THEN {_quoted(d)}" for k, (d, _) in R.SIGNATURE_ADVICE.items()) + " END"
TRY = "CASE error_type " + " ".join(f"WHEN '{k}' THEN {_quoted('; '.join(L.solutions_for(k, 'linux')))}" for k in R.SIGNATURE_ADVICE) + " END"


@query("explain_signatures", sql=f"WITH {MATCHES} SELECT file, error_type, {ADVICE} AS description, {TRY} AS solutions FROM matches")
def _(t):
    found = L.explain(L.match_signatures(shared.log_lines(t)), "linux")
    return found.select("file", "error_type", "description", F.array_join("solutions", "; ").alias("solutions"))


@query("log_context", sql=f"WITH {MATCHES} SELECT l.file, l.line_no, l.line FROM log_lines l JOIN matches m ON l.file = m.file AND l.line_no BETWEEN m.match_line - 2 AND m.match_line + 2")
def _(t):
    lines = shared.log_lines(t)
    return L.log_context(lines, L.match_signatures(lines))


IND = "CASE " + " ".join(f"WHEN regexp_matches(line, '(?i){p}') THEN {i}" for i, p in enumerate(R.GENERIC_INDICATORS, 1)) + " END"


@query("generic_errors", sql=f"""
WITH {MATCHES}, g AS (SELECT *, {IND} AS ind FROM log_lines WHERE file NOT IN (SELECT file FROM matches)),
f AS (SELECT file, min(ind) AS first FROM g WHERE ind IS NOT NULL GROUP BY file),
x AS (SELECT g.file, g.line_no, first, CASE first {' '.join(f"WHEN {i} THEN regexp_extract(line, '(?i){p}.*')" for i, p in enumerate(R.GENERIC_INDICATORS, 1))} END AS excerpt FROM g JOIN f USING (file) WHERE ind IS NOT NULL)
SELECT file, CASE first {' '.join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(R.GENERIC_INDICATORS, 1))} END AS indicator, (row_number() OVER (PARTITION BY file ORDER BY line_no))::INT AS n, line_no, excerpt
FROM x WHERE excerpt <> '' QUALIFY n <= 5""")
def _(t):
    lines = shared.log_lines(t)
    return L.generic_errors(lines, L.match_signatures(lines))


@query("ingest_summary", sql="""
WITH o AS (SELECT CASE WHEN length(text) < 60 THEN 'skipped' WHEN length(text) > 20000 THEN 'error' ELSE 'processed' END AS status FROM documents)
SELECT count(*) AS total, count_if(status = 'processed')::BIGINT AS processed, count_if(status = 'skipped')::BIGINT AS skipped, count_if(status = 'error')::BIGINT AS errors FROM o""")
def _(t):
    status = F.when(F.length("text") < 60, "skipped").when(F.length("text") > 20000, "error").otherwise("processed")
    return L.ingest_summary(t.documents.select(status.alias("status")))
