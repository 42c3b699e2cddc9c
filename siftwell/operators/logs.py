"""Log triage: error types, signatures, context lines, generic excerpts, run summaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import rules as R
from ..functions.text import contains_any, let


def classify_error(name: Column, message: Column) -> Column:
    """Error type by name first, then by words in the message."""
    low = F.lower(message)
    signing = contains_any(low, ["signature", "signing", "sigv4"])
    return (
        F.when(contains_any(name, ["DatabaseError", "OperationalError", "IntegrityError"]), "DATABASE_ERROR")
        .when(contains_any(name, ["ClientError", "BotoCoreError", "NoCredentialsError"]), "BEDROCK_ERROR")
        .when(contains_any(low, ["validation", "invalid"]), "VALIDATION_ERROR")
        .when(contains_any(low, ["throttl", "rate limit", "too many requests"]), "RATE_LIMIT_ERROR")
        .when(
            contains_any(low, ["unauthorized", "forbidden", "access denied", "signature", "credential"]),
            F.when(signing, "SIGNING_ERROR").otherwise("AUTHORIZATION_ERROR"),
        )
        .otherwise("INTERNAL_SERVER_ERROR")
    )


def error_dimension(spark: SparkSession) -> DataFrame:
    """error_type, status_code, user_message: a fixed table of a few rows."""
    return spark.createDataFrame(R.ERROR_DIMENSION, "error_type string, status_code int, user_message string")


def with_error_dimension(errors: DataFrame) -> DataFrame:
    """Add status_code and user_message; unknown types get the defaults."""
    joined = errors.join(F.broadcast(error_dimension(errors.sparkSession)), "error_type", "left")
    return joined.withColumns({
        "status_code": F.coalesce("status_code", F.lit(R.DEFAULT_STATUS)),
        "user_message": F.coalesce("user_message", F.lit(R.DEFAULT_ERROR_MESSAGE)),
    })


def retryable_ingest(name: Column, message: Column) -> Column:
    """Worth a retry while documents are processed."""
    return F.lower(name).isin(R.RETRYABLE_INGEST_NAMES) | contains_any(F.lower(message), R.RETRYABLE_INGEST_WORDS)


def retryable_call(name: Column, message: Column) -> Column:
    """Worth a retry while a request is served."""
    return name.isin(R.RETRYABLE_CALL_NAMES) | contains_any(F.lower(message), R.RETRYABLE_CALL_WORDS)


def _first_match(line: Column, patterns: list[str]) -> Column:
    """Place of the first pattern the line matches, in any case; null if none.

    The literal head of a pattern is looked for first, so the regular expression
    runs only on lines that have it.
    """

    def test(low, pattern):
        head = re.split(r"[.*]", pattern)[0]
        found = low.contains(head.lower())
        return found if head == pattern else found & line.rlike("(?i)" + pattern)

    return let(F.lower(line), lambda low: F.coalesce(*[F.when(test(low, p), F.lit(i)) for i, p in enumerate(patterns, 1)]))


def signature_priority(line: Column) -> Column:
    """Place of the first signature, in list order, that the line matches; null if none."""
    return _first_match(line, [s[0] for s in R.LOG_SIGNATURES])


def _pick(priority: Column, place: int) -> Column:
    return F.element_at(F.array(*[F.lit(s[place]) for s in R.LOG_SIGNATURES]), priority)


def match_signatures(lines: DataFrame) -> DataFrame:
    """The winning signature per file: file, priority, pattern, error_type, title, first_line.

    Patterns are tested inside the line's row; per file only the least
    (priority, line) is kept, combined before the shuffle.
    """
    hits = lines.select("file", "line_no", signature_priority(F.col("line")).alias("priority")).filter("priority is not null")
    best = hits.groupBy("file").agg(F.min(F.struct("priority", "line_no")).alias("m"))
    p = F.col("m.priority")
    return best.select(
        "file", p.alias("priority"), _pick(p, 0).alias("pattern"), _pick(p, 1).alias("error_type"), _pick(p, 2).alias("title"),
        F.col("m.line_no").alias("match_line"))


def solutions_for(error_type: str, system: str) -> list[str]:
    """What to try, by error type and system (linux, darwin or windows)."""
    known = R.SIGNATURE_ADVICE[error_type][1]
    return known if isinstance(known, list) else known.get(system, known[""])


def explain(matches: DataFrame, system: str = "linux") -> DataFrame:
    """Add description and solutions to matched signatures, from a fixed list inside the row."""
    advice = F.create_map(*[x for kind, (text, _) in R.SIGNATURE_ADVICE.items() for x in (
        F.lit(kind), F.struct(F.lit(text).alias("description"), F.array(*map(F.lit, solutions_for(kind, system))).alias("solutions")))])
    found = F.try_element_at(advice, F.col("error_type"))
    return matches.withColumns({"description": found["description"], "solutions": found["solutions"]})


def log_context(lines: DataFrame, matches: DataFrame, around: int = 2, limit: int = 10) -> DataFrame:
    """The lines around each file's first match: file, line_no, line.

    The range is spelled out as line numbers and joined on (file, line_no).
    """
    wanted = matches.select("file", F.explode(F.sequence(
        F.col("match_line") - around, F.least(F.col("match_line") + around, F.col("match_line") - around + limit - 1)
    )).alias("line_no"))
    return lines.join(wanted, ["file", "line_no"]).select("file", "line_no", "line")


def indicator_priority(line: Column) -> Column:
    """Place of the first error indicator in the line; upper and lower case are alike."""
    return _first_match(line, R.GENERIC_INDICATORS)


def generic_errors(lines: DataFrame, matches: DataFrame, limit: int = 5) -> DataFrame:
    """Excerpts for files without a signature: their first indicator's first matches.

    Every line is reduced to at most one excerpt, and the ranking keeps five rows
    per file in each task before the shuffle.
    """
    open_lines = lines.join(matches.select("file"), "file", "left_anti")
    marked = open_lines.withColumn("indicator", indicator_priority(F.col("line"))).filter("indicator is not null")
    first = marked.groupBy("file").agg(F.min("indicator").alias("first_indicator"))
    patterns = F.array(*[F.lit(p) for p in R.GENERIC_INDICATORS])
    rows = marked.join(first, "file")
    excerpt = F.coalesce(*[
        F.when(F.col("first_indicator") == i, F.nullif(F.regexp_extract("line", f"(?i){p}.*", 0), F.lit("")))
        for i, p in enumerate(R.GENERIC_INDICATORS, 1)])
    found = rows.withColumn("excerpt", excerpt).filter("excerpt is not null")
    order = W.partitionBy("file").orderBy("line_no")
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit).select(
        "file", F.element_at(patterns, F.col("first_indicator")).alias("indicator"), "n", "line_no", "excerpt")


def ingest_summary(outcomes: DataFrame, status: str = "status") -> DataFrame:
    """One row: total, processed, skipped, errors."""
    n = lambda s: F.count_if(F.col(status) == s)
    return outcomes.agg(F.count(F.lit(1)).alias("total"), n("processed").alias("processed"), n("skipped").alias("skipped"), n("error").alias("errors"))
