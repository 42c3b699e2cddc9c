"""Screening of messages, frames and log lines. Row by row, no shuffle but the rollup's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules as R
from ..functions.text import any_of, contains_any, let, strip


def _any_match(text: Column, patterns: list[str]) -> Column:
    return any_of([text.rlike("(?i)" + p) for p in patterns])


def screen_reason(text: Column, limit: int = R.MAX_MESSAGE) -> Column:
    """empty, too_long, unsafe, or null for a good message."""
    return (
        F.when(text.isNull() | (strip(text) == ""), "empty")
        .when(F.length(text) > limit, "too_long")
        .when(_any_match(text, R.UNSAFE_INPUT), "unsafe")
    )


def screen_message(df: DataFrame, text: str, limit: int = R.MAX_MESSAGE) -> DataFrame:
    """Add reason and clean_text (the trimmed text of a good message)."""
    out = df.withColumn("reason", screen_reason(F.col(text), limit))
    return out.withColumn("clean_text", F.when(F.col("reason").isNull(), strip(F.col(text))))


def screen_frame(action: Column, message: Column, limit: int = R.MAX_FRAME) -> Column:
    """Errors of a socket frame, as an array."""
    sending = action == "sendMessage"
    blank = strip(F.coalesce(message, F.lit(""))) == ""
    long = F.length(message) > limit
    checks = [
        F.when(sending & message.isNull(), "Message is required"),
        F.when(sending & message.isNotNull() & blank, "Message cannot be empty"),
        F.when(sending & ~blank & long, f"Message too long (maximum {limit} characters)"),
        F.when(sending & ~blank & ~long & _any_match(strip(message), R.UNSAFE_FRAME), "Message contains potentially unsafe content"),
        F.when(~action.isin("sendMessage", "heartbeat"), F.concat(F.lit("Unknown action: "), action)),
    ]
    return F.filter(F.array(*checks), lambda e: e.isNotNull())


def prefilter_reason(text: Column) -> Column:
    """The first rule a message breaks: spam, profanity, too_long, injection; null if none."""
    profane = sum(
        [F.regexp_count(text, F.lit(rf"(?i)(?<![A-Za-z0-9_]){w}(?![A-Za-z0-9_])")) for w in R.PROFANE_WORDS], F.lit(0))
    return (
        F.when(text.rlike(R.SPAM_REPEAT) | text.rlike(R.SPAM_SPECIAL) | text.rlike(R.SPAM_URL), "spam")
        .when(profane > 3, "profanity")
        .when(F.length(text) > R.MAX_MESSAGE, "too_long")
        .when(_any_match(text, R.SPAM_INJECTION), "injection")
    )


def xss_flags(text: Column) -> Column:
    """Indexes (from 1) of the markup patterns found."""
    hits = [F.when(text.rlike("(?i)" + p), F.lit(i)) for i, p in enumerate(R.XSS_PATTERNS, 1)]
    return F.filter(F.array(*hits), lambda h: h.isNotNull())


def needs_moderation(text: Column) -> Column:
    """Long enough, and not about the documents themselves."""
    about_documents = let(F.lower(text), lambda low: contains_any(low, R.DOCUMENT_KEYWORDS))
    return (F.length(strip(text)) >= R.MODERATION_MIN_CHARS) & ~about_documents


def moderation_rollup(messages: DataFrame, text: str, verdicts: DataFrame, key: str, verdict: str) -> DataFrame:
    """Per rule: messages, blocked, cached (text seen before) and their share.

    A repeated text is counted inside a pre-aggregated (text, rule) group, so a
    text that makes up much of the table travels as one row per task.
    """
    short = F.length(strip(F.col(text))) < R.MODERATION_MIN_CHARS
    rule = F.when(short, "short_input").when(needs_moderation(F.col(text)), "moderated").otherwise("document_query")
    judged = messages.select(key, F.md5(text).alias("digest"), rule.alias("rule")).join(verdicts.select(key, verdict), key, "left")
    blocked = (F.col("rule") == "moderated") & (F.coalesce(F.col(verdict), F.lit(0)) == 1)
    per_text = judged.groupBy("digest", "rule").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(blocked).alias("blocked"))
    repeats = F.when(F.col("rule") == "moderated", F.col("n") - 1).otherwise(0)
    return per_text.groupBy("rule").agg(
        F.sum("n").alias("messages"), F.sum("blocked").alias("blocked"), F.sum(repeats).alias("cached")
    ).withColumn("blocked_rate", F.col("blocked") / F.col("messages")).withColumn("cached_rate", F.col("cached") / F.col("messages"))


def sensitive_key(key: Column, patterns: list[str] | None = None) -> Column:
    """The key names something that must not be stored."""
    return let(F.lower(key), lambda low: contains_any(low, patterns or R.CACHE_SENSITIVE))


def redact_log(message: Column) -> Column:
    """The message, or a note naming the first sensitive word in list order."""
    first = let(F.lower(message), lambda low: F.coalesce(*[F.when(low.contains(w), F.lit(w)) for w in R.LOG_SENSITIVE]))
    return F.coalesce(F.concat(F.lit("[REDACTED] Log message contained sensitive information: "), first), message)
