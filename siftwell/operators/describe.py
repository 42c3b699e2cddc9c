"""Chunk description: heading, type, entities, topics, importance, summary, embedding text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import rules as R
from ..functions.text import (
    contains_any, count_of, first_sentence, has_word, is_title, is_upper, let, proper_nouns, sentences, strip, title_label,
)


def _holds(text: Column, needles: list[str], whole_word: bool) -> Column:
    return has_word(text, needles) if whole_word else contains_any(text, needles)


def chunk_heading(text: Column) -> Column:
    """The first line where it looks like a title, else a short first sentence, else empty."""
    line = strip(F.substring_index(strip(text), "\n", 1))

    def own_line(x):
        titled = is_upper(x) | is_title(x) | x.rlike(f"(?i)(?:{'|'.join(R.HEADING_MARKERS)})")
        return F.when((F.length(x) < 100) & titled, x)

    def short_sentence(x):
        return F.when((F.length(x) < 80) & x.endswith("."), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise("")

    return F.coalesce(let(line, own_line), let(strip(first_sentence(text)), short_sentence), F.lit(""))


def chunk_type(text: Column, whole_word: bool = False) -> Column:
    return let(F.lower(text), lambda low: (
        F.when(count_of(low, '"') >= 2, "dialogue")
        .when(_holds(low, R.OPENING_MARKERS, whole_word), "narrative_opening")
        .when(_holds(low, R.ACTION_MARKERS, whole_word), "action")
        .when(_holds(low, R.DESCRIPTION_MARKERS, whole_word), "description")
        .when(low.contains("?") | _holds(low, R.QUESTION_MARKERS, whole_word), "question")
        .otherwise("paragraph")
    ))


def key_entities(text: Column) -> Column:
    """Five capitalised runs and three quoted terms, distinct, in order of first appearance, eight at most."""
    quoted = F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1))
    found = F.array_distinct(F.concat(F.slice(proper_nouns(text), 1, 5), F.slice(quoted, 1, 3)))
    kept = F.filter(found, lambda e: ~e.isin(R.ENTITY_STOP_WORDS) & (F.length(e) > 2))
    return F.slice(kept, 1, 8)


def topics(text: Column, whole_word: bool = False) -> Column:
    """The first four topics that have a keyword in the text."""
    found = let(F.lower(text), lambda low: F.array(*[
        F.when(_holds(low, keywords, whole_word), F.lit(topic)) for topic, keywords in R.TOPIC_KEYWORDS.items()]))
    return F.slice(F.filter(found, lambda t: t.isNotNull()), 1, 4)


def importance_local(text: Column, kind: Column, entities: Column) -> Column:
    """Type weight plus bonuses for entities, questions, exclamations and quotes; at most 2."""
    weight = F.lit(1.0)
    for name, value in R.TYPE_WEIGHTS.items():
        weight = F.when(kind == name, value).otherwise(weight)
    score = (
        weight + F.size(entities) * 0.1 + count_of(text, "?") * 0.1 + count_of(text, "!") * 0.05 + count_of(text, '"') * 0.05
    )
    return F.least(score, F.lit(2.0))


def importance_chunk(level: Column, text: Column, chunk_index: Column) -> Column:
    """Heading level, first place, keywords, sentence length and count; at most 2."""
    keyword_bonus = let(F.lower(text), lambda low: sum(
        [F.when(low.contains(k), 0.1).otherwise(0.0) for k in R.CHUNK_KEYWORDS], F.lit(0.0)))

    def density(n):
        mean = F.length(text) / F.greatest(n, F.lit(1))
        return F.when(mean.between(10, 30), 0.1).otherwise(0.0) + F.when(n.between(3, 10), 0.1).otherwise(0.0)

    score = (
        F.lit(1.0)
        + F.when(F.coalesce(level, F.lit(0)) != 0, (7 - F.least(level, F.lit(6))) * 0.1).otherwise(0.0)
        + F.when(chunk_index == 0, 0.2).otherwise(0.0)
        + keyword_bonus
        + let(F.size(sentences(text)), density)
    )
    return F.least(score, F.lit(2.0))


def context_summary(text: Column, heading: Column, kind: Column) -> Column:
    """Type and heading, or type and the start of the first sentence."""
    start = F.concat(F.substring(F.coalesce(first_sentence(text), F.lit("")), 1, 100), F.lit("..."))
    return F.concat(title_label(kind), F.lit(": "), F.when(heading != "", heading).otherwise(start))


def describe(df: DataFrame, text: str = "content", whole_word: bool = False) -> DataFrame:
    """All description columns for a chunk table."""
    body = F.col(text)
    first = df.withColumns({
        "heading": chunk_heading(body), "chunk_type": chunk_type(body, whole_word),
        "key_entities": key_entities(body), "topics": topics(body, whole_word),
    })
    return first.withColumns({
        "importance_score": F.round(importance_local(body, F.col("chunk_type"), F.col("key_entities")), 6),
        "context_summary": context_summary(body, F.col("heading"), F.col("chunk_type")),
    })


def keyword_top(df: DataFrame, key: str, text: str, n: int = 3) -> DataFrame:
    """The n most frequent longer words per text: key, rank, term, uses. Ties go to the word seen first.

    Counting is combined before the shuffle; ranking sees one row per distinct
    word of a size-guarded text.
    """
    found = df.select(key, F.posexplode(
        F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9_]+"), F.lit(0))
    ).alias("pos", "term"))
    counts = (
        found.filter((F.length("term") > 3) & ~F.col("term").isin(R.KEYWORD_STOP_WORDS))
        .groupBy(key, "term").agg(F.count(F.lit(1)).alias("uses"), F.min("pos").alias("first_pos"))
    )
    order = W.partitionBy(key).orderBy(F.desc("uses"), "first_pos")
    ranked = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return ranked.select(key, "rank", "term", "uses")


def follow_up_questions(df: DataFrame, key: str, text: str) -> DataFrame:
    """Three suggestions per text: its keywords first, then the common ones."""
    top = keyword_top(df, key, text).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("terms")
    )
    own = F.transform(F.col("terms"), lambda t: F.concat(F.lit("Tell me more about "), t["term"]))
    common = F.array(*[F.lit(q) for q in R.FOLLOW_UPS])
    return df.select(key).join(top, key, "left").select(
        key, F.slice(F.concat(F.coalesce(own, F.array().cast("array<string>")), common), 1, 3).alias("questions")
    )


def embedding_text(text: Column, limit: int = R.EMBED_TEXT_CHARS) -> Column:
    """Text to embed: whole if short; else its first and last third of sentences; else a cut at a sentence end."""
    cut = F.substring(text, 1, limit)
    upto_stop = F.regexp_extract(cut, r"(?s)^(.*[.!?])", 1)
    trimmed = F.when(F.length(upto_stop) - 1 > limit * 0.8, upto_stop).otherwise(cut)

    def long_form(sents):
        third = F.floor(F.size(sents) / 3).cast("int")
        ends = F.array_join(
            F.concat(F.slice(sents, F.lit(1), third), F.slice(sents, F.size(sents) - third + 1, third)), " "
        )
        return F.when(F.size(sents) > 4, let(ends, lambda e: F.when(F.length(e) <= limit, e).otherwise(trimmed))).otherwise(trimmed)

    return F.when(F.length(text) <= limit, text).otherwise(let(sentences(text), long_form))


def hash_embedding(text: Column, dim: int) -> Column:
    """Vector in [-0.1, 0.1] from the md5 of the text. Every 16th place repeats the first byte."""

    def spread(digest):
        def place(i):
            at = F.when(i % 16 == 15, 0).otherwise(i % 16)
            byte = F.conv(F.substring(digest, at * 2 + 1, F.lit(2)), 16, 10).cast("double")
            return (byte / 255.0 - 0.5) * 0.2

        period = F.transform(F.sequence(F.lit(0), F.lit(min(dim, 16) - 1)), place)
        return F.slice(F.flatten(F.array_repeat(period, -(-dim // 16))), 1, dim) if dim > 16 else period

    return let(F.md5(text), spread)


def embed(df: DataFrame, text: str, fn: Callable[[Column], Column] | None = None, dim: int = 64) -> DataFrame:
    """Add ``embedding``; ``fn`` is any column function, such as a pandas UDF. Default: the hash vector."""
    make = fn or (lambda c: hash_embedding(c, dim))
    return df.withColumn("embedding", make(embedding_text(F.col(text))))
