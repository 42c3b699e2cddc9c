"""Column functions on text. All of them stay inside Catalyst."""

from __future__ import annotations

from functools import reduce
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from . import rules as R

SENTENCE_MARK = "\u0001"


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable, so ``body`` may use it often without repeating its work."""
    return F.transform(F.array(value), body)[0]


def fold_out(items: Column | str, zero: dict[str, Column], fields: tuple[str, str], step: Callable[[Column, Column], Column],
             finish: Callable[[Column], Column]) -> Column:
    """A fold over an array that puts out pairs of integers, called ``fields``, on its way.

    ``step`` gets the state (the fields of ``zero`` and an empty array ``done``)
    and the next item, and returns the state with the pairs it puts out in
    ``done``; ``finish`` gets the last state with all pairs put out. The engine
    copies a fold's state with every step, an array item by item; the pairs are
    kept as one string meanwhile, whose copy costs next to nothing.
    """
    x, y = fields
    empty = F.array().cast(f"array<struct<{x}:int,{y}:int>>")

    def state(a, done):
        return F.struct(*[a[name].alias(name) for name in zero], done.alias("done"))

    def written(acc):
        new = F.transform(acc["now"]["done"], lambda p: F.concat_ws(":", p[x].cast("string"), p[y].cast("string")))
        return F.when(F.size(new) == 0, acc["out"]).otherwise(F.concat(acc["out"], F.array_join(new, ";"), F.lit(";")))

    def pairs(text):
        parts = F.filter(F.split(text, ";"), lambda p: p != "")
        number = lambda p, i: F.substring_index(p, ":", i).cast("int")
        return F.transform(parts, lambda p: F.struct(number(p, 1).alias(x), number(p, -1).alias(y)))

    return F.aggregate(
        items,
        F.struct(F.lit("").alias("out"), state(zero, empty).alias("now")),
        lambda acc, item: F.struct(written(acc).alias("out"), step(state(acc["now"], empty), item).alias("now")),
        lambda acc: let(let(written(acc), lambda out: state(acc["now"], pairs(out))), finish),
    )


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(R.WS_CHARS))


def contains_any(text: Column, needles: list[str]) -> Column:
    """A plain column is searched as it is; anything computed should be bound with ``let`` first."""
    return any_of([text.contains(n) for n in needles])


def starts_with_any(text: Column, heads: list[str]) -> Column:
    """One anchored pattern, so the text is computed once."""
    return text.rlike(rf"\A(?:{'|'.join(heads)})")


def has_word(text: Column, words: list[str]) -> Column:
    """One of the words stands in the text with no letter, digit or underscore next to it."""
    return text.rlike(f"{R.NOT_AFTER_WORD}(?:{'|'.join(words)}){R.NOT_BEFORE_WORD}")


def count_of(text: Column, needle: str) -> Column:
    """How often a literal occurs, without overlaps."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def sentences(text: Column) -> Column:
    """Sentence array: a break after ., ! or ? before whitespace."""
    marked = F.regexp_replace(text, rf"([.!?]){R.WS}+", "$1" + SENTENCE_MARK)
    return F.filter(F.split(marked, SENTENCE_MARK), lambda s: s != "")


def first_sentence(text: Column) -> Column:
    """The first of ``sentences``, without splitting the rest; null for an empty text."""
    return F.nullif(F.regexp_extract(text, rf"(?s)\A(?:.*?[.!?](?={R.WS})|.*\z)", 0), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^" + R.WS[1:-1] + "]+"))


def words(text: Column) -> Column:
    """Pieces between runs of whitespace, empty ones dropped."""
    return F.filter(F.split(text, R.WS + "+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(R.WORD_CHAR + "+"), F.lit(0))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4)


def proper_nouns(text: Column) -> Column:
    """Runs of capitalised words, of any length: a repeat that gives nothing back takes no stack per word."""
    word = "[A-Z][a-z]+" + R.NOT_BEFORE_WORD
    return F.regexp_extract_all(text, F.lit(f"{R.NOT_AFTER_WORD}{word}(?:{R.WS}+{word})*+"), F.lit(0))


def has_proper_noun(text: Column) -> Column:
    return text.rlike(R.NOT_AFTER_WORD + "[A-Z][a-z]+" + R.NOT_BEFORE_WORD)


def is_upper(text: Column) -> Column:
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"[\p{Ll}\p{Lt}]")


def is_title(text: Column) -> Column:
    """Capitals only after uncased characters, small letters only after cased ones, at least one capital."""
    broken = r"(?:^|[^\p{Lu}\p{Ll}\p{Lt}])\p{Ll}|[\p{Lu}\p{Ll}\p{Lt}][\p{Lu}\p{Lt}]"
    return text.rlike(r"[\p{Lu}\p{Lt}]") & ~text.rlike(broken)


def title_label(label: Column) -> Column:
    """Title case for snake_case labels: ``narrative_opening`` becomes ``Narrative_Opening``."""
    return F.replace(F.initcap(F.replace(label, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit("_"))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch, for zoned and zone-less timestamps (UTC session)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
