"""Line-first quality rules: judge every line, take failing lines out, then judge what is left of the document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, free_name, hold, split_words

SYMBOLS = "#*$%&|<>"
WORD_CHAR = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the document rule behind them."""

    min_words_for_stop: int = 12  # a line this long should hold the end of a sentence
    stop: str = r"[.!?…。！？]"
    max_symbol_share: float = 0.1  # symbols among the line's characters that are not white space
    max_separators: int = 3  # of a menu: more of them mark a navigation line
    separators: str = "|•·»›→"
    menu_line: str = (
        r"(?i)^\s*(home|menu|search|log ?in|log ?out|sign ?in|sign ?up|register|next|previous|back to top|skip to (main )?content"
        r"|read more|share|tweet|print|sitemap|contact us|about us|faq)\s*$"
    )
    boilerplate: str = (
        r"(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie policy|(accept|use of|uses) (all )?cookies"
        r"|enable javascript|javascript (is )?(disabled|required)|lorem ipsum|subscribe to our newsletter|sign up for our newsletter)"
    )
    max_lost_share: float = 0.3  # of the characters in lines with words


def _symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def line_fails(line: Column, rules: LineRules) -> Column:
    """True for a line that breaks the punctuation, navigation or boilerplate rule."""
    solid = F.length(F.regexp_replace(line, WHITE, ""))
    separators = F.length(line) - F.length(F.translate(line, rules.separators, ""))
    long_line = F.size(F.split(F.trim(line), WHITE)) >= rules.min_words_for_stop
    punctuation = (long_line & ~line.rlike(rules.stop)) | (_symbols(line) > rules.max_symbol_share * solid)
    navigation = (separators > rules.max_separators) | line.rlike(rules.menu_line)
    return punctuation | navigation | line.rlike(rules.boilerplate)


def _repeat_words(df: DataFrame, words: str) -> DataFrame:
    """Adds n_repeat_words: words inside 8-word windows that the text holds at least twice.

    Windows are told apart by a 64-bit hash. Texts whose hashes all differ are
    done there; in the others the hashes are sorted with their positions, equal
    neighbours are the repeated windows, and the words covered by them are summed.
    """
    hashes, order, starts = (free_name(df, c) for c in ("__windows", "__order", "__starts"))
    w = F.col(words)
    word_hash = F.transform(w, lambda x: F.xxhash64(x))
    windows = F.transform(
        F.array(word_hash),
        lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 8), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(8)])),
    )[0]
    df = df.withColumn(hashes, F.when(F.size(w) > 8, windows))
    df = df.withColumn(
        order,
        F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes),
            F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop(hashes)
    o = F.col(order)
    repeated = F.filter(o, lambda x, j: (x["h"] == F.get(o, j - 1)["h"]) | (x["h"] == F.get(o, j + 1)["h"]))
    df = df.withColumn(starts, F.array_sort(F.transform(repeated, lambda x: x["i"]))).drop(order)
    s = F.col(starts)
    covered = F.transform(s, lambda p, j: F.least(F.lit(8), F.coalesce(F.get(s, j + 1) - p, F.lit(8))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop(starts)


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """One row per row of ``docs`` with the counts, the verdict and the cleaned text.

    Columns: the key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_lines, n_failed_lines, lost_chars, kept, clean_text. Only key
    and text are read, so other columns of any name do no harm. A null or empty
    text has no words: it fails, and its clean text is empty. Repeated rows are
    judged one by one; an empty table gives an empty result. The clean text keeps
    the lines that pass, in order; a text without failing lines keeps every
    character. Everything happens inside the row: no shuffle, and a long text
    costs its length (times the logarithm where windows repeat).
    """
    t = F.col("__text")
    df = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    df = df.withColumn("__words", split_words(t))
    df = _repeat_words(df, "__words").withColumn("n_words", F.size("__words").cast("long")).drop("__words")
    marked = lambda x: F.struct(x.alias("line"), F.when(x.rlike(WORD_CHAR), line_fails(x, rules)).alias("fails"))
    marks = F.col("__marks")  # every line once; no verdict for lines without words
    df = df.withColumn("__marks", F.transform(F.split(t, "\n"), marked))
    chosen = lambda rule: F.transform(F.filter(marks, lambda m: rule(m["fails"])), lambda m: m["line"])
    df = df.withColumns({"__lines": chosen(lambda x: x.isNotNull()), "__failed": chosen(lambda x: x)})
    lines, failed, passing = F.col("__lines"), F.col("__failed"), chosen(lambda x: ~F.coalesce(x, F.lit(False)))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    df = df.select(
        F.col("__key").alias(key),
        "n_words",
        F.length(F.regexp_replace(t, WHITE, "")).cast("long").alias("word_chars"),
        _symbols(t).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size(lines).cast("long").alias("n_lines"),
        F.size(failed).cast("long").alias("n_failed_lines"),
        total(failed).alias("lost_chars"),
        total(lines).alias("__chars"),
        F.when(F.size(failed) > 0, F.array_join(passing, "\n")).otherwise(t).alias("clean_text"),
    )
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    df = df.withColumn("base_failed", base_failed)
    kept = ~F.col("base_failed") & (F.col("lost_chars") <= rules.max_lost_share * F.col("__chars"))
    return df.withColumn("kept", kept).drop("__chars")


def clean(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", rules: LineRules = LineRules()) -> DataFrame:
    """The kept documents with their own columns; failing lines are gone from the text and from ``n_chars``."""
    whole, verdict = free_name(docs, "__row"), free_name(docs, "__verdict")
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias(whole), F.col(text).alias(verdict))
    judged = hold(judge(rows, whole, verdict, rules), "kept").filter("kept")
    out = []
    for c in names:
        value = F.col(whole)[c]
        if c == text:
            value = F.col("clean_text")
        elif c == n_chars:
            value = F.when(F.col("n_failed_lines") > 0, F.length("clean_text").cast("long")).otherwise(value)
        out.append(value.alias(c))
    return judged.select(*out)


SQL = r"""
with base as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
words as (select rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w from base),
wins as (
  select rid, p, list_slice(w, p, p + 7) win from (select rid, w, unnest(range(1, len(w) - 6)) p from words where len(w) > 8)
),
rep as (select rid, p from (select rid, p, count(*) over (partition by rid, win) n from wins) where n > 1),
cov as (
  select rid, sum(least(8, coalesce(nxt - p, 8))) n
  from (select rid, p, lead(p) over (partition by rid order by p) nxt from rep) group by rid
),
lines as (
  select rid, l from (select rid, unnest(string_split(t, chr(10))) l from base) where regexp_matches(l, '[^\x20\x09-\x0D]')
),
marked as (
  select rid, l, length(l) c,
    (len(regexp_split_to_array(trim(l, ' '), '[\x20\x09-\x0D]+')) >= 12
       and not regexp_matches(l, '[.!?…。！？]'))
    or length(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) > 0.1 * length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g'))
    or length(regexp_replace(l, '[^|•·»›→]', '', 'g')) > 3
    or regexp_matches(l, '^\s*(home|menu|search|log ?in|log ?out|sign ?in|sign ?up|register|next|previous|back to top|skip to (main )?content|read more|share|tweet|print|sitemap|contact us|about us|faq)\s*$', 'i')
    or regexp_matches(l, '(all rights reserved|terms of (use|service)|privacy policy|cookie policy|(accept|use of|uses) (all )?cookies|enable javascript|javascript (is )?(disabled|required)|lorem ipsum|subscribe to our newsletter|sign up for our newsletter)', 'i')
      as bad
  from lines
),
per as (
  select rid, count(*) n_lines, count(*) - count(distinct l) n_dup, count(*) filter (bad) n_failed,
    coalesce(sum(c) filter (bad), 0) lost, sum(c) chars
  from marked group by rid
),
counted as (
  select doc_id, cast(len(w) as bigint) n_words,
    cast(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as bigint) word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) n_symbols,
    cast(coalesce(n_dup, 0) as bigint) n_dup_lines, cast(coalesce(cov.n, 0) as bigint) n_repeat_words,
    cast(coalesce(n_lines, 0) as bigint) n_lines, cast(coalesce(n_failed, 0) as bigint) n_failed_lines,
    cast(coalesce(lost, 0) as bigint) lost_chars, coalesce(chars, 0) chars
  from words left join cov using (rid) left join per using (rid)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_failed_lines, lost_chars,
  (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and lost_chars <= 0.3 * chars as kept
from counted
"""
