"""Builders for the SQL twins. Regular expressions are RE2, so look-around is spelled another way."""

from __future__ import annotations

from ..functions import rules as R

WS = R.WS_RE2


def text_list(items: list[str]) -> str:
    return ", ".join("'" + i.replace("'", "''") + "'" for i in items)


def either(t: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({t}, '{n}')" for n in needles) + ")"


def starts(t: str, heads: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({t}, '{h}')" for h in heads) + ")"


def sents(t: str) -> str:
    return rf"list_filter(string_split(regexp_replace({t}, '([.!?]){WS}+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


def words(t: str) -> str:
    return f"list_filter(string_split_regex({t}, '{WS}+'), lambda s: s <> '')"


def toks(t: str) -> str:
    return rf"regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}_]+')"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^{WS}+|{WS}+$', '', 'g')"


def plain(t: str) -> str:
    """Same text with other scripts' word characters as 0 and their signs as |, so ASCII \\b cuts alike."""
    return rf"regexp_replace(regexp_replace({t}, '[^\x00-\x7F\p{{L}}\p{{N}}]', '|', 'g'), '[^\x00-\x7F]', '0', 'g')"


def has_word(t: str, items: list[str]) -> str:
    return rf"regexp_matches({plain(f'lower({t})')}, '\b(?:{'|'.join(items)})\b')"


def has_proper(t: str) -> str:
    return rf"regexp_matches({plain(t)}, '\b[A-Z][a-z]+\b')"


def proper(t: str) -> str:
    return rf"regexp_extract_all({plain(t)}, '\b[A-Z][a-z]+(?:{WS}+[A-Z][a-z]+)*\b')"


def count_of(t: str, needle: str) -> str:
    return f"((length({t}) - length(replace({t}, '{needle}', ''))) // {len(needle)})"


def is_upper(t: str) -> str:
    return rf"(regexp_matches({t}, '\p{{Lu}}') AND NOT regexp_matches({t}, '[\p{{Ll}}\p{{Lt}}]'))"


def is_title(t: str) -> str:
    broken = r"(?:^|[^\p{Lu}\p{Ll}\p{Lt}])\p{Ll}|[\p{Lu}\p{Ll}\p{Lt}][\p{Lu}\p{Lt}]"
    return rf"(regexp_matches({t}, '[\p{{Lu}}\p{{Lt}}]') AND NOT regexp_matches({t}, '{broken}'))"


def label(kind: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{k.title()}'" for k in R.TYPE_WEIGHTS)
    return f"CASE {kind} {cases} END"


def micros(ts: str) -> str:
    return f"epoch_us({ts})"


# --- description ---------------------------------------------------------------


def heading(t: str) -> str:
    line = strip(f"string_split({strip(t)}, chr(10))[1]")
    first = strip(f"{sents(t)}[1]")
    return (
        f"CASE WHEN length({line}) < 100 AND ({is_upper(line)} OR {is_title(line)} OR {either(f'lower({line})', R.HEADING_MARKERS)}) THEN {line} "
        f"WHEN length({first}) < 80 AND suffix({first}, '.') THEN {first}[:-2] ELSE '' END"
    )


def kind(t: str) -> str:
    low = f"lower({t})"
    return (
        f"CASE WHEN {count_of(t, chr(34))} >= 2 THEN 'dialogue' WHEN {either(low, R.OPENING_MARKERS)} THEN 'narrative_opening' "
        f"WHEN {either(low, R.ACTION_MARKERS)} THEN 'action' WHEN {either(low, R.DESCRIPTION_MARKERS)} THEN 'description' "
        f"WHEN contains({t}, '?') OR {either(low, R.QUESTION_MARKERS)} THEN 'question' ELSE 'paragraph' END"
    )


def first_seen(items: str) -> str:
    """Distinct items in order of first appearance."""
    return f"list_filter({items}, lambda e, i: list_position({items}, e) = i)"


def entities(t: str) -> str:
    found = f"list_concat({proper(t)}[1:5], regexp_extract_all({t}, '\"([^\"]+)\"', 1)[1:3])"
    return (
        f"list_filter({first_seen(found)}, lambda e: e NOT IN ({text_list(R.ENTITY_STOP_WORDS)}) AND length(e) > 2)[1:8]"
    )


def topics(t: str) -> str:
    low = f"lower({t})"
    items = ", ".join(f"CASE WHEN {either(low, w)} THEN '{k}' END" for k, w in R.TOPIC_KEYWORDS.items())
    return f"list_filter([{items}], lambda x: x IS NOT NULL)[1:4]"


def importance(t: str, kind_col: str, entity_col: str) -> str:
    weight = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in R.TYPE_WEIGHTS.items())
    return (
        f"least(CASE {kind_col} {weight} END + len({entity_col}) * 0.1::DOUBLE + {count_of(t, '?')} * 0.1::DOUBLE "
        f"+ {count_of(t, '!')} * 0.05::DOUBLE + {count_of(t, chr(34))} * 0.05::DOUBLE, 2.0::DOUBLE)"
    )


def summary(t: str, heading_col: str, kind_col: str) -> str:
    first = f"{sents(t)}[1]"
    return (
        f"CASE WHEN {heading_col} <> '' THEN {label(kind_col)} || ': ' || {heading_col} "
        f"WHEN {first} IS NOT NULL THEN {label(kind_col)} || ': ' || substr({first}, 1, 100) || '...' "
        f"ELSE {label(kind_col)} || ': ' || substr({t}, 1, 80) || '...' END"
    )
