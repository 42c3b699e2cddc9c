"""Chat formatting: a finite-state machine over roles checks the turn order and emits text segments with loss flags."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """What is written around a turn, which roles are learned, which turn orders are valid.

    ``{role}`` in ``open`` is the turn's role. ``moves`` maps a state to the next
    state by role; a conversation is valid if it never misses a move and ends in
    one of ``ends``. ``controls`` are the strings that must not occur in a text;
    the template's own marks are among them.
    """

    open: tuple[str, str] = ("<|im_start|>", "\n")  # before and after the role
    close: str = "<|im_end|>\n"
    learned: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    ends: tuple[str, ...] = ("answered",)
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")


def escaped(text: str, template: Template) -> str:
    """Doubles every backslash and puts a single one behind the first character of each control string."""
    text = text.replace(ESCAPE, ESCAPE * 2)
    if not any(c in text for c in template.controls):
        return text
    pattern = "|".join(map(re.escape, template.controls))
    return re.sub(pattern, lambda m: m[0][0] + ESCAPE + m[0][1:], text)


def unescaped(text: str) -> str:
    """The text before ``escaped``; a single backslash before n stands for a line end inside a role."""
    if ESCAPE not in text:
        return text
    return re.sub(r"\\([\\n]?)", lambda m: {"\\": "\\", "n": "\n", "": ""}[m[1]], text)


def segments_of(role: str, text: str, template: Template) -> list[tuple[str, bool]]:
    """The segments of one turn: its opening mark, its text, its closing mark; only the text can be learned."""
    name = escaped(role, template).replace("\n", ESCAPE + "n")
    return [(template.open[0] + name + template.open[1], False), (escaped(text, template), role in template.learned), (template.close, False)]


def turn_of(segments: list[tuple[str, bool]], template: Template) -> tuple[str, str]:
    """Role and text read back from a turn's written characters."""
    written = "".join(s for s, _ in segments)
    head, body = written.removeprefix(template.open[0]).split(template.open[1], 1)
    return unescaped(head), unescaped(body.removesuffix(template.close))


def format_turns(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per turn, in order within its conversation, with its segments and the machine's state after it.

    Reads conv_id, turn, role and text only. Columns: conv_id, place (from 0),
    role, state (null after a move that the template does not have, and for the
    rest of that conversation), segments array<struct<text,loss>>. Null text and
    null role count as empty; a null conv_id is a conversation of its own; turns
    come by number, a null number first, equal ones by role and then by text. A
    conversation is read by one task as a stream, so its length costs no memory.
    """
    ids = turns.select("conv_id").schema[0].dataType.simpleString()

    def walk(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, place = object(), None, 0
        for frame in frames:
            places, states, out = [], [], []
            convs, roles, texts = (c.to_pylist() for c in frame.columns)
            for conv, role, text in zip(convs, roles, texts):
                if conv != now:
                    now, state, place = conv, template.start, 0
                state = template.moves.get(state, {}).get(role)
                places.append(place)
                states.append(state)
                out.append([{"text": s, "loss": learned} for s, learned in segments_of(role, text, template)])
                place += 1
            kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
            yield pa.RecordBatch.from_arrays(
                [frame.column(0), pa.array(places, pa.int64()), frame.column(1), pa.array(states, pa.string()), pa.array(out, kind)],
                ["conv_id", "place", "role", "state", "segments"],
            )

    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = turns.select("conv_id", "turn", blank("role"), blank("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    return rows.mapInArrow(walk, f"conv_id {ids}, place long, role string, state string, segments array<struct<text:string,loss:boolean>>")


def digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation of ``format_turns``: counts and digests of what is read back from its segments, and its validity.

    Works on the frame as ``format_turns`` returns it, whose partitions hold whole
    conversations in order; it adds no shuffle.
    """
    ids = formatted.select("conv_id").schema[0].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        now, sums, id_kind = None, None, None

        def result(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [id_kind, *kinds])], names)

        def closed() -> tuple:
            n, all_turns, chars, loss, written, state = sums
            return now, n, all_turns.hexdigest(), chars, loss.hexdigest(), written, state in template.ends

        for frame in frames:
            id_kind, done = frame.schema.field(0).type, []
            for conv, state, parts in zip(*(frame.column(c).to_pylist() for c in ("conv_id", "state", "segments"))):
                if sums is None or conv != now:
                    if sums is not None:
                        done.append(closed())
                    now, sums = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, None]
                pairs = [(p["text"], p["loss"]) for p in parts]
                role, text = turn_of(pairs, template)
                learned = [unescaped(s) for s, loss in pairs if loss]
                sums[0] += 1
                sums[1].update(f"{role}\n{text}\n".encode())
                sums[2] += sum(map(len, learned))
                sums[3].update("".join(learned).encode())
                sums[4] += sum(len(s) for s, _ in pairs)
                sums[5] = state
            if done:
                yield result(done)
        if sums is not None:
            yield result([closed()])

    return formatted.mapInArrow(
        read, f"conv_id {ids}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    )


SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
marked as (
  select *, row_number() over (partition by conv_id order by turn nulls first, r, t) - 1 place,
    lag(r) over (partition by conv_id order by turn nulls first, r, t) prev,
    length(t) + length(t) - length(replace(t, chr(92), ''))
      + len(regexp_extract_all(t, '<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|</?s>|\[/?INST\]'))
      + length('<|im_start|>') + length(r) + 1 + length('<|im_end|>') + 1 w
  from turns
)
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by place)) turns_sha256,
  cast(coalesce(sum(length(t)) filter (r = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(t, '' order by place) filter (r = 'assistant'), '')) loss_sha256,
  cast(sum(w) as bigint) formatted_chars,
  bool_and(case r when 'system' then place = 0 when 'user' then place = 0 or prev in ('system', 'assistant')
    when 'assistant' then coalesce(prev = 'user', false) else false end)
    and arg_max(r, place) = 'assistant' as valid
from marked group by conv_id
"""
