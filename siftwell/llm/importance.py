"""Resampling of documents towards a target text: hashed word runs, log ratios of their frequencies, Gumbel top draws."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import batches, sums
from .order import numbered

POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32, bits reversed
REACH = 64  # bytes before the end of a span that the position table covers


@dataclass(frozen=True)
class Resampling:
    """Buckets of features, words in the longest run, seed, share drawn in hundredths, and words a document must have."""

    buckets: int = 10_000
    longest: int = 3
    seed: str = "42"
    percent: int = 5
    least_words: int = 20


def _byte_classes() -> np.ndarray:
    """Byte to byte: A-Z in lower case; 0 for bytes outside words, which are ASCII other than letters and digits."""
    out = np.arange(256, dtype=np.uint8)
    out[:128] = [ord(chr(b).lower()) if chr(b).isalnum() else 0 for b in range(128)]
    return out


WORD = _byte_classes()


def _step(state: np.ndarray) -> np.ndarray:
    """CRC register after one zero byte."""
    for _ in range(8):
        state = np.where(state & 1, (state >> 1) ^ POLYNOMIAL, state >> 1)
    return state


@cache
def position_table() -> np.ndarray:
    """Entry ``256 * d + b``: what byte b adds to the register at the end of a span, d bytes behind it."""
    rows = [_step(np.arange(256, dtype=np.int64))]
    for _ in range(REACH - 1):
        rows.append(_step(rows[-1]))
    return np.concatenate(rows).astype(np.uint32)


@cache
def shift_tables(power: int) -> np.ndarray:
    """Four tables, one per byte of a register: the register after 2**power zero bytes is the XOR of their entries."""
    if power == 0:
        byte = np.arange(256, dtype=np.int64)
        return np.stack([_step(byte << (8 * k)) for k in range(4)]).astype(np.uint32)
    half = shift_tables(power - 1)
    return np.stack([shifted_by(half, row) for row in half])


def shifted_by(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    out = tables[0][state & 255]
    for k in range(1, 4):
        out = out ^ tables[k][(state >> np.uint32(8 * k)) & 255]
    return out


def shifted(state: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Each register after ``count`` zero bytes, bit by bit of the count."""
    power = 0
    while len(count) and int(count.max()) >> power:
        at = np.flatnonzero((count >> power) & 1)
        state[at] = shifted_by(shift_tables(power), state[at])
        power += 1
    return state


@cache
def _length_constants(size: int) -> np.ndarray:
    """CRC-32 of n zero bytes, for n below ``size``: what a span's length alone adds."""
    out, state = np.empty(size, np.uint32), np.full(1, 0xFFFFFFFF, np.uint32)
    for n in range(size):
        out[n] = state[0] ^ 0xFFFFFFFF
        state = shifted_by(shift_tables(0), state)
    return out


def length_constant(length: np.ndarray) -> np.ndarray:
    short = _length_constants(4 * REACH)
    out = short[np.minimum(length, len(short) - 1)]
    far = np.flatnonzero(length >= len(short))
    out[far] = shifted(np.full(len(far), 0xFFFFFFFF, np.uint32), length[far]) ^ np.uint32(0xFFFFFFFF)
    return out


def _segments(data: np.ndarray, start: np.ndarray, end: np.ndarray, tail: np.ndarray, lot: int = 1 << 18) -> np.ndarray:
    """What the bytes [start, end) add to a register ``tail`` bytes behind ``end``; no segment is empty.

    Segments that the position table reaches are looked up and folded with one
    ``reduceat``. Others are cut into blocks of at most its reach; a block's sum
    is shifted by the bytes that follow it, and a segment is the XOR of its blocks.
    At most about ``lot`` bytes are looked up at once.
    """
    out = np.empty(len(start), np.uint32)
    near = end - start + tail <= REACH
    at = np.flatnonzero(near)
    cut = np.flatnonzero(np.diff(np.cumsum(end[at] - start[at]) // lot, prepend=-1)) if len(at) else []
    table = position_table()
    for a, b in zip(cut, [*cut[1:], len(at)]):
        own = at[a:b]
        size = end[own] - start[own]
        first = np.cumsum(size) - size
        place = np.repeat(start[own] - first, size) + np.arange(int(size.sum()))
        behind = np.repeat(end[own] + tail[own] - 1, size) - place
        out[own] = np.bitwise_xor.reduceat(table[(behind << 8) | data[place]], first)
    far = np.flatnonzero(~near)
    if len(far):
        count = -(-(end[far] - start[far]) // REACH)
        step = max(1, lot // REACH)  # blocks at once
        owner_end = np.cumsum(count)
        out[far] = 0
        for a in range(0, int(owner_end[-1]), step):
            block = np.arange(a, min(a + step, int(owner_end[-1])))
            own = np.searchsorted(owner_end, block, "right")
            back = (block - (owner_end[own] - count[own])) * REACH  # counted from the segment's end
            seg = far[own]
            stop = end[seg] - back
            begin = np.maximum(start[seg], stop - REACH)
            value = _segments(data, begin, stop, np.zeros(len(block), np.int64), lot)
            value = shifted(value, back + tail[seg])
            runs = np.flatnonzero(np.diff(own, prepend=-1))
            out[far[own[runs]]] ^= np.bitwise_xor.reduceat(value, runs)
    return out


def features(texts: list[str], spec: Resampling) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Buckets of all features of the texts, in lots: first and last text + 1, buckets end to end, and how many each text of the lot has.

    A long text may come in several lots.
    """
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = WORD[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    inside = data != 0
    after = np.zeros(len(data), bool)
    after[1:] = inside[:-1] & ~inside[1:]  # the byte behind a word stands for the space between two
    first = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    owner = np.searchsorted(ends, first, "right")
    data[after] = 32
    line = data[inside | after]
    last = np.flatnonzero(after[inside | after])  # end of each word in the joined line
    start = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    lot = 1 << 17
    cut = np.flatnonzero(np.diff((last - start + 1).cumsum() // lot, prepend=-1)) if len(last) else []
    for a, b in zip(cut, [*cut[1:], len(start)]):
        lo = max(0, a - spec.longest + 1)  # words before that runs of this lot begin with
        s, e, o = start[lo:b], last[lo:b], owner[lo:b]
        state = np.zeros(b - a, np.uint32)
        found, whose = [], []
        for back in range(spec.longest):
            word = np.arange(max(a - lo, back), b - lo)  # last words of runs
            word = word[o[word - back] == o[word]]
            if not len(word):
                break
            at, own = word - back, word - (a - lo)
            tail = e[word] - s[at + 1] if back else np.zeros(len(word), np.int64)
            state[own] ^= _segments(line, s[at], e[at] + (back > 0), tail)
            found.append(((state[own] ^ length_constant(e[word] - s[at])) % np.uint32(spec.buckets)).astype(np.int64))
            whose.append(o[word])
        whose = np.concatenate(whose)
        order = np.argsort(whose, kind="stable")
        lead = int(o[a - lo])
        yield lead, int(o[-1]) + 1, np.concatenate(found)[order], np.bincount(whose - lead, minlength=int(o[-1]) + 1 - lead)


def bucket_counts(docs: DataFrame, text: str, spec: Resampling) -> DataFrame:
    """bucket and n, the number of features in it; a task sends one row per bucket at most."""

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(spec.buckets, np.int64)
        for frame in frames:
            for group in batches(frame.column(0).to_pylist()):
                for _, _, bucket, _ in features(group, spec):
                    total += np.bincount(bucket, minlength=spec.buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(total[full], pa.int64())], ["bucket", "n"])

    parts = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(count, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str, spec: Resampling) -> np.ndarray:
    """Per bucket ``floor(1000 ln(target frequency / frequency))``, each with one added to its count; ``spec.buckets`` numbers."""
    ours = bucket_counts(docs, text, spec).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    theirs = bucket_counts(target, text, spec).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    counts = ours.unionByName(theirs).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    s, t = np.zeros(spec.buckets), np.zeros(spec.buckets)
    for row in counts.collect():  # a row per bucket
        s[row.bucket], t[row.bucket] = row.s, row.t
    ratio = (t + 1) * (s.sum() + spec.buckets) / ((s + 1) * (t.sum() + spec.buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, key: str, text: str, spec: Resampling) -> DataFrame:
    """k (the key), n_features and weight (the sum of the gains of all features) of each row."""
    kind = docs.select(key).schema[0].dataType.simpleString()

    def weights(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            n, weight, row = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64), 0
            for group in batches(frame.column(1).to_pylist()):
                for a, b, bucket, count in features(group, spec):
                    n[row + a : row + b] += count
                    weight[row + a : row + b] += sums(gain[bucket], count)
                row += len(group)
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(n), pa.array(weight)], ["k", "n_features", "weight"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(weights, f"k {kind}, n_features long, weight long")


def noise(key: Column, seed: str) -> Column:
    """``floor(1000 g)`` of a Gumbel number g that follows from seed and key; a null key counts as an empty string."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(head, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", spec: Resampling = Resampling()
) -> DataFrame:
    """Per row of ``docs``: key, n_features, weight, score and rank, its place in the draw (null if not drawn).

    Words are runs of letters, digits and other characters than ASCII, A-Z in
    lower case; features are all runs of 1 to ``longest`` words, counted in
    buckets of their CRC-32. The weight of a document is the log ratio of its
    features' frequencies in ``target`` and in ``docs``; with Gumbel noise added,
    the highest ``percent`` of the documents with ``least_words`` words are a draw
    without replacement in proportion to the weights' exponentials.

    Null and empty texts have no features and weight 0. Ties go to the smaller
    key, null first; a null key is drawn like any other. Repeated rows have equal
    scores and follow one another. Empty ``docs`` give an empty result, an empty
    ``target`` has frequency 1/buckets everywhere. Other columns are not read.

    Texts are hashed once for the counts and once for the weights, in arrays of
    bounded size however long a text is; nothing but counts per bucket is
    gathered. Ranks come from ``order.numbered``.
    """
    gain = gains(docs, target, text, spec)
    # a document of w words has w + (w - 1) + ... features, so the words follow from their number
    need = sum(max(0, spec.least_words - back) for back in range(spec.longest))
    rows = weigh(docs, gain, key, text, spec)
    rows = rows.withColumn("score", F.col("weight") + noise(F.col("k"), spec.seed))
    rows = rows.withColumn("able", F.col("n_features") >= max(need, 1))
    placed = numbered(rows, "able", [F.col("score").desc(), "k"], "scores")
    drawn = F.col("able") & (F.col("pos") < F.expr(f"(n * {spec.percent}) div 100"))
    return placed.select(F.col("k").alias(key), "n_features", "weight", "score", F.when(drawn, F.col("pos") + 1).alias("rank"))


SQL = """
with recursive poly(i, k, c) as (
  select i, 0, i from range(256) r(i)
  union all select i, k + 1, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end from poly where k < 8
),
lut as (select list(c order by i) a from poly where k = 8),
words as (
  select 0 src, doc_id id, unnest(w) w, generate_subscripts(w, 1) i, row from (
    select doc_id, row_number() over () row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents)
  union all
  select 1, item_id, unnest(w), generate_subscripts(w, 1), row from (
    select item_id, row_number() over () row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from benchmark)
),
runs as (
  select src, row, w w1, w || ' ' || lead(w, 1) over next w2, w || ' ' || lead(w, 1) over next || ' ' || lead(w, 2) over next w3
  from words window next as (partition by src, row order by i)
),
feats as (
  select src, row, f, count(*) n from (select src, row, unnest([w1, w2, w3]) f from runs) where f is not null group by all
),
hashed as (
  select f, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(octet_length(encode(f))), lambda i:
      ((instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)::bigint)),
      lambda s, x: xor(s >> 8, a[xor(s & 255, x) + 1])), 4294967295::bigint) % 10000 bucket
  from (select f, hex(encode(f)) h from (select distinct f from feats)), lut
),
counted as (select bucket, sum(case when src = 0 then n else 0 end) s, sum(case when src = 1 then n else 0 end) t from feats join hashed using (f) group by 1),
gain as (
  select bucket, floor(1000 * ln(((t + 1)::double * ((select sum(s) from counted) + 10000)::double) / ((s + 1)::double * ((select sum(t) from counted) + 10000)::double)))::bigint g
  from counted
),
weighed as (select row, sum(n)::bigint n_features, sum(n * g)::bigint weight from feats join hashed using (f) join gain using (bucket) where src = 0 group by 1),
scored as (
  select doc_id, coalesce(n_features, 0) n_features, coalesce(weight, 0) weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(cast(doc_id as varchar), ''))[1:8])::bigint + 0.5) / 4294967296)))::bigint score
  from (select doc_id, row_number() over () row from documents) left join weighed using (row)
),
placed as (select *, n_features >= 57 able, row_number() over (partition by n_features >= 57 order by score desc, doc_id nulls first) pos, count(*) over (partition by n_features >= 57) n from scored)
select doc_id, n_features, weight, score, case when able and pos <= n * 5 // 100 then pos end rank from placed
"""
