"""SimHash near-duplicates: multi-index candidate blocks, compared bit-sliced, joined into components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .chunks import batches
from .common import free_name

SEED = 42
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
LANES = np.uint64(0x0101010101010101)
CELL = 4096  # fingerprints of a bucket that one chunk may hold; two chunks meet in a cell


def _hashes(text: str, width: int) -> list[int]:
    """XXH64 of every shingle of ``width`` words, repeats included; of the whole sequence where it is shorter."""
    words = text.encode("utf-8", "replace").lower().split()  # both know ASCII only
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size)
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip((end - size)[: 1 - width].tolist(), (end[width - 1 :] - 1).tolist())]


def fold(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of ``counts`` hashes: a bit is 1 if set in over half of them; 0 for an empty run.

    Eight bits of a hash are counted at once, one in each byte of a word, over at
    most 255 hashes; then the bytes are summed up per run.
    """
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    pieces = -(-n // 255)
    first = np.cumsum(pieces) - pieces
    owner = np.repeat(np.arange(len(full)), pieces)
    start = np.repeat(np.cumsum(n) - n, pieces) + (np.arange(len(owner)) - first[owner]) * 255
    votes = np.empty((len(full), 8, 8), np.int64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & LANES, start)
        each = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        votes[:, :, k] = np.add.reduceat(each, first, axis=0)
    bits = votes.reshape(-1, 64) * 2 > n[:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """Per row: key and ``fp``, the 64 bits of its SimHash as a long. Null text: no words, fingerprint zero."""
    kind = docs.select(key).schema[0].dataType.simpleString()

    def mark(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            out = []
            for group in batches(frame.column(1).to_pylist()):
                lists = [_hashes(t, width) for t in group]
                counts = np.fromiter(map(len, lists), np.int64, len(lists))
                out.append(fold(np.fromiter((h for each in lists for h in each), np.uint64, int(counts.sum())), counts))
            fp = np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(fp)], ["k", "fp"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(mark, f"k {kind}, fp long").withColumnRenamed("k", key)


class Planes:
    """Fingerprints stored vertically: word w of plane b holds bit b of the fingerprints 64w to 64w + 63."""

    def __init__(self, fp: np.ndarray):
        self.n = len(fp)
        bits = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        self.words = self.pack(bits.T)

    def pack(self, bits: np.ndarray) -> np.ndarray:
        """Rows of 0 and 1 as rows of words, with two empty words behind."""
        out = np.zeros((bits.shape[0], (self.n + 63) // 64 + 2), "<u8")
        packed = np.packbits(bits, axis=1, bitorder="little")
        out.view(np.uint8)[:, : packed.shape[1]] = packed
        return out

    def near(self, shift: int, wanted: np.ndarray, radius: int) -> np.ndarray:
        """Places i, of those wanted, whose fingerprint is within ``radius`` of the one at i + shift.

        All distances of a word grow together: its counters are bit planes too, a
        differing plane is added to them with a carry-save step, and a carry out
        of the highest marks distances beyond the radius (one less than a power
        of two). A word is abandoned once all its distances are beyond it.
        """
        mask = self.pack(wanted[None, :].astype(np.uint8))[0]
        at = np.flatnonzero(mask)
        beyond = ~mask[at]
        counters = [np.zeros(len(at), np.uint64) for _ in range(radius.bit_length())]
        skip, bit = divmod(shift, 64)
        for b in range(0, 64, 8):
            low, high = self.words[b : b + 8, at + skip] if bit == 0 else None, None
            if bit:
                low = self.words[b : b + 8, at + skip] >> np.uint64(bit)
                high = self.words[b : b + 8, np.minimum(at + skip + 1, self.words.shape[1] - 1)] << np.uint64(64 - bit)
                low = low | high
            differ = self.words[b : b + 8, at] ^ low
            for carry in differ:
                for c, counter in enumerate(counters):
                    counters[c], carry = counter ^ carry, counter & carry
                beyond |= carry
            live = beyond != ALL
            if not live.any():
                return np.empty(0, np.int64)
            if not live.all():
                at, beyond, counters = at[live], beyond[live], [c[live] for c in counters]
        bits = np.unpackbits((~beyond).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        word, lane = np.nonzero(bits)
        return at[word] * 64 + lane


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a[i] with b[i]; a label is the smallest place of its set."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label = nxt
    return label


def _linked(fp: np.ndarray, end: np.ndarray, radius: int) -> np.ndarray:
    """Labels of places that are linked within their group; ``end[i]`` is where the group of i ends."""
    planes, label, here = Planes(fp), np.arange(len(fp)), np.arange(len(fp))
    reach = end - here
    for shift in range(1, int(reach.max(initial=1))):
        a = planes.near(shift, reach > shift, radius)
        label = _unite(label, a, a + shift)
    return label


def _links(frames: Iterator[pa.RecordBatch], radius: int, lot: int = 65_536, wide: int = 64) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, cell, fp) sorted by bucket and cell become links from a fingerprint to the first of its set in the cell."""

    def solve(fp: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        end = np.repeat(start + size, size)
        label = _linked(fp, end, radius)
        moved = np.flatnonzero(label != np.arange(len(fp)))
        return fp[moved], fp[label[moved]]

    def groups(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
        size = np.diff(start, append=len(fp))
        found = [solve(fp[a : a + n], np.zeros(1, np.int64), np.array([n])) for a, n in zip(start[size > wide], size[size > wide])]
        narrow = (size > 1) & (size <= wide)
        s, n = start[narrow], size[narrow]
        cut = np.flatnonzero(np.diff(np.cumsum(n) // lot, prepend=-1)) if len(n) else []
        for a, b in zip(cut, [*cut[1:], len(n)]):
            ends = np.cumsum(n[a:b])
            rows = np.repeat(s[a:b] - (ends - n[a:b]), n[a:b]) + np.arange(ends[-1])
            found.append(solve(fp[rows], ends - n[a:b], n[a:b]))
        for u, v in found:
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    rest_key, rest_fp = np.empty((0, 3), np.int64), np.empty(0, np.uint64)
    for frame in frames:
        key = np.column_stack([frame.column(c).to_numpy() for c in ("t", "block", "cell")]).astype(np.int64)
        key = np.concatenate((rest_key, key))
        fp = np.concatenate((rest_fp, frame.column("fp").to_numpy().view(np.uint64)))
        if not len(key):
            continue
        same = (key == key[-1]).all(axis=1)
        last = len(key) - (len(key) if same.all() else int(np.argmin(same[::-1])))  # the last group may go on
        rest_key, rest_fp = key[last:], fp[last:]
        if last:
            yield from groups(key[:last], fp[:last])
    if len(rest_key):
        yield from groups(rest_key, rest_fp)


def _masks(radius: int, spare: int = 2) -> list[int]:
    """Bits of ``spare`` of radius + spare blocks, for each choice: two fingerprints within the radius agree on one of them."""
    blocks = radius + spare
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    masks = [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), spare)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def settled(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again, so that nothing above it is computed twice or lost with an executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints within ``radius`` bits of one another.

    Every pair within the radius is compared, in a bucket of fingerprints that
    agree on some of their blocks; of the pairs found in a cell only those needed
    to connect them are returned. A bucket of more than ``CELL`` fingerprints is
    dealt to chunks, and each two chunks meet in a cell of their own.
    """
    if radius < 1 or radius & (radius + 1):
        raise ValueError("radius must be one less than a power of two")
    tables = [F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("block")) for i, m in enumerate(_masks(radius))]
    keyed = prints.select("fp", F.explode(F.array(*tables)).alias("x")).select("fp", "x.t", "x.block")
    shared = keyed.groupBy("t", "block").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    keyed = keyed.join(shared, ["t", "block"]).withColumn("chunks", F.ceil(F.col("n") / CELL).cast("int"))
    keyed = keyed.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda d: d != F.col("chunk"))
    cells = F.transform(others, lambda d: F.least(d, F.col("chunk")) * F.col("chunks") + F.greatest(d, F.col("chunk")))
    keyed = keyed.select("t", "block", F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(cells)).alias("cell"), "fp")
    dealt = keyed.repartition("t", "block", "cell").sortWithinPartitions("t", "block", "cell")
    return dealt.mapInArrow(lambda frames: _links(frames, radius), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node of its component.

    Alternating large and small stars: each round ties the larger neighbours of a
    node, then its smaller ones, to the smallest node it knows, until nothing
    changes. Rounds grow with the logarithm of the longest chain. Each round is
    written to the shared folder.
    """
    state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    down = lambda u, v: (F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    edges = settled(edges.filter("u != v").select(*down("u", "v")).distinct(), "links")
    seen = state(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u").filter("v != m").select(*down("v", "m"))
        edges = settled(tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """Per row of ``docs``: key, fingerprint (16 hex digits) and component_id, the smallest key that links reach.

    Texts without words share the fingerprint zero and are linked like others. A
    row without a key is not compared: its component_id is null. Repeated rows
    are each returned. An empty table gives an empty result. Only key and text
    are read, so other columns of any name do no harm. Equal fingerprints are
    one node, however many rows have them.
    """
    prints = settled(fingerprints(docs, key, text, width), "fingerprints").withColumnRenamed(key, "k")
    nodes = prints.filter("k is not null").groupBy("fp").agg(F.min("k").alias("first"))
    found = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = nodes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    out = prints.join(named, "fp", "left")
    return out.select(
        F.col("k").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("k").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def chosen_rows(docs: DataFrame, chosen: DataFrame, key: str, text: str) -> DataFrame:
    """One row of ``docs`` for each (k, text_hash) of ``chosen``, and all rows without a key."""
    mark = free_name(docs, "__text_hash")
    rows = docs.withColumn(mark, F.xxhash64(text))
    named = rows.filter(F.col(key).isNotNull()).join(chosen.select(F.col("k").alias(key), F.col("text_hash").alias(mark)).distinct(), [key, mark], "left_semi")
    return named.dropDuplicates([key, mark]).select(*docs.columns).unionByName(docs.filter(F.col(key).isNull()))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """The documents without near-duplicates: of each component one row, that with the smallest key.

    A row is known by its key and its text: of rows with the smallest key the one
    whose text has the smallest hash stays, and one of rows equal in both. Rows of
    one key whose texts are not linked are in different components and each stay.
    Rows without a key were not compared and stay.
    """
    names = F.struct(F.col(key).alias("k"), F.xxhash64(text).alias("text_hash")).alias("id")
    rows = docs.filter(F.col(key).isNotNull()).select(names, F.col(text).alias("t"))
    found = near_duplicates(rows, "id", "t", width, radius)
    first = found.filter(F.col("id") == F.col("component_id")).select("id.*")
    return chosen_rows(docs, first, key, text)
