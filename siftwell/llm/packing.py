"""Best-fit packing into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import VOCABULARY
from .rank_merge import token_counts


@dataclass(frozen=True)
class Bins:
    """Permitted lengths and what a sequence costs: its length, a share that grows with its square, and a fixed part."""

    lengths: tuple[int, ...] = (512, 1024, 2048, 4096)
    square: float = 0.1  # of the length, at the longest permitted one
    fixed: float = 16.0

    def __post_init__(self):
        if not self.lengths or list(self.lengths) != sorted(set(self.lengths)) or self.lengths[0] < 1:
            raise ValueError("lengths must be positive, distinct and ascending")

    def cost(self, length: int) -> float:
        return length + self.square * length * length / self.lengths[-1] + self.fixed


def pack(sizes: list[int], bins: Bins) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and the length of each bin. ``sizes`` must not rise.

    A piece goes to the open bin that it fills best: the one with the least room
    that is enough, the oldest of equals. If there is none, a bin is opened: of
    the permitted lengths that hold the piece, the one that costs least per unit
    of what it can be filled with, the piece and everything still to come. In the
    end each bin shrinks to the shortest permitted length that holds its contents.
    """
    rooms: list[int] = []  # distinct rooms of open bins, ascending
    waiting: dict[int, list[int]] = {}  # bins by room, oldest last
    used: list[int] = []
    full: list[int] = []
    where, offset = [], []
    to_come = sum(sizes)
    for size in sizes:
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            queue = waiting[room]
            b = queue.pop()
            if not queue:
                del waiting[room], rooms[at]
        else:
            fits = bins.lengths[bisect_left(bins.lengths, size) :]
            full.append(min(fits, key=lambda n: (bins.cost(n) / min(n, to_come), n)))
            used.append(0)
            b = len(full) - 1
        where.append(b)
        offset.append(used[b])
        used[b] += size
        to_come -= size
        room = full[b] - used[b]
        if room:
            if room not in waiting:
                waiting[room] = []
                insort(rooms, room)
            insort(waiting[room], b, key=lambda x: -x)
    return where, offset, [bins.lengths[bisect_left(bins.lengths, u)] for u in used]


def best_fit(
    docs: DataFrame, key: str = "doc_id", size: str = "n_tokens", bins: Bins = Bins(), group_rows: int = 20_000
) -> DataFrame:
    """Pack documents of ``size`` tokens; one row per piece: key, piece, piece_start, n_tokens, group, bin, bin_length, bin_offset.

    A document longer than the longest permitted length is cut into pieces of it
    and a rest; all of it is packed. Rows are dealt by a hash of key and size to
    groups of about ``group_rows`` pieces, each packed by one task; more rows make
    more groups, so no task grows. Rows alike in key and size are counted first and
    dealt by their number too. What a group loses is at most the room in its last
    bins. A null or negative size counts as 0; a row of size 0 takes no room
    and is returned without a bin (group, bin, bin_length and bin_offset null).
    Rows alike in key and size are each packed. Other columns are not read.
    """
    longest = bins.lengths[-1]
    kind = docs.select(key).schema[0].dataType.simpleString()
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("long"), F.lit(0).cast("long"))
    rows = docs.select(F.col(key).alias("k"), n.alias("n"))
    total = rows.agg(F.sum(F.ceil(F.col("n") / longest))).first()[0] or 0
    groups = max(1, -(-int(total) // group_rows))
    # Rows alike are numbered, not told apart, so a repeated task deals them the same way.
    alike = rows.filter("n > 0").groupBy("k", "n").agg(F.count(F.lit(1)).alias("c"))
    lots = F.sequence(F.lit(0).cast("long"), F.expr(f"(c - 1) div {group_rows}"))
    alike = alike.select("k", "n", "c", F.explode(lots).alias("lot"))
    lot_rows = F.least(F.col("c") - F.col("lot") * group_rows, F.lit(group_rows))
    alike = alike.select("k", "n", "lot", F.explode(F.sequence(F.lit(1).cast("long"), lot_rows)).alias("copy"))
    pieces = alike.select(
        "k", "n", "lot", "copy", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / longest) - 1).cast("int"))).alias("piece")
    )
    pieces = pieces.select(
        "k", "piece", (F.col("piece").cast("long") * longest).alias("piece_start"),
        F.least(F.col("n") - F.col("piece").cast("long") * longest, F.lit(longest)).cast("long").alias("n_tokens"),
        F.pmod(F.xxhash64("k", "n", "piece", "lot", "copy"), F.lit(groups)).alias("group"),
    )

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_tokens", "k", "piece"], ascending=[False, True, True], kind="stable", na_position="first")
        where, offset, length = pack(frame["n_tokens"].tolist(), bins)
        return frame.assign(bin=where, bin_length=[length[b] for b in where], bin_offset=offset)

    packed = pieces.groupBy("group").applyInPandas(
        fill, f"k {kind}, piece int, piece_start long, n_tokens long, group long, bin long, bin_length int, bin_offset long"
    )
    none = rows.filter("n = 0").selectExpr(
        "k", "0 piece", "0L piece_start", "n n_tokens", "cast(null as long) group", "cast(null as long) bin",
        "cast(null as int) bin_length", "cast(null as long) bin_offset",
    )
    return packed.unionByName(none).withColumnRenamed("k", key)


def with_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """Key and n_tokens: the tokens of the text by the vocabulary file ``path`` and one end id, the measure of the registered query."""
    return token_counts(docs, path, key, text).select(key, (F.col("n_tokens") + 1).alias("n_tokens"))
