"""Exact top-k inner products by no-random-access aggregation of sorted lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .simhash import settled

EXACT = 2.0**53  # whole numbers below it are exact as doubles
LONG = 2**63 - 1


@dataclass(frozen=True)
class Reading:
    """Components that a block of vectors may hold, queries answered at once, share of the lists read in a step, candidates few enough to be scored, and blocks merged at once."""

    block_cells: int = 1 << 19
    queries: int = 64
    step: float = 0.25
    resolve: int = 128
    merge: int = 64


class Lists:
    """Two lists per component of a block of vectors: its values from the largest and from the smallest, each relative to its last one."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        n, d = x.shape
        order = np.argsort(x, axis=0, kind="stable").T
        value = np.take_along_axis(x.T, order, axis=1).astype(np.float64)
        self.least, self.largest = (value[:, 0], value[:, -1]) if n else (np.zeros(d), np.zeros(d))
        self.order = np.concatenate((order[:, ::-1], order)).astype(np.int32)  # a list per line
        self.value = np.concatenate((value[:, ::-1] - self.least[:, None], value - self.largest[:, None]))
        # kept for all queries: fresh memory costs more than clearing it
        self.read, self.mark = np.zeros((n, 2 * d)), np.zeros((n, 2 * d))

    def best(self, own: np.ndarray, queries: np.ndarray, k: int, reading: Reading) -> list[tuple[np.ndarray, list[int]]]:
        """Per query the ids and scores of the k best of the block but its own, best first, ties to the smaller id."""
        most = np.maximum(np.abs(self.least), np.abs(self.largest))
        exact = (np.abs(queries.astype(np.float64)) @ most) * 4 < EXACT
        alive = self.ids[:, None] != own[None, :]
        if exact.any():
            alive[:, exact] = self._candidates(alive[:, exact], queries[exact].astype(np.float64), k, reading)
        out = []
        for j, query in enumerate(queries):
            at = np.flatnonzero(alive[:, j])
            if exact[j]:
                score = (self.x[at] @ query).tolist()
            else:  # doubles do not hold the sums, so nothing was left out
                sums = [sum(map(int.__mul__, row, query.tolist())) for row in self.x[at].tolist()]
                score = [max(-LONG, min(LONG, s)) for s in sums]
            ids = self.ids[at]
            first = sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))[:k]
            out.append((ids[first], [score[i] for i in first]))
        return out

    def _candidates(self, alive: np.ndarray, queries: np.ndarray, k: int, reading: Reading) -> np.ndarray:
        """Which rows can still be among the k best of each query; ``alive`` says which take part.

        All lists are read from their start, a step at a time, for a set of queries
        together. A query uses the list of the largest values where its component
        is positive, that of the smallest where it is negative. What was read of a
        row, over the worst value of each list, is its lower bound; what the lists
        not read for it yet may still add at the place where they stand makes its
        upper bound. No upper bound is below that of a row not met at all, so
        nothing is out as long as the k-th best lower bound does not exceed that.
        Reading stops when no query has more than ``resolve`` rows left, or the
        lists end.
        """
        n, width = self.read.shape
        up, down = np.maximum(queries, 0).T, np.minimum(queries, 0).T
        use = np.concatenate((up, down))
        worst = self.least @ up + self.largest @ down
        self.read[:], self.mark[:] = 0, 0
        read, mark, column = self.read.reshape(-1), self.mark.reshape(-1), np.arange(width)[:, None]
        step, end = max(1, int(reading.step * n)), 0
        while end < n and width and (alive.sum(axis=0) > max(k, reading.resolve)).any():
            start, end = end, min(n, end + step)
            at = (self.order[:, start:end].astype(np.int64) * width + column).ravel()
            read[at] = self.value[:, start:end].ravel()
            mark[at] = 1.0
            lower = self.read @ use + worst
            known = np.where(alive, lower, -np.inf)
            floor = np.partition(known, n - k, axis=0)[n - k] if n >= k else np.full(len(worst), -np.inf)
            still = use * self.value[:, end - 1][:, None]  # what a list may add to a row that it was not read for
            rest = still.sum(axis=0)
            if (worst + rest < floor).any():
                alive &= lower + rest - self.mark @ still >= floor
        return alive


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), length)


def _search(frames: Iterator[pa.RecordBatch], k: int, reading: Reading) -> Iterator[pa.RecordBatch]:
    """Rows sorted by length, block and kind: the vectors of a block (kind 0) come before the queries that meet it (kind 1)."""
    at, ids, parts, lists = None, [], [], None
    for frame in frames:
        key = np.column_stack([frame.column(c).to_numpy() for c in ("length", "block", "kind")]).astype(np.int64)
        cut = np.flatnonzero((np.diff(key, axis=0, prepend=key[:1] - 1) != 0).any(axis=1)) if len(key) else []
        out = []
        for a, b in zip(cut, [*cut[1:], len(key)]):
            length, block, kind = key[a].tolist()
            if at != (length, block):
                at, ids, parts, lists = (length, block), [], [], None
            run = frame.slice(a, b - a)
            own, x = run.column("id").to_numpy(), _matrix(run.column("x"), length)
            if kind == 0:
                ids.append(own)
                parts.append(x)
                continue
            if not parts:
                continue
            if lists is None:
                lists = Lists(np.concatenate(ids), np.concatenate(parts))
            number = run.column("number").to_pylist()
            for i in range(0, len(x), reading.queries):
                part = slice(i, i + reading.queries)
                for each in zip(number[part], own[part], lists.best(own[part], x[part], k, reading)):
                    out.append((each[0], each[1], block, *each[2]))
        if out:
            count = [len(o[3]) for o in out]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([o[0] for o in out], count), pa.string()), pa.array(np.repeat([o[1] for o in out], count), pa.int64()),
                    pa.array(np.repeat([o[2] for o in out], count), pa.int64()), pa.array(np.concatenate([o[3] for o in out]), pa.int64()),
                    pa.array([s for o in out for s in o[4]], pa.int64()),
                ],
                ["number", "query_id", "block", "vec_id", "score"],
            )


def quantized(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """id and x: whole numbers ``floor(scale * component)``; without rows that have no key, no vector, or a component that is null or not finite.

    A product outside the range of a long becomes its nearest end.
    """
    e = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), e.alias("e")).filter(F.col("id").isNotNull() & F.col("e").isNotNull())
    return rows.filter(F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))).select(
        "id", F.transform("e", lambda c: F.floor(c * scale)).alias("x")
    )


def top_k(
    vectors: DataFrame, queries: Column | None = None, k: int = 5, key: str = "vec_id", embedding: str = "embedding", reading: Reading = Reading()
) -> DataFrame:
    """Per query its k highest inner products with all other rows: query_id, rank (from 1), vec_id, score.

    ``queries`` says which rows are queries, in terms of ``id``; by default those
    whose id is divisible by 50. Fewer than k other rows are all returned. Ties
    go to the smaller id. Only vectors of the same number of components meet;
    those of none score 0. A row is known by its id: no row with the query's id
    answers it. Rows that repeat an id are each candidates; of query rows alike in
    id and vector one asks, and those that differ in the vector ask and are ranked
    apart. Sums beyond a long count as its nearest end. An empty table
    gives an empty result. Other columns are not read.

    Vectors are dealt to blocks of about ``block_cells`` components and never
    copied; each query goes to each block, as a stream past the block's lists, so a
    task holds one block and one batch of queries. What the blocks find is merged
    in steps of ``merge`` blocks. Sums that doubles do not hold are not bounded
    but resolved for all rows of the block.
    """
    rows = settled(quantized(vectors, key, embedding).withColumn("length", F.size("x")), "vectors")
    total = rows.count()
    size = F.greatest(F.lit(1), F.floor(reading.block_cells / F.greatest(F.col("length"), F.lit(1))))  # rows of a block
    blocks = F.ceil(F.lit(total) / size).cast("long")
    place = F.pmod(F.xxhash64("_metadata.file_path", "_metadata.row_index"), blocks)
    base = rows.select("length", place.alias("block"), F.lit(0).alias("kind"), F.lit("").alias("number"), "id", "x")
    asked = rows.filter(F.col("id") % 50 == 0 if queries is None else queries).select("length", "id", "x").distinct()
    vector = F.sha2(F.array_join(F.col("x").cast("array<string>"), ","), 256)
    asked = asked.withColumn("number", F.concat_ws(":", F.col("id").cast("string"), vector))
    every = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    asked = asked.select("length", every.alias("block"), F.lit(1).alias("kind"), "number", "id", "x")
    both = base.unionByName(asked).repartition("length", "block").sortWithinPartitions("length", "block", "kind", "number")
    found = both.mapInArrow(lambda frames: _search(frames, k, reading), "number string, query_id long, block long, vec_id long, score long")
    order = [F.col("score").desc(), F.col("vec_id")]
    most = rows.agg(F.max(blocks)).first()[0] or 1
    while most > reading.merge:
        found = found.withColumn("block", F.expr(f"block div {reading.merge}"))
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("number", "block").orderBy(*order))).filter(F.col("rank") <= k)
        most = -(-most // reading.merge)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda c: floor(256 * c::double)::bigint) x from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
),
scored as (
  select q.vec_id query_id, c.vec_id vec_id, coalesce(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])), 0)::bigint score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.x) = len(c.x)
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) rank, vec_id, score
from scored qualify rank <= 5
"""
