"""Vector search.

Vectors stay where they are scanned; only (query, key, score) rows move. A
small query set is sent to every task behind a size check. Beyond that bound,
queries and vectors meet in a grid of bounded blocks, still exact. Nothing
emits more than the best k per query and task, and these are merged in steps.
What a query may see (documents, dates) is tested in the scan, before scoring.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions import rules as R
from .describe import describe
from ..functions.vectors import block_scores, similarity_from_distance, valid_embedding

DIGITS = 9
TILE_CELLS = 1_000_000  # scores at once; a tile has some ten arrays of this size on its way
HELD_ROWS = 250_000  # found rows held before they are cut to the best, unless the best alone are more than half of them
# a query set that is sent to the tasks: rows, and bytes of vectors or of document bitmaps
QUERY_ROWS, QUERY_BYTES = 8_192, 32 * 1024 * 1024
# ranked rows are some 100 bytes each
NEAR_ROWS = 500_000
BLOCK_VECTORS, BLOCK_QUERIES = 50_000, 2_048
MERGE = 64  # tasks whose best rows are merged at once
FILTERS = ("document_ids", "min_date", "max_date")


def _arrow_matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _right_size(table, dim: int):
    return table.filter(pc.fill_null(pc.equal(pc.list_value_length(table["embedding"]), dim), False))


class Asked:
    """Queries of one dimension in a task: ids, vectors, own keys, and what each may see.

    The documents that queries name are numbered, and each has a bitmap of the
    queries that allow it; a last one stands for all other documents.
    """

    def __init__(self, table: pa.Table, dim: int):
        self.table, self.dim = table, dim
        self.ids = table["query_id"].to_numpy()
        self.matrix = _arrow_matrix(table["embedding"], dim)
        self.exclude = table["exclude_key"].to_numpy() if "exclude_key" in table.column_names else None
        self.bits = self.low = self.high = None
        if "document_ids" in table.column_names:
            lists = table["document_ids"].combine_chunks()
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat, owner = lists.flatten(), np.repeat(np.arange(len(lists)), size)
            known = flat.is_valid().to_numpy(zero_copy_only=False)
            self.documents = flat.filter(pa.array(known)).unique()
            at = pc.index_in(flat.filter(pa.array(known)), self.documents).to_numpy(zero_copy_only=False)
            free = np.packbits(lists.is_null().to_numpy(zero_copy_only=False), bitorder="little")
            self.bits = np.tile(free, (len(self.documents) + 1, 1))
            owner = owner[known]
            np.bitwise_or.at(self.bits, (at, owner >> 3), (1 << (owner & 7)).astype(np.uint8))
        if "min_date" in table.column_names:
            self.low = pc.fill_null(table["min_date"], -(2**63)).to_numpy()
            self.high = pc.fill_null(table["max_date"], 2**63 - 1).to_numpy()

    def allowed(self, rows: pa.Table | pa.RecordBatch) -> np.ndarray | None:
        """Whether each query may see each row; None where nothing is filtered. A row without a date is seen."""
        out = None
        if self.bits is not None:
            at = pc.fill_null(pc.index_in(rows["doc_id"], self.documents), len(self.documents)).to_numpy(zero_copy_only=False)
            out = np.unpackbits(self.bits[at], axis=1, count=len(self.ids), bitorder="little").T.astype(bool)
        if self.low is not None:
            made = rows["created_us"]
            free = made.is_null().to_numpy(zero_copy_only=False)
            made = pc.fill_null(made, 0).to_numpy(zero_copy_only=False)
            seen = free[None, :] | ((made[None, :] >= self.low[:, None]) & (made[None, :] <= self.high[:, None]))
            out = seen if out is None else out & seen
        return out


class _Best:
    """The best k of each (query, group) among the rows seen so far; ties go to the smaller key."""

    def __init__(self, asked: Asked, k: int, metric: str, min_score: float, unit: bool, digits: int):
        self.asked, self.k, self.metric, self.min_score, self.unit, self.digits = asked, k, metric, min_score, unit, digits
        self.floors: dict = {}
        self.rows: list[tuple] = []
        self.held, self.trigger = 0, HELD_ROWS

    def add(self, block, keys, weight, group, rows, only=None):
        """Vectors with their keys, weights and groups; ``rows`` has their other columns, ``only`` the places of queries to meet them."""
        n = len(self.asked.ids) if only is None else len(only)
        step = max(1, TILE_CELLS // max(1, n))
        for at in range(0, len(block) if n else 0, step):
            here = np.arange(at, min(at + step, len(block)))
            allowed = self.asked.allowed(rows.slice(at, step))
            if allowed is not None:
                allowed = allowed if only is None else allowed[only]
                seen = allowed.any(axis=0)
                here, allowed = here[seen], allowed[:, seen]
            if group is None:
                self._tile(block, keys, weight, None, here, allowed, only)
                continue
            part = group[here]
            for g in set(part.tolist()):
                mine = part == g
                self._tile(block, keys, weight, g, here[mine], None if allowed is None else allowed[:, mine], only)
            if self.held > self.trigger:
                self.shrink()
                self.trigger = max(HELD_ROWS, 2 * self.held)

    def _tile(self, block, keys, weight, part, here, allowed, only):
        if not len(here):
            return
        asked = self.asked
        floor = self.floors.setdefault(part, np.full(len(asked.ids), -np.inf))
        queries, exclude = asked.matrix, asked.exclude
        if only is not None:
            queries, floor = queries[only], floor[only]
            exclude = None if exclude is None else exclude[only]
        score = block_scores(queries, block[here], self.metric, self.digits)
        if self.unit:
            score = np.round(np.clip((score + 1.0) * 0.5, 0.0, 1.0), self.digits)
        rank = np.round(score * weight[here][None, :], self.digits) if weight is not None else score
        take = (score >= self.min_score) & np.isfinite(score) & (rank >= floor[:, None])
        if allowed is not None:
            take &= allowed
        if exclude is not None:
            take &= exclude[:, None] != keys[here][None, :]
        if rank.shape[1] > self.k:
            shown = np.where(take, rank, -np.inf)
            take &= rank >= np.partition(shown, -self.k, axis=1)[:, -self.k][:, None]
        q, v = np.nonzero(take)
        if len(q):
            self.rows.append((q if only is None else only[q], keys[here][v], score[q, v], rank[q, v], np.full(len(q), 0 if part is None else part)))
            self.held += len(q)
        if part is None and self.held > self.trigger:
            self.shrink()
            self.trigger = max(HELD_ROWS, 2 * self.held)

    def shrink(self):
        if not self.rows:
            return
        q, key, score, rank, part = (np.concatenate(c) for c in zip(*self.rows))
        order = np.lexsort((key, -rank, part, q))
        q, key, score, rank, part = q[order], key[order], score[order], rank[order], part[order]
        fresh = np.r_[True, (q[1:] != q[:-1]) | (part[1:] != part[:-1])]
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(q)), 0))
        place = np.arange(len(q)) - first
        last = place == self.k - 1
        for g, floor in self.floors.items():
            own = last if g is None else last & (part == g)
            floor[q[own]] = rank[own]
        keep = place < self.k
        self.rows = [(q[keep], key[keep], score[keep], rank[keep], part[keep])]
        self.held = int(keep.sum())


def _schema(vectors: DataFrame, queries: DataFrame, group: str | None) -> T.StructType:
    fields = [
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("key", vectors.schema["key"].dataType),
        T.StructField("similarity", T.DoubleType()),
        T.StructField("rank_score", T.DoubleType()),
        T.StructField("lot", T.LongType()),
    ]
    if group:
        fields.append(T.StructField(group, vectors.schema[group].dataType))
    return T.StructType(fields)


def _emit(best: _Best, lot: int, group: str | None, arrow_schema) -> pa.RecordBatch | None:
    best.shrink()
    if not best.rows:
        return None
    q, key, score, rank, part = best.rows[0]
    columns = [best.asked.ids[q], key, score, rank, np.full(len(q), lot)] + ([part] if group else [])
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, arrow_schema)], schema=arrow_schema
    )


def by_dimension(queries: pa.Table) -> list[Asked]:
    """A query set by the size of its vectors."""
    size = pc.list_value_length(queries["embedding"]).to_numpy()
    return [Asked(queries.filter(pa.array(size == dim)), int(dim)) for dim in np.unique(size)]


def as_asked(queries: DataFrame, vectors: DataFrame, *more: Column) -> DataFrame:
    """What tasks need of the queries: id, vector, own key, allowed documents, and dates in microseconds; ``more`` goes along."""
    document = T.ArrayType(vectors.schema["doc_id"].dataType) if "doc_id" in vectors.columns else None
    cols = [F.col("query_id"), F.col("embedding").cast("array<double>").alias("embedding")]
    if "exclude_key" in queries.columns:
        cols.append(F.col("exclude_key"))
    if "document_ids" in queries.columns:
        cols.append(F.col("document_ids").cast(document).alias("document_ids"))
    if {"min_date", "max_date"} & set(queries.columns):
        for c in ("min_date", "max_date"):
            date = F.unix_micros(F.col(c).cast("timestamp")) if c in queries.columns else F.lit(None).cast("long")
            cols.append(date.alias(c))
    return queries.filter(valid_embedding(F.col("embedding"))).select(*cols, *more)


def scanned(vectors: DataFrame, asked: DataFrame, *more: str | None) -> DataFrame:
    """What the scan reads of the vectors: no column that no query needs."""
    cols = [F.col(c) for c in ("key", "embedding", *dict.fromkeys(m for m in more if m))]
    if "document_ids" in asked.columns:
        cols.append(F.col("doc_id"))
    if "min_date" in asked.columns:
        cols.append(F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"))
    return vectors.select(*cols)


def gathered(asked: DataFrame, most_bytes: int) -> pa.Table | None:
    """The query set, if it is small enough to be sent to every task; at most ``QUERY_ROWS`` + 1 rows are fetched to tell."""
    head = asked.limit(QUERY_ROWS + 1).toArrow()
    held = sum(head[c].nbytes for c in head.column_names)
    if "document_ids" in head.column_names:
        held += pc.sum(pc.fill_null(pc.list_value_length(head["document_ids"]), 0)).as_py() * (head.num_rows // 8 + 1) if head.num_rows else 0
    return head if head.num_rows <= QUERY_ROWS and held <= most_bytes else None


def merged(partial: DataFrame, by: list[str], k: int, lots: int) -> DataFrame:
    """The best k per ``by`` with their rank; ``MERGE`` lots at a time, so that no task gets the rows of all tasks."""
    order = [F.desc("rank_score"), F.col("key")]
    while lots > MERGE:
        partial = partial.withColumn("lot", F.floor(F.col("lot") / MERGE))
        step = W.partitionBy(*by, "lot").orderBy(*order)
        partial = partial.withColumn("rank", F.row_number().over(step)).filter(F.col("rank") <= k).drop("rank")
        lots = math.ceil(lots / MERGE)
    return partial.drop("lot").withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def scan_tasks(df: DataFrame) -> int:
    """About how many tasks read a table, by the plan's own statistics; no job runs for it."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    per_task = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // per_task, 1_000_000))


def _grid(n: int, size: int) -> int:
    return max(1, math.ceil(n / size))


def top_scores(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str = "COSINE",
    min_score: float = -math.inf,
    unit_scale: bool = False,
    weight: str | None = None,
    group: str | None = None,
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """Best k keys per query (and group): query_id, key, similarity, rank_score, rank.

    ``vectors`` has key and embedding; ``queries`` has query_id, embedding and,
    where a query must not find itself, exclude_key. Queries may bring what they
    see: ``document_ids`` (a list; null sees all), ``min_date`` and ``max_date``
    (null is open); vectors then have doc_id and created_at, and a vector whose
    date is unknown is seen. ``weight`` multiplies the similarity for ranking.
    A vector meets the queries of its own size; other pairs are skipped.
    """
    return ranked(vectors, queries, k, metric, min_score, unit_scale, weight, group, query_bytes)[0]


def ranked(vectors, queries, k, metric="COSINE", min_score=-math.inf, unit_scale=False, weight=None, group=None,
           query_bytes=QUERY_BYTES, head: pa.Table | None = None) -> tuple[DataFrame, int | None]:
    """``top_scores`` with the most rows it can have; None where the number of queries is not known.

    ``head`` is the query set where the caller has gathered it already.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = _schema(vectors, queries, group)
    arrow_schema = to_arrow_schema(out)
    queries = as_asked(queries, vectors)
    vectors = scanned(vectors, queries, weight, group)
    by = ["query_id"] + ([group] if group else [])
    as_np = lambda c: c.to_numpy() if isinstance(c, pa.ChunkedArray) else c.to_numpy(zero_copy_only=False)

    def run(best, table):
        table = _right_size(table, best.asked.dim)
        if table.num_rows:
            w = as_np(table[weight]) if weight else None
            g = as_np(table[group]) if group else None
            best.add(_arrow_matrix(table["embedding"], best.asked.dim), as_np(table["key"]), w, g, table)

    head = gathered(queries, query_bytes) if head is None else head
    if head is not None and not head.num_rows:
        none = T.StructType([f for f in out if f.name != "lot"] + [T.StructField("rank", T.IntegerType(), False)])
        return vectors.sparkSession.createDataFrame([], none), 0
    if head is not None:
        sent = vectors.sparkSession.sparkContext.broadcast(head)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bests = [_Best(a, k, metric, min_score, unit_scale, DIGITS) for a in by_dimension(sent.value)]
            for batch in batches:
                for best in bests:
                    run(best, batch)
            for best in bests:
                result = _emit(best, TaskContext.get().partitionId(), group, arrow_schema)
                if result is not None:
                    yield result

        return merged(vectors.mapInArrow(scan, out), by, k, scan_tasks(vectors)), None if group else head.num_rows * k

    v_blocks, q_blocks = _grid(vectors.count(), BLOCK_VECTORS), _grid(queries.count(), BLOCK_QUERIES)
    left = vectors.withColumn("vb", F.pmod(F.xxhash64("key"), F.lit(v_blocks))).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)).cast("array<bigint>")))
    right = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks))).withColumn(
        "vb", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1)).cast("array<bigint>")))

    def block(v: pa.Table, q: pa.Table) -> pa.Table:
        found = []
        for asked in by_dimension(q) if v.num_rows and q.num_rows else []:
            best = _Best(asked, k, metric, min_score, unit_scale, DIGITS)
            run(best, v.combine_chunks())
            found.append(_emit(best, v["vb"][0].as_py(), group, arrow_schema))
        return pa.Table.from_batches([f for f in found if f is not None], schema=arrow_schema)

    return merged(left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInArrow(block, out), by, k, v_blocks), None


# --- exact searches ---------------------------------------------------------------


def knn_topk(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "COSINE", min_score: float = -math.inf) -> DataFrame:
    """Exact nearest keys per query: query_id, key, similarity, distance, rank (k rows, or all there are)."""
    return nearest(vectors, queries, k, metric, min_score)[0]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "COSINE", min_score: float = -math.inf,
            head: pa.Table | None = None) -> tuple[DataFrame, int | None]:
    """``knn_topk`` with the most rows it can have, where that is known."""
    best, most = ranked(vectors, queries, k, metric, min_score, head=head)
    distance = -F.col("similarity") if metric == "EUCLIDEAN" else 1.0 - F.col("similarity")
    return best.select("query_id", "key", "similarity", distance.alias("distance"), "rank"), most


def batch_cosine(vectors: DataFrame, query: list[float]) -> DataFrame:
    """cosine01 of one query vector with every row: key, cosine01. Unusable rows score 0."""
    dim = len(query)
    q = np.asarray(query, dtype=np.float64)[None, :]
    out = T.StructType([T.StructField("key", vectors.schema["key"].dataType), T.StructField("cosine01", T.DoubleType())])

    def scan(batches):
        for batch in batches:
            ok = pc.fill_null(pc.equal(pc.list_value_length(batch["embedding"]), dim), False).to_numpy(zero_copy_only=False)
            score = np.zeros(batch.num_rows)
            good = batch.filter(pa.array(ok))
            if good.num_rows:
                cos = block_scores(q, _arrow_matrix(good["embedding"], dim), "COSINE", 15)[0]
                score[ok] = np.where(np.isfinite(cos), np.clip((cos + 1.0) * 0.5, 0.0, 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(score)], names=["key", "cosine01"])

    return vectors.select("key", "embedding").mapInArrow(scan, out)


def centroid(vectors: DataFrame) -> list[float]:
    """Mean vector, summed in tasks; one row of the vector's size reaches the driver."""
    row = vectors.select(Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>"))).alias("m")).first()
    return [float(x) for x in row["m"]]


def search_score(similarity: Column, importance: Column, kind: Column, entities: Column, topic_list: Column) -> Column:
    """Similarity times importance, raised for telling types and for known entities or topics."""
    return (
        similarity * importance
        * F.when(kind.isin(R.BOOSTED_TYPES), 1.1).otherwise(1.0)
        * F.when((F.size(entities) > 0) | (F.size(topic_list) > 0), 1.05).otherwise(1.0)
    )


META = ["key", "doc_id", "chunk_index", "content", "heading", "chunk_type", "key_entities", "topics", "importance_score", "context_summary"]


def attach_metadata(near: DataFrame, vectors: DataFrame, most: int | None = None) -> DataFrame:
    """Metadata for ranked rows. A table without description columns is described here, after the cut.

    ``most`` is the most rows that ``near`` can have, where that is known: up to a
    bound they are sent to the vector table, which then is not shuffled;
    otherwise the two are joined on key.
    """
    if most is not None and most <= NEAR_ROWS:
        near = F.broadcast(near)
    if "importance_score" in vectors.columns:
        return vectors.select(*META).join(near, "key")
    return describe(vectors.select("key", "doc_id", "chunk_index", "content").join(near, "key"))


def similarity_search(vectors: DataFrame, queries: DataFrame, limit: int = 3,
                      threshold: float = R.SINGLE_STAGE_THRESHOLD, head: pa.Table | None = None) -> DataFrame:
    """The k nearest by distance, cut by threshold, re-ranked by score; metadata is joined after the cut.

    Queries may bring filters, as in ``top_scores``.
    """
    near, most = nearest(vectors, queries, limit, min_score=threshold, head=head)
    near = near.withColumn("similarity", similarity_from_distance(F.col("distance"))).filter(F.col("similarity") >= threshold)
    hits = attach_metadata(near.drop("rank"), vectors, most)
    score = search_score(*[F.col(c) for c in ("similarity", "importance_score", "chunk_type", "key_entities", "topics")])
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return hits.withColumn("score", F.round(score, DIGITS)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def full_scan_search(vectors: DataFrame, queries: DataFrame, limit: int, threshold: float) -> DataFrame:
    """cosine01 over the threshold, ranked by cosine01 times importance."""
    best = top_scores(vectors, queries, limit, min_score=threshold, unit_scale=True, weight="importance_score")
    return best.select("query_id", "key", "similarity", F.col("rank_score").alias("score"), "rank")


def partition_search(vectors: DataFrame, queries: DataFrame, limit: int, threshold: float, partition: str) -> DataFrame:
    """Best rows of every partition, then the best of their union."""
    parts = top_scores(vectors, queries, limit, min_score=threshold, unit_scale=True, weight="importance_score", group=partition)
    order = W.partitionBy("query_id").orderBy(F.desc("rank_score"), "key")
    merged = parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return merged.select("query_id", "key", partition, "similarity", F.col("rank_score").alias("score"), "rank")


def metadata_filter(vectors: DataFrame, document_ids: DataFrame | None = None, min_date: str | None = None,
                    max_date: str | None = None) -> DataFrame:
    """Rows of the wanted documents and dates; a row whose date is unknown is kept."""
    if document_ids is not None:
        vectors = vectors.join(document_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    if min_date:
        vectors = vectors.filter(F.coalesce(F.col("created_at") >= F.lit(min_date).cast("timestamp"), F.lit(True)))
    if max_date:
        vectors = vectors.filter(F.coalesce(F.col("created_at") <= F.lit(max_date).cast("timestamp"), F.lit(True)))
    return vectors
