"""Approximate search: a stored index of cells, and random-projection buckets.

The cell index keeps every vector in the files of its nearest centroid, so a
search reads the folders of the cells it visits and no others. Its centroids are
fitted on a training set of bounded size. The bucket index keeps whole numbers
only; embeddings are fetched once, for what was found.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..functions.vectors import block_scores, valid_embedding
from ..session import scratch_path
from . import vector as V

TRAIN_ROWS = 100_000  # bound of the training set; nothing else of the index depends on it
TRAIN_PER_CELL = 20  # training rows that a cell needs at least
CELL_FILE_ROWS = 500_000
INDEX = ["key", "embedding", "importance_score", "doc_id", "created_at"]


# --- cells ------------------------------------------------------------------------------


def _fit(rows: DataFrame, n: int, iterations: int, seed: int) -> list[list[float]]:
    """Centroids by cosine distance of a bounded frame of embeddings."""
    if n <= 1:
        return [V.centroid(rows)]
    data = rows.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=n, seed=seed, maxIter=iterations, distanceMeasure="cosine").fit(data)
    return [[float(x) for x in c] for c in model.clusterCenters()]


def _nearest(matrix: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Place of the nearest centroid by cosine, the first of equals."""
    out = np.empty(len(matrix), np.int64)
    step = max(1, V.TILE_CELLS // len(centers))
    for at in range(0, len(matrix), step):
        out[at : at + step] = np.argmax(block_scores(matrix[at : at + step], centers, "COSINE", 12), axis=1)
    return out


def assign_cells(vectors: DataFrame, centers: list[list[float]]) -> DataFrame:
    """Every usable vector of the centroids' size, with the id of its nearest one."""
    from pyspark.sql.pandas.types import to_arrow_schema

    dim = len(centers[0])
    rows = vectors.filter(valid_embedding(F.col("embedding"), dim))
    out = T.StructType([*rows.schema.fields, T.StructField("cell_id", T.IntegerType())])
    schema = to_arrow_schema(out)
    sent = vectors.sparkSession.sparkContext.broadcast(np.array(centers))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = _nearest(V._arrow_matrix(batch["embedding"], dim), sent.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], schema=schema)

    return rows.mapInArrow(assign, out)


def build_cells(vectors: DataFrame, cell_size: int = 1000, fan_out: int = 10, iterations: int = 10, seed: int = 7,
                train_rows: int = TRAIN_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two levels of centroids: (vectors with cell_id, cells, tops).

    There is a cell for every ``cell_size`` vectors, as far as a training set of
    about ``train_rows`` vectors, chosen by a hash of the key, can fit them
    (``TRAIN_PER_CELL`` each); beyond that cells hold more vectors. All vectors
    are assigned. So centroids are few enough to be sent to every task.
    """
    spark = vectors.sparkSession
    usable = vectors.filter(valid_embedding(F.col("embedding")))
    n = usable.count()
    n_cells = max(1, min(math.ceil(n / cell_size), train_rows // TRAIN_PER_CELL))
    share = min(1.0, train_rows / max(n, 1))
    chosen = usable.filter(F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1 << 30)) < int(share * (1 << 30))).select("embedding")
    schema = "embedding array<double>"
    if not n:
        empty = spark.createDataFrame([], f"cell_id int, {schema}, top_id int")
        return vectors.limit(0).withColumn("cell_id", F.lit(0)), empty, spark.createDataFrame([], f"top_id int, {schema}")
    centers = _fit(chosen, n_cells, iterations, seed)
    tops = _fit(spark.createDataFrame([(c,) for c in centers], schema), math.ceil(len(centers) / fan_out), iterations, seed)
    above = _nearest(np.array(centers), np.array(tops))
    cells = spark.createDataFrame([(i, c, int(a)) for i, (c, a) in enumerate(zip(centers, above))], f"cell_id int, {schema}, top_id int")
    return assign_cells(vectors, centers), cells, spark.createDataFrame(list(enumerate(tops)), f"top_id int, {schema}")


def store_cells(vectors: DataFrame, path: str, cell_size: int = 1000, fan_out: int = 10, iterations: int = 10, seed: int = 7,
                train_rows: int = TRAIN_ROWS, file_rows: int = CELL_FILE_ROWS) -> None:
    """Write the index: ``rows`` in a folder per cell, ``cells`` with their sizes, ``tops``.

    Rows keep key, embedding and, where there, importance, document and date. A
    large cell is cut into files of about ``file_rows`` by a hash of the key, so
    it is written by several tasks.
    """
    spark = vectors.sparkSession
    rows = vectors.select(*[c for c in INDEX if c in vectors.columns])
    assigned, cells, tops = build_cells(rows, cell_size, fan_out, iterations, seed, train_rows)
    staged = scratch_path(spark, "assigned")
    assigned.write.parquet(staged)
    assigned = spark.read.parquet(staged)
    sizes = assigned.groupBy("cell_id").agg(F.count(F.lit(1)).alias("vectors"))
    cells.join(sizes, "cell_id", "left").fillna(0, ["vectors"]).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    tops.coalesce(1).write.mode("overwrite").parquet(f"{path}/tops")
    lots = F.ceil(F.col("vectors") / file_rows)
    dealt = assigned.join(F.broadcast(sizes), "cell_id").withColumn("lot", F.pmod(F.xxhash64("key"), lots)).drop("vectors")  # a row per centroid
    dealt.repartition("cell_id", "lot").drop("lot").write.mode("overwrite").partitionBy("cell_id").parquet(f"{path}/rows")


class Visits:
    """The cells that each query of a set visits: of the best ``beam`` tops the best ``2 * beam`` cells; all cells without a beam."""

    def __init__(self, asked: V.Asked, cells: list, tops: list, beam: int | None):
        self.asked = asked
        cells = [c for c in cells if len(c.embedding) == asked.dim]
        self.ids = np.array([c.cell_id for c in cells], np.int64)
        seen = np.ones((len(asked.ids), len(cells)), bool)
        if beam is not None and cells:
            by_top = block_scores(asked.matrix, np.array([t.embedding for t in tops]), "COSINE", V.DIGITS)
            good = np.zeros_like(by_top, bool)
            np.put_along_axis(good, np.argsort(-by_top, axis=1, kind="stable")[:, :beam], True, axis=1)
            score = block_scores(asked.matrix, np.array([c.embedding for c in cells]), "COSINE", V.DIGITS)
            score[~good[:, [c.top_id for c in cells]]] = -np.inf
            seen = np.zeros_like(score, bool)
            np.put_along_axis(seen, np.argsort(-score, axis=1, kind="stable")[:, : 2 * beam], True, axis=1)
            seen &= np.isfinite(score)
        self.by_cell = {int(c): np.flatnonzero(seen[:, i]) for i, c in enumerate(self.ids) if seen[:, i].any()}


def stored_search(spark: SparkSession, path: str, queries: DataFrame, limit: int, threshold: float, beam: int | None = 10,
                  metric: str = "COSINE", unit_scale: bool = True, weight: str | None = "importance_score") -> DataFrame:
    """The best rows per query among the cells it visits: query_id, key, similarity, score, rank.

    Only the folders of visited cells are read, and rows are scored where they are
    read; no vector is shuffled. Every vector of a visited cell counts. Without a
    beam all cells are visited and the result is that of the exact search. Queries
    may bring filters, as in ``vector.top_scores``. A query set over the bounds of
    ``vector.gathered`` is searched in several scans, a bounded part at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = spark.read.parquet(f"{path}/rows")
    cells, tops = spark.read.parquet(f"{path}/cells").orderBy("cell_id").collect(), spark.read.parquet(f"{path}/tops").orderBy("top_id").collect()
    asked = V.as_asked(queries, rows)
    out = V._schema(rows, queries, None)
    schema = to_arrow_schema(out)
    read = V.scanned(rows, asked, weight, "cell_id")

    def search(part: pa.Table) -> DataFrame:
        sent = spark.sparkContext.broadcast(part)
        visits = [Visits(a, cells, tops, beam) for a in V.by_dimension(part)]
        wanted = sorted(set().union(*[v.by_cell for v in visits])) if visits else []
        by_dim = {v.asked.dim: v.by_cell for v in visits}

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bests = [V._Best(a, limit, metric, threshold, unit_scale, V.DIGITS) for a in V.by_dimension(sent.value)]
            for batch in batches:
                for best in bests:
                    mine = V._right_size(batch, best.asked.dim)
                    cell = mine["cell_id"].to_numpy(zero_copy_only=False)
                    for c in np.unique(cell):
                        only = by_dim[best.asked.dim].get(int(c))
                        if only is None:
                            continue
                        own = mine.filter(pa.array(cell == c))
                        w = own[weight].to_numpy(zero_copy_only=False) if weight else None
                        best.add(V._arrow_matrix(own["embedding"], best.asked.dim), own["key"].to_numpy(zero_copy_only=False), w, None, own, only)
            for best in bests:
                result = V._emit(best, TaskContext.get().partitionId(), None, schema)
                if result is not None:
                    yield result

        return read.filter(F.col("cell_id").isin(wanted)).mapInArrow(scan, out)

    head = V.gathered(asked, V.QUERY_BYTES)
    if head is not None:
        parts = [head]
    else:
        size = asked.agg(F.count(F.lit(1)), F.max(F.size("embedding")), F.sum(F.size("document_ids")) if "document_ids" in asked.columns else F.lit(0)).first()
        n = max(2, math.ceil(size[0] / V.BLOCK_QUERIES), math.ceil(size[0] * (size[1] or 1) * 8 / V.QUERY_BYTES))
        n = max(n, math.ceil(math.sqrt(max(0, size[2] or 0) * size[0] / 8 / V.QUERY_BYTES)))
        parts = (asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).toArrow() for i in range(n))
    partial = None
    for part in parts:
        if part.num_rows:
            found = search(part)
            partial = found if partial is None else partial.unionByName(found)
    if partial is None:
        partial = spark.createDataFrame([], out)
    best = V.merged(partial, ["query_id"], limit, V.scan_tasks(read))
    return best.select("query_id", "key", "similarity", F.col("rank_score").alias("score"), "rank")


# --- buckets ------------------------------------------------------------------------------


def _projections(dim: int, tables: int, hashes: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * hashes))


def _places(matrix: np.ndarray, width: float, tables: int, hashes: int, seed: int) -> np.ndarray:
    """Coordinates on the random projections, in bucket widths: rows x tables x hashes. Only the direction of a vector counts."""
    unit = matrix / np.linalg.norm(matrix, axis=1)[:, None]
    return (unit @ _projections(matrix.shape[1], tables, hashes, seed) / width).reshape(len(matrix), tables, hashes)


def _bucket(cells: np.ndarray, dim: int) -> np.ndarray:
    """One whole number per table for the coordinates of a bucket; unlike buckets that share a number only cost candidates."""
    out = np.full(cells.shape[:-1], dim, np.uint64)
    for h in range(cells.shape[-1]):
        out = (out ^ cells[..., h].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _own_buckets(matrix: np.ndarray, width: float, tables: int, hashes: int, seed: int) -> np.ndarray:
    """The bucket of each row in each table."""
    return _bucket(np.floor(_places(matrix, width, tables, hashes, seed)), matrix.shape[1])


def bucket_postings(vectors: DataFrame, width: float = 0.5, tables: int = 6, hashes: int = 2, seed: int = 7) -> DataFrame:
    """tab, bucket, key: where each usable vector lies. Whole numbers and keys only."""
    rows = vectors.filter(valid_embedding(F.col("embedding"))).select("key", "embedding")
    kind = rows.schema["key"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch["embedding"].value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(size):
                own = batch.filter(pa.array(size == dim))
                bucket = _own_buckets(V._arrow_matrix(own["embedding"], int(dim)), width, tables, hashes, seed)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), t), pa.int32()), pa.array(bucket[:, t]), own["key"]], ["tab", "bucket", "key"])

    return rows.mapInArrow(place, f"tab int, bucket long, key {kind}")


def bucket_probes(queries: DataFrame, probes: int = 8, width: float = 0.5, tables: int = 6, hashes: int = 2, seed: int = 7) -> DataFrame:
    """tab, bucket, query_id: the ``probes`` buckets per table that are nearest to each query, its own first.

    A neighbour differs by one in some coordinates; its distance is the sum of the
    squared distances to the borders that lie between.
    """
    rows = queries.filter(valid_embedding(F.col("embedding"))).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    kind = rows.schema["query_id"].dataType.simpleString()
    steps = np.array(np.meshgrid(*[[0, -1, 1]] * hashes)).T.reshape(-1, hashes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch["embedding"].value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(size):
                own = batch.filter(pa.array(size == dim))
                at = _places(V._arrow_matrix(own["embedding"], int(dim)), width, tables, hashes, seed)
                low = np.floor(at)
                border = np.stack([np.zeros_like(at), at - low, low + 1 - at])  # to step 0, -1, +1
                far = sum(border[steps[:, h], :, :, h] ** 2 for h in range(hashes))  # steps x rows x tables
                order = np.argsort(far, axis=0, kind="stable")[:probes]
                for t in range(tables):
                    for take in order[:, :, t]:
                        bucket = _bucket((low[:, t] + steps[take])[:, None], int(dim))[:, 0]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(own), t), pa.int32()), pa.array(bucket), own["query_id"]], ["tab", "bucket", "query_id"])

    return rows.mapInArrow(place, f"tab int, bucket long, query_id {kind}")


class _Probed(V.Asked):
    """Queries that see the rows in the buckets they probe; ``probes`` has tab, bucket and query_id."""

    def __init__(self, table: pa.Table, dim: int, probes: pa.Table, buckets: Callable[[np.ndarray], np.ndarray]):
        super().__init__(table, dim)
        self.buckets, self.by_tab = buckets, {}
        ids = pa.table({"query_id": table["query_id"], "place": np.arange(len(self.ids))})
        placed = probes.join(ids, "query_id", join_type="inner")
        tab, bucket, place = (placed[c].to_numpy() for c in ("tab", "bucket", "place"))
        for t in np.unique(tab):
            mine = np.flatnonzero(tab == t)
            mine = mine[np.argsort(bucket[mine], kind="stable")]
            known, first, size = np.unique(bucket[mine], return_index=True, return_counts=True)
            self.by_tab[int(t)] = known, first, size, place[mine]

    def allowed(self, rows: pa.Table | pa.RecordBatch) -> np.ndarray:
        own = self.buckets(V._arrow_matrix(rows["embedding"], self.dim))
        seen = np.zeros((len(self.ids), len(own)), bool)
        for t, (known, first, size, place) in self.by_tab.items():
            at = np.minimum(np.searchsorted(known, own[:, t]), len(known) - 1)
            hit = np.flatnonzero(known[at] == own[:, t])
            at = at[hit]
            row = np.repeat(hit, size[at])
            nth = np.arange(len(row)) - np.repeat(np.cumsum(size[at]) - size[at], size[at])
            seen[place[np.repeat(first[at], size[at]) + nth], row] = True
        return seen


def _probe_scan(vectors: DataFrame, head: pa.Table, probes: DataFrame, limit: int, threshold: float, width: float, tables: int,
                hashes: int, seed: int, out: T.StructType) -> DataFrame:
    """``lsh_search`` of a bounded query set: rows meet the probes where they are scanned, and no candidate is shuffled."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(out)
    rows = vectors.filter(valid_embedding(F.col("embedding")) & F.col("key").isNotNull()).select("key", "embedding")
    sent = rows.sparkSession.sparkContext.broadcast((head, probes.toArrow()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, probed = sent.value
        size = pc.list_value_length(asked["embedding"]).to_numpy()
        buckets = lambda matrix: _own_buckets(matrix, width, tables, hashes, seed)
        bests = [V._Best(_Probed(asked.filter(pa.array(size == dim)), int(dim), probed, buckets), limit, "COSINE", threshold, False, V.DIGITS)
                 for dim in np.unique(size)]
        for batch in batches:
            for best in bests:
                own = V._right_size(batch, best.asked.dim)
                if own.num_rows:
                    best.add(V._arrow_matrix(own["embedding"], best.asked.dim), own["key"].to_numpy(zero_copy_only=False), None, None, own)
        for best in bests:
            result = V._emit(best, TaskContext.get().partitionId(), None, schema)
            if result is not None:
                yield result

    best = V.merged(rows.mapInArrow(scan, out), ["query_id"], limit, V.scan_tasks(rows))
    return best.select("query_id", "key", "similarity", "rank")


def lsh_search(vectors: DataFrame, queries: DataFrame, limit: int, threshold: float = -math.inf, width: float = 0.5, tables: int = 6,
               hashes: int = 2, probes: int = 8, seed: int = 7, postings: DataFrame | None = None) -> DataFrame:
    """Approximate neighbours by cosine: rows in one of the buckets that a query probes: query_id, key, similarity, rank.

    ``postings`` may be a stored result of ``bucket_postings`` with the same
    numbers. A query set within the bounds of ``vector.gathered`` is sent to the
    scan of the vectors, unless postings are given. Else candidates are gathered
    per key, so an embedding is fetched once, however many tables and queries
    found it.
    """
    asked = bucket_probes(queries, probes, width, tables, hashes, seed)
    small = V.gathered(V.as_asked(queries, vectors).filter("query_id is not null"), V.QUERY_BYTES)
    if postings is None and small is not None and small.num_rows:
        return _probe_scan(vectors, small, asked, limit, threshold, width, tables, hashes, seed, V._schema(vectors, queries, None))
    postings = bucket_postings(vectors, width, tables, hashes, seed) if postings is None else postings
    pairs = postings.join(asked, ["tab", "bucket"]).select("key", "query_id").distinct()
    if "exclude_key" in queries.columns:
        own = queries.select("query_id", F.col("exclude_key").alias("key"))
        pairs = pairs.join(own, ["query_id", "key"], "left_anti")
    unit = lambda c: F.transform(F.col(c).cast("array<double>"), lambda x: x / _length(F.col(c)))
    found = pairs.groupBy("key").agg(F.collect_set("query_id").alias("query_ids"))  # queries, not vectors, bound the list
    found = found.join(vectors.select("key", "embedding"), "key").select("key", unit("embedding").alias("x"), F.explode("query_ids").alias("query_id"))
    sides = queries.select("query_id", unit("embedding").alias("y"))
    if small is not None:
        sides = F.broadcast(sides)
    found = found.join(sides, "query_id").filter(F.size("x") == F.size("y"))
    score = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda acc, p: acc + p)
    found = found.select("query_id", "key", F.round(score, V.DIGITS).alias("similarity")).filter(F.col("similarity") >= threshold)
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def _length(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector.cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x * x))
