"""Vector table that changes by appending: what a put, a deletion or an expiry costs follows from the change alone.

Below the table's folder, ``rows-<n>`` holds Parquet files bucketed by document,
and ``_log`` a marker file per change. A change claims the next version number,
appends rows that carry it, and counts once its marker is there; a change that
failed leaves rows that no reader sees, and a reader in between sees the state
before. Reading keeps, of each document, the rows of its latest version; buckets
meet without a shuffle. Compaction writes the current rows as a new folder.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .corpus import STORED, VECTOR_BUCKETS, vector_rows

METRICS = ("COSINE", "EUCLIDEAN", "DOT_PRODUCT")
MOST_ROWS = 1_000_000  # a file
DEALT = "dealt"  # metadata of an id column: the number of tasks its rows are dealt to by it


@dataclass(frozen=True)
class Change:
    version: int
    kind: str  # put, delete, expire or compact
    bound: int = 0  # of an expiry: microseconds since 1970


class ChangeLog:
    """Marker files below ``_log`` of a table's folder: claimed version numbers, and the changes that count."""

    KINDS = ("put", "delete", "expire", "compact")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self) -> list[str]:
        folder = self._path(f"{self.path}/_log")
        return [s.getPath().getName() for s in self._files.listStatus(folder)] if self._files.exists(folder) else []

    def _mark(self, name: str) -> bool:
        return self._files.createNewFile(self._path(f"{self.path}/_log/{name}"))

    def _claim(self) -> int:
        """A version number of one's own: creating a file succeeds for one writer only."""
        names = self._names()
        if any(n.endswith("-compacting") and n.replace("-compacting", "-compact") not in names for n in names):
            raise RuntimeError(f"{self.path} is being compacted")
        version = 1 + max((int(n.split("-")[0]) for n in names if n[0].isdigit()), default=0)
        while not self._mark(f"{version:012d}-claim"):
            version += 1
        return version

    def changes(self) -> list[Change]:
        """Changes that count, oldest first."""
        parts = [n.split("-") for n in sorted(self._names()) if n[0].isdigit()]
        return [Change(int(p[0]), p[1], int(p[2]) if len(p) > 2 else 0) for p in parts if p[1] in self.KINDS]

    def _generation(self, changes: list[Change]) -> int:
        """Version of the last compaction; what is older is not read."""
        return max((c.version for c in changes if c.kind == "compact"), default=0)

    def _current(self) -> list[int]:
        """Versions to read."""
        changes = self.changes()
        last = self._generation(changes)
        return [c.version for c in changes if c.version >= last and c.kind != "expire"]


class VectorStore(ChangeLog):
    """An existing table; ``create`` makes one. A document is replaced, deleted and read as a whole.

    The table records the dimension and the metric of its vectors; rows of another
    dimension are not stored, ``misfits`` returns them. Buckets hold whole
    documents, whose size the readers of ``corpus`` bound.
    """

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path)
        spec = [n for n in self._names() if n.startswith("spec-")]
        if not spec:
            raise FileNotFoundError(f"{path} holds no vector table")
        _, dim, self.metric, buckets = spec[0].split("-")
        self.dim, self.buckets = int(dim), int(buckets)

    @classmethod
    def create(cls, spark: SparkSession, path: str, dim: int = 0, metric: str = "COSINE", buckets: int = VECTOR_BUCKETS) -> VectorStore:
        """An empty table; an existing one is left as it is and returned. Dimension 0 takes vectors of any size."""
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_log")
        files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if not files.exists(folder):
            files.createNewFile(spark._jvm.org.apache.hadoop.fs.Path(folder, f"spec-{int(dim)}-{metric}-{int(buckets)}"))
        return cls(spark, path)

    # --- the rows ---

    def _table(self, generation: int, fresh: bool = False) -> str:
        """Name of the bucketed table over a folder of rows; the catalog of the session only points at the files."""
        folder = f"{self.path}/rows-{generation}"
        name = "vectors_" + hashlib.sha256(folder.encode()).hexdigest()[:24]
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({STORED}, version BIGINT, gone BOOLEAN) USING parquet "
            f"CLUSTERED BY (doc_id) SORTED BY (doc_id) INTO {self.buckets} BUCKETS LOCATION '{folder}'"
        )
        if fresh:
            self.spark.catalog.refreshTable(name)
        return name

    def _append(self, rows: DataFrame, generation: int, version: int) -> None:
        """``rows`` should be dealt by document into as many tasks as there are buckets, or a multiple, for few files."""
        table = self._table(generation)
        for c, kind in self.spark.table(table).dtypes:
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast(kind))
        rows = rows.withColumns({"version": F.lit(version).cast("long"), "gone": F.coalesce("gone", F.lit(False))})
        rows.select(*self.spark.table(table).columns).write.option("maxRecordsPerFile", MOST_ROWS).insertInto(table)

    def _fits(self) -> Column:
        return F.lit(True) if not self.dim else F.size("embedding") == self.dim

    def misfits(self, chunks: DataFrame) -> DataFrame:
        """Rows that ``put`` leaves out: key and the dimension of their vector."""
        return vector_rows(chunks).filter(~self._fits()).select("key", F.size("embedding").alias("dimension"))

    def put(self, chunks: DataFrame, gone: DataFrame | None = None) -> int:
        """Store the documents of ``chunks`` and drop those that ``gone`` names (doc_id); returns the version.

        A document stored before is replaced. Of rows with the same key the one
        created last is stored, ties by content. The cost is one shuffle of the
        change, and none where ``deal`` did it before; nothing stored is read or rewritten.
        """
        dealt = sum(f.metadata.get(DEALT, 0) for f in chunks.schema if f.name == "doc_id")
        version = self._claim()
        rows = vector_rows(chunks).filter(self._fits()).withColumn("gone", F.lit(False))
        if gone is not None:
            marks = gone.select(F.col("doc_id").cast("string").alias("doc_id")).distinct().withColumn("gone", F.lit(True))
            rows = rows.unionByName(marks, allowMissingColumns=True)
        order = W.partitionBy("doc_id", "key").orderBy(F.desc_nulls_last("created_at"), "content", F.xxhash64("embedding"))
        if gone is not None or not dealt or dealt % self.buckets:
            rows = rows.repartition(self.buckets, "doc_id")
        rows = rows.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")
        self._append(rows, self._generation(self.changes()), version)
        self._mark(f"{version:012d}-put")
        return version

    def delete(self, ids: DataFrame) -> int:
        """Drop the documents named by ``ids`` (doc_id): a mark per document is appended."""
        version = self._claim()
        marks = ids.select(F.col("doc_id").cast("string").alias("doc_id")).distinct().withColumn("gone", F.lit(True))
        self._append(marks.repartition(self.buckets, "doc_id"), self._generation(self.changes()), version)
        self._mark(f"{version:012d}-delete")
        return version

    def expire(self, as_of: str, days: int) -> int:
        """Drop rows stored so far that were created more than ``days`` before ``as_of``; rows without a date stay.

        Only the bound is recorded; it reaches the scan as a filter, and compaction drops the rows.
        """
        version = self._claim()
        bound = self.spark.sql(f"SELECT unix_micros(TIMESTAMP '{as_of}' - INTERVAL {int(days)} DAYS)").first()[0]
        self._mark(f"{version:012d}-expire-{bound}")
        return version

    def read(self) -> DataFrame:
        """The current rows."""
        return self._state().drop("version", "gone")

    def _state(self) -> DataFrame:
        changes = self.changes()
        generation = self._generation(changes)
        since = [c for c in changes if c.version >= generation]
        writes = [c.version for c in since if c.kind in ("put", "delete", "compact")]
        rows = self.spark.table(self._table(generation, fresh=True))
        open_ = {int(n.split("-")[0]) for n in self._names() if n.endswith("-claim")} - {c.version for c in changes}
        rows = rows.filter(F.col("version") <= max(writes, default=0))
        if failed := sorted(v for v in open_ if v < max(writes, default=0)):
            rows = rows.filter(~F.col("version").isin(failed))
        if len(writes) > 1:
            latest = rows.groupBy("doc_id").agg(F.max("version").alias("latest"))
            # an inequality stays out of the join's keys, which are those of the buckets
            rows = rows.join(latest.hint("shuffle_hash"), "doc_id").filter(F.col("version") >= F.col("latest")).drop("latest")
        rows = rows.filter(~F.col("gone"))
        for c in since:
            if c.kind == "expire":
                kept = F.coalesce(F.col("created_at") >= F.timestamp_micros(F.lit(c.bound)), F.lit(True))
                rows = rows.filter(kept | (F.col("version") > c.version))
        return rows

    def compact(self) -> int:
        """Write the current rows alone, sorted by document, into a folder of their own; readers turn to it when it is whole.

        Puts are refused meanwhile. Folders that nothing reads any more go with ``vacuum``.
        """
        version = self._claim()
        self._mark(f"{version:012d}-compacting")
        rows = self._state().drop("version").repartition(self.buckets, "doc_id")
        self._append(rows, version, version)
        self._mark(f"{version:012d}-compact")
        return version

    def vacuum(self) -> None:
        """Delete folders of rows before the last compaction. No reader of an earlier state may be under way."""
        last = self._generation(self.changes())
        for status in self._files.listStatus(self._path(self.path)):
            name = status.getPath().getName()
            if name.startswith("rows-") and int(name[5:]) < last:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._table(int(name[5:]))}")
                self._files.delete(status.getPath(), True)


class KeyedTable(ChangeLog):
    """The last row per key of a stream of updates: updates are appended, and merged into one folder every few of them."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], every: int = 20):
        super().__init__(spark, path)
        self.keys, self.every = keys, every

    def _rows(self, versions: list[int]) -> DataFrame:
        rows = self.spark.read.option("basePath", self.path).parquet(*[f"{self.path}/version={v}" for v in versions])
        last = [c for c in rows.columns if c not in (*self.keys, "version")]
        merged = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*last), "version").alias("row"))
        return merged.select(*self.keys, "row.*")

    def read(self) -> DataFrame:
        """One row per key: those of the last merged folder and of the updates since."""
        return self._rows(self._current())

    def upsert(self, rows: DataFrame) -> None:
        """Rows that replace those of the same keys; a key may come once in them. Every ``every`` updates all are merged."""
        version = self._claim()
        rows.write.mode("overwrite").parquet(f"{self.path}/version={version}")
        self._mark(f"{version:012d}-put")
        if len(self._current()) > self.every:
            self.compact()

    def compact(self) -> None:
        """Write one row per key as a folder of its own; older folders are not read any more and go once nobody reads them."""
        version, held = self._claim(), self._current()
        self._mark(f"{version:012d}-compacting")
        self._rows(held).write.mode("overwrite").parquet(f"{self.path}/version={version}")
        self._mark(f"{version:012d}-compact")


def deal(documents: DataFrame, tasks: int, buckets: int = VECTOR_BUCKETS) -> DataFrame:
    """Documents by their id, as the table stores it, to ``tasks`` tasks at least, each with documents of one bucket.

    Chunks made of them can be put without a shuffle, and a task holds its share
    of the documents instead of a whole bucket.
    """
    n = buckets * -(-tasks // buckets)
    named = documents.withColumn("doc_id", F.col("doc_id").cast("string").alias("doc_id", metadata={DEALT: n}))
    return named.repartition(n, "doc_id")


def put_vectors(chunks: DataFrame, path: str, gone: DataFrame | None = None, dim: int = 0) -> int:
    """Store documents by key in the table at ``path``, which is made if there is none."""
    return VectorStore.create(chunks.sparkSession, path, dim).put(chunks, gone)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return VectorStore(spark, path).read()
