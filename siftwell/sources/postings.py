"""Kept term postings: added to and removed from by document, scored by an equi-join with the terms of the questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import rules as R
from ..functions.text import let, tokens
from .store import ChangeLog

BUCKETS = 64
SENT_TERMS = 200_000  # terms of all questions that are sent to every task


def _counted(words: Column) -> Column:
    """Distinct words of an array with their counts, as (term, tf): runs of the sorted array."""
    def runs(ordered):
        starts = F.filter(F.transform(ordered, lambda w, i: F.when((i == 0) | (w != F.get(ordered, i - 1)), i)), lambda i: i.isNotNull())
        return let(starts, lambda at: F.transform(at, lambda i, n: F.struct(
            F.get(ordered, i).alias("term"), (F.coalesce(F.get(at, n + 1), F.size(ordered)) - i).cast("long").alias("tf"))))

    return let(F.sort_array(words), runs)


class PostingStore(ChangeLog):
    """``postings`` (term, key, tf) by batch and term bucket, ``lengths`` (key, length) by batch; a removal is a length of null.

    A document added again replaces its older text. Of a document the rows of its
    latest batch count. Rows with the same key in one batch are one document.
    """

    def add(self, docs: DataFrame, key: str, text: str) -> int:
        """Add or replace documents: one pass over their texts, nothing stored is read."""
        version = self._claim()
        rows = docs.select(F.col(key).cast("string").alias("key"), tokens(F.col(text)).alias("words"))
        sizes = rows.groupBy("key").agg(F.sum(F.greatest(F.size("words"), F.lit(0))).cast("long").alias("length"))
        sizes.write.parquet(f"{self.path}/lengths/version={version}")
        terms = rows.select("key", F.explode(_counted(F.col("words"))).alias("x")).select("key", "x.term", "x.tf")
        bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
        # a frequent term's postings go to several files; counts of a key that comes in several rows meet where they are written
        spread = F.pmod(F.xxhash64("key"), F.lit(4))
        dealt = terms.withColumns({"bucket": bucket, "spread": spread}).repartition("bucket", "spread")
        terms = dealt.groupBy("bucket", "spread", "key", "term").agg(F.sum("tf").alias("tf"))
        terms.select("key", "term", "tf", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/postings/version={version}")
        self._mark(f"{version:012d}-put")
        return version

    def remove(self, keys: DataFrame, key: str = "key") -> int:
        version = self._claim()
        rows = keys.select(F.col(key).cast("string").alias("key"), F.lit(None).cast("long").alias("length")).distinct()
        rows.write.parquet(f"{self.path}/lengths/version={version}")
        self._mark(f"{version:012d}-delete")
        return version

    def compact(self) -> int:
        """Write what counts as one batch; older batches are not read any more.

        Postings are written where they met the length of their document, and moved no further.
        """
        version, current = self._claim(), self.lengths()
        self._mark(f"{version:012d}-compacting")
        rows = self._postings().join(current, ["key", "version"]).select("key", "term", "tf", "bucket")
        current.select("key", "length").write.parquet(f"{self.path}/lengths/version={version}")
        rows.write.partitionBy("bucket").parquet(f"{self.path}/postings/version={version}")
        self._mark(f"{version:012d}-compact")
        return version

    def lengths(self) -> DataFrame:
        """key, version and length of each document that counts."""
        folders = [f"{self.path}/lengths/version={v}" for v in self._current()]
        if not folders:
            return self.spark.createDataFrame([], "key string, version int, length long")
        rows = self.spark.read.option("basePath", f"{self.path}/lengths").schema("key string, length long, version int").parquet(*folders)
        last = rows.groupBy("key").agg(F.max(F.struct("version", "length")).alias("x"))
        return last.select("key", "x.*").filter("length is not null")

    def _postings(self) -> DataFrame:
        kinds = {c.version: c.kind for c in self.changes()}
        folders = [f"{self.path}/postings/version={v}" for v in self._current() if kinds[v] != "delete"]
        schema = "key string, term string, tf long, version int, bucket int"
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", f"{self.path}/postings").schema(schema).parquet(*folders)

    def stats(self) -> DataFrame:
        """One row: total_docs, total_tokens, avg_length."""
        return self.lengths().agg(F.count(F.lit(1)).alias("total_docs"), F.sum("length").alias("total_tokens"), F.avg("length").alias("avg_length"))

    def bm25(self, queries: DataFrame, limit: int, k1: float = R.BM25_K1, b: float = R.BM25_B) -> DataFrame:
        """The best documents per question over all that are kept: query_id, key, bm25, rank; scores over 0 alone.

        Only postings of the questions' terms are read on from the scan; their
        document frequencies are counted in the same rows.
        """
        asked = queries.select("query_id", F.explode(tokens(F.col("query_text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("uses"))
        wanted = asked.select("term", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket")).distinct()
        hits = self._postings().join(wanted, ["bucket", "term"], "left_semi").join(self.lengths(), ["key", "version"])
        df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("one", F.lit(1))
        df = df.join(F.broadcast(self.stats().withColumn("one", F.lit(1))), "one")  # one row
        weight = F.log((F.col("total_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        df = df.select("term", weight.alias("weight"), "avg_length").join(asked, "term")
        if asked.limit(SENT_TERMS + 1).count() <= SENT_TERMS:
            df = F.broadcast(df)  # then scores are summed where a document's postings met its length
        base = k1 * (1 - b + b * (F.col("length") / F.col("avg_length")))
        part = F.col("uses") * F.col("weight") * (F.col("tf") * (k1 + 1)) / (F.col("tf") + base)
        scored = hits.join(df, "term").groupBy("query_id", "key", "version").agg(F.sum(part).alias("bm25")).filter("bm25 > 0").drop("version")
        order = W.partitionBy("query_id").orderBy(F.round("bm25", 9).desc(), "key")
        return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
