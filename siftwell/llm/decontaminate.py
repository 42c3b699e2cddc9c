"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, then exact weighted-shingle similarity."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, free_name, hold


@dataclass(frozen=True)
class Match:
    """What counts as a copy of an item, and how many shingles of items are sent to the tasks at once."""

    words: int = 5  # of a shingle; an item with fewer words is one shingle
    similarity: float = 0.8
    radius: int = 24  # of 64 bits; windows at the similarity differ in 10 bits on average, with a deviation of 3
    blocks: int = 8
    shingles_sent: int = 500_000  # a larger benchmark is searched in several blocks of items


def words_of(text: Column) -> Column:
    """Runs of letters, marks and digits in lower case, so that case and punctuation do not hide a copy."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), "")


def shingles(words: Column, k: int) -> Column:
    """64-bit hashes of all runs of k words; empty if there are fewer."""

    def of(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
        return F.when(F.size(h) >= k, runs).otherwise(F.array().cast("array<long>"))

    return bound(F.transform(words, lambda w: F.xxhash64(w)), of)


def simhash(hashes: Column) -> Column:
    """64-bit SimHash: a bit is 1 if set in over half of the hashes, each weighted by its repeats.

    Bits 32 apart are counted in the halves of one long, so 32 sums give all counts.
    """
    shifted = lambda x, k: F.call_function("shiftrightunsigned", x, k)
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    zero = F.array_repeat(F.lit(0).cast("long"), 32)
    add = lambda counts, h: F.transform(
        counts, lambda c, k: c + shifted(h, k).bitwiseAND(F.lit(0x0000000100000001))
    )

    def vote(counts: Column) -> Column:
        low = lambda c, k: F.when(c.bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.size(hashes), bit(k)).otherwise(F.lit(0).cast("long"))
        bits = F.transform(counts, lambda c, k: low(c, k) + low(shifted(c, F.lit(32)), k + 32))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))

    return F.aggregate(hashes, zero, add, vote)


def within(a: Column, b: Column, how: Match) -> Column:
    """Fingerprints at most ``radius`` apart, found by blocks: one block of theirs must differ in radius / blocks bits at most."""
    width = 64 // how.blocks
    differ = a.bitwiseXOR(b)
    blocks = [F.bit_count(F.shiftrightunsigned(differ, i * width).bitwiseAND(F.lit((1 << width) - 1))) for i in range(how.blocks)]
    any_block = blocks[0] <= how.radius // how.blocks
    for x in blocks[1:]:
        any_block = any_block | (x <= how.radius // how.blocks)
    return any_block & (F.bit_count(differ) <= how.radius)


def numbered(hashes: Column) -> Column:
    """Hashes that tell repeats apart: the second occurrence of a shingle differs from the first."""
    return F.transform(hashes, lambda x, i: F.xxhash64(x, F.size(F.filter(F.slice(hashes, F.lit(1), i), lambda y: y == x))))


def _items(benchmark: DataFrame, item: str, text: str, how: Match) -> DataFrame:
    items = benchmark.select(F.col(item).alias("item"), words_of(F.col(text)).alias("w")).filter(F.size("w") > 0)
    items = items.withColumn("k", F.least(F.size("w"), F.lit(how.words)))
    hashes = F.coalesce(*[F.when(F.col("k") == k, shingles(F.col("w"), k)) for k in range(1, how.words + 1)])
    items = items.select("item", "k", hashes.alias("b")).distinct()
    items = items.select("item", "k", "b", F.xxhash64("item", "k", "b").alias("i"), F.size("b").alias("n"))
    items = items.withColumn("ifp", simhash(F.col("b"))).withColumn("bn", numbered(F.col("b")))
    # a window as similar as asked has this many places without a shingle of the item, at most
    least = F.ceil(F.lit(2 * how.similarity / (1 + how.similarity)) * F.col("n") - F.lit(1e-9))
    return items.withColumn("slack", (F.col("n") - least).cast("int"))


def find(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", how: Match = Match()
) -> DataFrame:
    """Copies of benchmark items in documents: key, item, similarity, start (word) and distance of the most similar window.

    Every window of a document that is as long as an item and shares a shingle
    with it near its beginning is fingerprinted; a window as similar as asked has
    a shingle of the item among its first ``slack + 1`` places, so none is
    missed there. Fingerprints within the radius are found by blocks, and the
    weighted Jaccard similarity of the shingles (weights: repeats) decides. A
    document shorter than an item is one window.

    Null or empty texts and items without words match nothing; rows with the same
    key are reported together, rows without a key as one null key; items with the
    same id and different texts are each searched, and the best is reported. Only
    the named columns are read. The benchmark is read once on the driver's side of
    the plan: its shingles are sent to the tasks, at most ``shingles_sent`` at a
    time. Document texts are never shuffled, only what matches.
    """
    items = _items(benchmark, item, text, how)
    sizes = items.groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").collect()  # one row per shingle width
    found = None
    for k, total in ((r["k"], r["n"]) for r in sizes):
        parts = math.ceil(total / how.shingles_sent)
        for part in range(parts):
            mine = items.filter((F.col("k") == k) & (F.pmod(F.col("i"), F.lit(parts)) == part))
            hits = _search(docs, mine, k, key, text, how)
            found = hits if found is None else found.unionByName(hits)
    if found is None:
        kinds = dict(docs.select(F.col(key).alias("k")).dtypes) | dict(benchmark.select(F.col(item).alias("i")).dtypes)
        schema = f"doc {kinds['k']}, item {kinds['i']}, similarity double, start int, distance int"
        found = docs.sparkSession.createDataFrame([], schema)
    best = found.groupBy("doc", "item").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("late"), (-F.col("distance")).alias("far"))).alias("x")
    )
    return best.select(
        F.col("doc").alias(key), F.col("item").alias(item), F.col("x.similarity").alias("similarity"),
        (-F.col("x.late")).alias("start"), (-F.col("x.far")).alias("distance"),
    )


def _search(docs: DataFrame, items: DataFrame, k: int, key: str, text: str, how: Match) -> DataFrame:
    rows = docs.select(F.col(key).alias("doc"), words_of(F.col(text)).alias("w")).select("doc", shingles(F.col("w"), k).alias("h"))
    rows = rows.select("doc", "h", F.posexplode_outer("h").alias("pos", "s"))  # outer: no filter that computes h twice
    index = items.select("i", F.explode(F.array_distinct("b")).alias("s"))
    hits = rows.join(F.broadcast(index), "s").drop("s")  # at most shingles_sent rows
    hits = hits.join(F.broadcast(items), "i")  # fewer rows than index
    low = F.greatest(F.lit(0), F.col("pos") - F.col("slack"))
    high = F.least(F.col("pos"), F.greatest(F.lit(0), F.size("h") - F.col("n")))
    hits = hits.withColumns({"low": low, "high": high}).filter("high >= low")
    hits = hits.withColumn("near", F.slice("h", F.col("low") + 1, F.col("high") - F.col("low") + F.col("n"))).drop("h")
    starts = hits.withColumn("start", F.explode(F.sequence("low", "high")))
    before = F.slice("near", F.col("start") - F.col("low") + 1, F.col("pos") - F.col("start"))
    b = F.col("b")
    starts = starts.filter(F.forall(before, lambda x: ~F.array_contains(b, x)))  # each window once, at its first hit
    windows = starts.withColumn("win", F.slice("near", F.col("start") - F.col("low") + 1, F.col("n"))).drop("near")
    windows = hold(windows.withColumn("fp", simhash(F.col("win"))), "fp")
    windows = windows.filter(within(F.col("fp"), F.col("ifp"), how))
    windows = windows.withColumn("wn", numbered(F.col("win")))
    windows = windows.withColumn("both", F.size(F.array_intersect("wn", "bn")))
    similarity = F.col("both") / (F.size("win") + F.col("n") - F.col("both"))
    windows = hold(windows.withColumn("similarity", similarity), "similarity").filter(F.col("similarity") >= how.similarity)
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp")))
    return windows.select("doc", "item", "similarity", "start", distance.cast("int").alias("distance"))


def drop_copies(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", how: Match = Match()
) -> DataFrame:
    """The documents without a copy of an item, with their own columns.

    A row is known by its key and its text, so a row stays whose key stands beside
    a copy elsewhere; a null key is one like any other. An empty table, or a
    benchmark without words, drops nothing.
    """
    mark = free_name(docs, "__text_hash")
    rows = docs.withColumn(mark, F.xxhash64(text))
    named = rows.select(F.struct(F.col(key).alias("id"), F.col(mark).alias("text")).alias("id"), F.col(text).alias("t"))
    bad = find(named, benchmark.select(item, F.col(text).alias("t")), "id", "t", item, how)
    bad = bad.select(F.col("id.id").alias("__bad"), F.col("id.text").alias("__bad_text")).distinct()
    same = rows[key].eqNullSafe(bad["__bad"]) & rows[mark].eqNullSafe(bad["__bad_text"])
    return rows.join(bad, same, "left_anti").drop(mark)


SQL = r"""
with d0 as (select doc_id, row_number() over () rid, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') w from documents),
b0 as (select distinct item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') w from benchmark),
b1 as (select item_id, w, least(len(w), 5) k, len(w) - least(len(w), 5) + 1 n, row_number() over () i from b0 where len(w) > 0),
ks as (select distinct k from b1),
bs as (select i, k, n, list_slice(w, p, p + k - 1) s from (select i, k, n, w, unnest(range(1, n + 1)) p from b1)),
bc as (select i, k, n, s, count(*) c from bs group by all),
ds as (
  select doc_id, rid, k, m, p - 1 pos, list_slice(w, p, p + k - 1) s
  from (select doc_id, rid, w, k, len(w) - k + 1 m, unnest(range(1, len(w) - k + 2)) p from d0, ks where len(w) >= k)
),
hits as (select rid, doc_id, m, pos, i, bc.k, n, ds.s from ds join bc on ds.k = bc.k and ds.s = bc.s),
wins as (
  select distinct rid, doc_id, i, k, n, m, unnest(range(greatest(0, pos - n + 1), least(pos, greatest(0, m - n)) + 1)) st from hits
),
cnt as (
  select wins.rid, wins.i, st, hits.s, count(*) c
  from wins join hits on wins.rid = hits.rid and wins.i = hits.i and hits.pos between st and st + wins.n - 1 group by all
),
shared as (select rid, cnt.i, st, sum(least(cnt.c, bc.c)) x from cnt join bc on cnt.i = bc.i and cnt.s = bc.s group by all),
sim as (
  select doc_id, item_id, st, cast(x as double) / (least(m, wins.n) + wins.n - x) similarity
  from shared join wins using (rid, i, st) join b1 on b1.i = shared.i
)
select doc_id, item_id, similarity, cast(min(st) as int) as start
from sim s where similarity >= 0.8
  and similarity = (select max(similarity) from sim z where z.doc_id is not distinct from s.doc_id and z.item_id is not distinct from s.item_id)
group by all
"""
