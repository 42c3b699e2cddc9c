"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096  # of the shuffle order and of the fractional ranks; three hex digits


def interleave(
    docs: DataFrame, shards: int = 40, seed: str = "0", key: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """Deal all rows to ``shards`` shards of equal row counts, each with the mixture of sources of the whole table.

    Rows of each source are put in a seeded random order; row r of n gets the
    fractional rank (2r - 1) / 2n; all rows are sorted by it and cut into equal
    runs. Columns: key, size (UTF-8 bytes of the text plus 16), text_crc32, source,
    rank (within the source), shard, slot (from 0 within the shard).

    A null text has 0 bytes; a null source is a source of its own; a null key is
    ordered as an empty string. Rows alike in key, source and text are
    interchangeable. An empty table gives an empty result. Other columns are not
    read.

    No source is ranked by one task: its order is cut into ``BUCKETS`` ranges of a
    uniform hash, rows are numbered within each, and the counts of the ranges
    before are added. Fractional ranks are spread evenly, so the global order is
    numbered the same way; how many rows lie before each of its ranges follows
    from the sources' sizes alone.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    mix = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("k"), F.col(source).alias("src"), name.alias("stratum"), mix.alias("mix"),
        F.conv(F.substring(mix, 1, 3), 16, 10).cast("int").alias("bucket"),
        (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("crc"),
    )
    before = Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("n"))
    ranges = ranges.select(
        "stratum", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
        F.sum("n").over(Window.partitionBy("stratum")).alias("n_source"),
    )
    inside = Window.partitionBy("stratum", "bucket").orderBy("mix", "k", "crc", "size")
    ranked = rows.withColumn("row", F.row_number().over(inside)).join(ranges, ["stratum", "bucket"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("row"))
    ranked = ranked.withColumn("odd", 2 * F.col("rank") - 1)
    ranked = ranked.withColumn("band", F.expr(f"cast((odd * {BUCKETS}) div (2 * n_source) as int)"))

    # rows of a source of n with a fractional rank under b / BUCKETS: those with (2r - 1) * BUCKETS < 2 * n * b
    sources = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    each = sources.select("n", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))).alias("band"))
    under = F.expr(f"case when band = 0 then 0 else ((2 * n * band - 1) div {BUCKETS} + 1) div 2 end")
    bands = each.groupBy("band").agg(F.sum(under).alias("start"), F.sum("n").alias("total"))
    order = Window.partitionBy("band").orderBy(F.col("odd") / (2.0 * F.col("n_source")), "stratum", "mix", "k", "crc", "size")
    placed = ranked.withColumn("nth", F.row_number().over(order) - 1).join(F.broadcast(bands), "band")  # BUCKETS rows
    placed = placed.withColumn("place", F.col("start") + F.col("nth"))
    shard = F.expr(f"(place * {shards}) div total")
    first = F.expr(f"((shard * total) + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select(
        F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), F.col("src").alias("source"), "rank",
        F.col("shard").cast("int").alias("shard"), (F.col("place") - first).alias("slot"),
    )


SQL = """
with recursive poly(i, k, c) as (
  select i, 0, i from range(256) r(i)
  union all select i, k + 1, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end from poly where k < 8
),
lut as (select list(c order by i) a from poly where k = 8),
base as (select doc_id, source, encode(coalesce(text, '')) b, coalesce('=' || source, '') stratum, md5('0:' || coalesce(cast(doc_id as varchar), '')) mix from documents),
bytes as (select *, hex(b) h, octet_length(b) n from base),
crc as (
  select doc_id, source, stratum, mix, n,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(n), lambda i:
      ((instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)::bigint)),
      lambda s, x: xor(s >> 8, a[xor(s & 255, x) + 1])), 4294967295::bigint) crc
  from bytes, lut
),
ranked as (
  select *, n + 16 size, row_number() over (partition by stratum order by mix, doc_id nulls first, crc, n) rank,
    count(*) over (partition by stratum) m, count(*) over () total
  from crc
),
placed as (select *, row_number() over (order by (2 * rank - 1) / (2.0 * m), stratum, mix, doc_id nulls first, crc, size) - 1 place from ranked)
select doc_id, cast(size as bigint) size, cast(crc as bigint) text_crc32, 'rows' as law, cast(place * 40 // total as int) shard,
  cast(place - ((place * 40 // total) * total + 39) // 40 as bigint) slot, cast(null as int) grown_shard, source, rank
from placed
"""
