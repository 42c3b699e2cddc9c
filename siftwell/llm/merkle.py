"""Merkle manifest of a table: digests of rows, subroots per group, a root, and a proof for every row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import numbered
from .simhash import settled

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass(frozen=True)
class Shape:
    """Children of a node, and the levels that one block of rows climbs before it is down to a single row."""

    fan_out: int = 2
    levels: int = 8

    def __post_init__(self):
        if self.fan_out < 2 or self.levels < 1 or self.width > 4096:
            raise ValueError("a block must hold 2 to 4096 rows")

    @property
    def width(self) -> int:
        return self.fan_out**self.levels


def digest(*parts: Column) -> Column:
    """H: lowercase hex SHA-256 of the parts end to end."""
    return F.sha2(F.concat(*parts), 256)


def sealed(*values: Column) -> Column:
    """Digest of a row's values, each ``-`` if null, else its UTF-8 byte count, a colon and itself."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return digest(*map(part, values))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of a proof give."""
    return F.aggregate(proof, leaf, lambda node, level: digest(level["left"], node, level["right"]))


def siblings(proof: Column) -> Column:
    """All siblings of a proof end to end: level by level, each from left to right."""
    return F.array_join(F.transform(proof, lambda level: F.concat(level["left"], level["right"])), "")


def _climbed(nodes: DataFrame, shape: Shape) -> DataFrame:
    """Rows (g, pos, n, node, ...) with ``block``, ``path`` (their siblings on each level inside the block) and ``top``.

    A node of level t stands in the row of its first leaf, so the others of its
    run are found at fixed distances, in lag and lead columns that slot and run
    length mask; the first child's row hashes the parent. A level is climbed
    only while its group has more than one node. ``top`` is the block's root, in
    its first row. All windows share one dealing and one sort.
    """
    block = Window.partitionBy("g", "block").orderBy("pos")
    so_far = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = [*nodes.columns, "block"]
    rows = nodes.withColumns({"block": F.expr(f"pos div {shape.width}"), "climbed": F.col("node")})
    fan, found = shape.fan_out, []
    for t in range(shape.levels):
        step = fan**t
        others = {f"lag{j}": F.lag("climbed", j * step).over(block) for j in range(1, fan)}
        others |= {f"lead{j}": F.lead("climbed", j * step).over(block) for j in range(1, fan)}
        slot = F.expr(f"(pos div {step}) % {fan}")
        run = F.least(F.lit(fan).cast("long"), F.expr(f"(n + {step - 1}) div {step} - (pos div {step} - (pos div {step}) % {fan})"))
        left = F.concat(*[F.when(slot >= j, F.col(f"lag{j}")).otherwise(F.lit("")) for j in range(fan - 1, 0, -1)])
        right = F.concat(*[F.when(slot + j < run, F.col(f"lead{j}")).otherwise(F.lit("")) for j in range(1, fan)])
        several = F.col("n") > step
        level = F.when(several & F.expr(f"pos % {step} = 0"), F.struct(left.alias("left"), right.alias("right")))
        parent = F.when(several, digest(F.col("climbed"), right)).otherwise(F.col("climbed"))
        rows = rows.withColumns(others).select(
            *kept, *found, level.alias(f"level{t}"), F.when(F.expr(f"pos % {step * fan} = 0"), parent).alias("climbed")
        )
        found.append(f"level{t}")
    path = F.array_compact(F.array(*[F.last(c, ignorenulls=True).over(so_far) for c in found]))
    return rows.select(*kept, F.col("climbed").alias("top"), path.alias("path"))


def _tiers(leaves: DataFrame, shape: Shape) -> list[tuple[DataFrame, Shape]]:
    """The leaves, the roots of their blocks, the roots of blocks of those, and so on, down to one row per group.

    Each tier comes with the shape of its blocks, which have no more levels than
    its largest group needs; all tiers but the first are written.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    out = []
    while most > 1:
        need = next(t for t in range(1, 64) if shape.fan_out**t >= most)
        now = Shape(shape.fan_out, min(shape.levels, need))
        out.append((leaves, now))
        roots = _climbed(leaves.select("g", "pos", "n", "node"), now).filter(F.expr(f"pos % {now.width} = 0"))
        roots = roots.select("g", F.col("block").alias("pos"), F.expr(f"(n + {now.width - 1}) div {now.width}").alias("n"), F.col("top").alias("node"))
        leaves = settled(roots, "blocks")
        most = -(-most // now.width)
    return [*out, (leaves, shape)]


def _proved(tiers: list[tuple[DataFrame, Shape]], top: DataFrame) -> DataFrame:
    """Rows of the first tier with ``proof``; ``top`` has a row per group with the proof from there, and columns that go along."""
    if len(tiers) == 1:
        return tiers[0][0].join(top, ["g", "pos"])
    for i in range(len(tiers) - 2, -1, -1):
        rows, shape = tiers[i]
        above = top.withColumnRenamed("pos", "block").withColumnRenamed("proof", "beyond")
        rows = _climbed(rows if i == 0 else rows.select("g", "pos", "n", "node"), shape).join(above, ["g", "block"])
        top = rows.withColumn("proof", F.concat("path", "beyond")).drop("path", "beyond", "block", "top", *(["node", "n"] if i else []))
    return top


def manifest(leaves: DataFrame, key: str = "doc_id", group: str = "lang", leaf: str = "leaf", shape: Shape = Shape()) -> DataFrame:
    """``leaves`` with ``subroot``, ``root`` and ``proof``: per level the digests ``left`` and ``right`` of the node, each end to end.

    Per group the leaves ascend by key; while more than one node remains, every
    ``fan_out`` consecutive ones (the last run may have fewer, even one) become
    the digest of theirs, so a level without siblings counts too. Subroots,
    ordered by group, give the root in the same way. ``leaves`` holds one row per
    leaf: key, group (any type, compared as a string, byte by byte) and the digest.

    A null group is a group of its own and comes first; a null key comes first
    in its group. Equal keys are ordered by their digests; rows alike in both
    are interchangeable, and each is a leaf. A null digest is an error. Other
    columns pass through, whatever their names, unless they are called subroot,
    root or proof. An empty table gives an empty result.

    No task sees a group: leaves are numbered by ``order.numbered`` and dealt in
    blocks of ``Shape.width`` rows; a group of any size takes one such round per
    ``levels`` levels, the next on as many rows fewer. Proofs come down the same
    blocks. The driver learns two numbers: the largest group and how many there are.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    rows = leaves.select(
        name.alias("g"), F.col(key).alias("key"), F.col(leaf).alias("node"), F.struct(*[F.col(f"`{c}`") for c in leaves.columns]).alias("row")
    )
    tiers = _tiers(numbered(rows, "g", ["key", "node"], "leaves"), shape)
    tops = tiers[-1][0].select(F.lit("").alias("g"), F.col("g").alias("name"), "node")
    groups = _tiers(numbered(tops, "g", ["name"], "groups"), shape)
    start = groups[-1][0].select("g", "pos", F.col("node").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("proof"))
    roots = _proved(groups, start).select(F.col("name").alias("g"), F.lit(0).cast("long").alias("pos"), F.col("node").alias("subroot"), "root", "proof")
    proved = _proved(tiers, settled(roots, "roots"))
    return proved.select("row.*", "subroot", "root", "proof")


def digests(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """The manifest of ``docs`` in short, and what it says of a table in which some rows are tampered with.

    doc_id, leaf, subroot, root, proof_sha256 (of all siblings), folded_root (from
    the leaf as found, and the siblings) and verified. Where 7 divides the
    unsigned CRC32 of the decimal doc_id, the leaf as found has one added to
    n_chars, unless that is null; a row without a doc_id is as it was.
    """
    grown = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = F.when(chosen, sealed(*[grown if c == "n_chars" else F.col(c) for c in FIELDS]))
    leaves = docs.select("doc_id", "lang", sealed(*map(F.col, FIELDS)).alias("leaf"), found.alias("found"))
    out = manifest(leaves, shape=shape).withColumn("folded_root", fold(F.coalesce("found", "leaf"), F.col("proof")))
    return out.select(
        "doc_id", "leaf", "subroot", "root", digest(siblings(F.col("proof"))).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


SQL = """
with recursive rows as (
  select *, coalesce('=' || lang, '') g, '%' e from documents
),
leaves as (
  select doc_id, g, row_number() over () id,
    sha256(coalesce(octet_length(encode(cast(doc_id as varchar))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(cast(n_chars as varchar))) || ':' || n_chars, '-')
      || coalesce(octet_length(encode(text)) || ':' || text, '-')) leaf,
    sha256(coalesce(octet_length(encode(cast(doc_id as varchar))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(cast(n_chars + 1 as varchar))) || ':' || (n_chars + 1), '-')
      || coalesce(octet_length(encode(text)) || ':' || text, '-')) grown
  from rows
),
poly(i, k, c) as (
  select i, 0, i from range(256) r(i)
  union all select i, k + 1, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end from poly where k < 8
),
lut as (select list(c order by i) a from poly where k = 8),
crc as (
  select id, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: ascii(x)::bigint)),
    lambda s, x: xor(s >> 8, a[xor(s & 255, x) + 1])), 4294967295::bigint) c
  from leaves, lut
),
tree as (
  select g, 0 lvl, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 pos, leaf node, count(*) over (partition by g) n from leaves
  union all
  select g, lvl + 1, pos // 2, sha256(string_agg(node, '' order by pos)), (max(n) + 1) // 2 from tree where n > 1 group by g, lvl, pos // 2
),
subroots as (select g, node subroot, row_number() over (order by g) - 1 pos, count(*) over () n from tree where n = 1),
top as (
  select 0 lvl, pos, subroot node, n from subroots
  union all
  select lvl + 1, pos // 2, sha256(string_agg(node, '' order by pos)), (max(n) + 1) // 2 from top where n > 1 group by lvl, pos // 2
),
path as (
  select l.id, l.doc_id, l.leaf, l.g, case when c % 7 = 0 then grown else leaf end found,
    row_number() over (partition by l.g order by doc_id nulls first, leaf) - 1 pos, count(*) over (partition by l.g) m
  from leaves l join crc using (id)
),
walk(id, g, inner_level, lvl, pos, m, folded, proof) as (
  select id, g, true, 0, pos, m, found, '' from path
  union all
  select w.id, w.g, case when w.inner_level then w.m > 1 else false end,
    case when w.inner_level and w.m = 1 then 0 else w.lvl + 1 end,
    case when w.inner_level and w.m = 1 then s.pos else w.pos // 2 end,
    case when w.inner_level and w.m = 1 then s.n else (w.m + 1) // 2 end,
    case when w.inner_level and w.m = 1 then w.folded
      when w.pos % 2 = 1 then sha256(coalesce(t.node, u.node) || w.folded)
      else sha256(w.folded || coalesce(t.node, u.node, '')) end,
    case when w.inner_level and w.m = 1 then w.proof else w.proof || coalesce(t.node, u.node, '') end
  from walk w join subroots s on s.g = w.g
    left join tree t on w.inner_level and w.m > 1 and t.g = w.g and t.lvl = w.lvl and t.pos = xor(w.pos, 1)
    left join top u on not w.inner_level and u.lvl = w.lvl and u.pos = xor(w.pos, 1)
  where w.inner_level or w.m > 1
)
select p.doc_id, p.leaf, s.subroot, r.node root, sha256(w.proof) proof_sha256, w.folded folded_root, w.folded = r.node verified
from path p join walk w on w.id = p.id and not w.inner_level and w.m = 1 join subroots s on s.g = p.g, (select node from top where n = 1) r
"""
