"""Near-duplicates, shards and packing against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from siftwell.llm import packing, sharding, simhash

from .edge import TEXTS, documents, empty


def plain_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """Smallest id reachable over links of 3 bits or fewer."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_simhash_edges(spark):
    df = documents(spark, extra=True)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(TEXTS) + 3
    prints = {i: plain_print(t) for i, t in enumerate(TEXTS)}
    want = plain_components(prints)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id])
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert Counter(ids) == Counter({i: 1 for i in set(want.values())}) + Counter({None: 2})


@pytest.mark.parametrize("cell", [4096, 7])
def test_simhash_components(spark, monkeypatch, cell):
    """Random fingerprints, chains of near ones and one dense cloud; with small cells buckets are split."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(250):
        prints.append(prints[rng.randrange(len(prints))] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    center = rng.getrandbits(64)
    prints += [center ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in set(signed)], "fp long"))
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    want = plain_components(dict(enumerate(prints)))
    sets = defaultdict(set)
    for i, r in want.items():
        sets[r].add(signed[i])
    for members in sets.values():
        assert {found.get(m, m) for m in members} == {min(members)}


def test_bit_planes():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 2**63, 700, dtype=np.uint64)
    fp[1::2] = fp[::2] ^ (np.uint64(1) << rng.integers(0, 63, 350, dtype=np.uint64))
    planes, here = simhash.Planes(fp), np.arange(700)
    for shift in (1, 2, 63, 64, 65, 200):
        wanted = here + shift < 700
        near = planes.near(shift, wanted, 3)
        assert near.tolist() == [i for i in range(700 - shift) if int(fp[i] ^ fp[i + shift]).bit_count() <= 3]


def test_fold_many_hashes():
    h = np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64)
    counts = np.array([0, 1, 2, 255, 256, 3000, 0, 1486])
    at = np.cumsum(counts) - counts
    want = [sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[a : a + n]) > n) if n else 0 for a, n in zip(at, counts)]
    assert simhash.fold(h, counts).tolist() == want


def test_shards(spark):
    df = documents(spark, extra=True)
    df = df.unionByName(df).unionByName(df)
    rows = sharding.interleave(df, shards=7).collect()
    n = Counter(r.shard for r in rows)
    assert sum(n.values()) == df.count() and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))
    ranks = defaultdict(list)
    for r in rows:
        ranks[r.source].append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in ranks.values()) and None in ranks
    size = {r.doc_id: r.size for r in rows}
    assert size[0] == 16 and size[10] == 16 + len(TEXTS[10].encode())
    assert sharding.interleave(empty(spark)).count() == 0


def test_shards_hold_the_mixture(spark):
    df = spark.range(12_000).selectExpr("id doc_id", "'x' text", "case when id % 3 = 0 then 'hot' else concat('s', id % 7) end source")
    rows = sharding.interleave(df, shards=10).groupBy("source", "shard").count().collect()
    total = Counter()
    for r in rows:
        total[r.source] += r["count"]
    assert all(abs(r["count"] - total[r.source] / 10) <= 1 for r in rows)
    assert {r.shard for r in rows} == set(range(10))


def plain_pack(sizes, bins):
    room, used, full, where, rest = [], [], [], [], sum(sizes)
    for s in sizes:
        fits = [(r, -b) for b, r in enumerate(room) if r >= s]
        if fits:
            b = -max(fits, key=lambda x: (-x[0], x[1]))[1]  # least room, then oldest
        else:
            n = min((x for x in bins.lengths if x >= s), key=lambda x: (bins.cost(x) / min(x, rest), x))
            room.append(n)
            used.append(0)
            full.append(n)
            b = len(room) - 1
        where.append(b)
        room[b] -= s
        used[b] += s
        rest -= s
    return where, [min(x for x in bins.lengths if x >= u) for u in used]


def test_pack_is_best_fit():
    rng = random.Random(2)
    for lengths in ((8, 16, 32), (10,), (5, 7, 100)):
        bins = packing.Bins(lengths, fixed=1.0)
        for _ in range(40):
            sizes = sorted((rng.randint(1, lengths[-1]) for _ in range(rng.randint(0, 60))), reverse=True)
            where, offset, full = packing.pack(sizes, bins)
            assert (where, full) == plain_pack(sizes, bins)
            at = defaultdict(int)
            for b, o, s in zip(where, offset, sizes):
                assert o == at[b]
                at[b] += s


def test_best_fit_rows(spark):
    rows = [(1, 0), (2, None), (3, -4), (4, 40), (5, 33), (6, 16), (7, 1), (7, 1), (None, 9), *((i, i % 30) for i in range(10, 300))]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, n_tokens long, bin string")
    bins = packing.Bins((8, 16, 32))
    out = packing.best_fit(df, bins=bins, group_rows=50).collect()
    total = Counter()
    for r in out:
        total[r.doc_id] += r.n_tokens
    want = Counter()
    for i, n in rows:
        want[i] += max(n or 0, 0)
    assert total == want
    content = defaultdict(list)
    for r in out:
        if r.n_tokens == 0:
            assert r.bin is None
            continue
        content[r.group, r.bin, r.bin_length].append((r.bin_offset, r.n_tokens))
    for (_, _, length), pieces in content.items():
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert length == min(x for x in bins.lengths if x >= at)
    assert len({k[0] for k in content}) > 1
    assert packing.best_fit(df.limit(0)).count() == 0
    assert packing.best_fit(packing.with_sizes(documents(spark, extra=True))).count() >= len(TEXTS)
