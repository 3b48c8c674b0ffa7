from __future__ import annotations

import zlib
from collections import Counter, defaultdict

from textloom.llm.common import fresh_path
from textloom.llm.sharding import SlotMap, assign, build_map, op1_sharding, placed

from .helpers import SF, docs, none, odd, odd_rows


def test_sizes_hashes_and_gapless_places(spark):
    found = op1_sharding(spark, SF).collect()
    texts = {r.doc_id: r.text for r in docs(spark).collect()}
    assert len(found) == len(texts)
    places = defaultdict(list)
    for r in found:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        assert 0 <= r.shard < 40
        places[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in places.values())


def test_bytes_are_near_equal(spark):
    load = Counter()
    rows = op1_sharding(spark, "/root/testdata/sf0.1").groupBy("shard").sum("size").collect()
    for r in rows:
        load[r.shard] = r[1]
    assert len(load) == 40 and max(load.values()) <= 1.03 * min(load.values())


def test_odd_rows_and_none(spark):
    df = odd(spark)
    slot_map, rows = build_map(df, 3, fresh_path(spark, "m"))
    out = placed(df, slot_map, rows).collect()
    assert len(out) == len(odd_rows())
    for s in range(3):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert set(assign(df, slot_map).columns) == set(df.columns) and len(assign(df, slot_map).columns) == len(df.columns)
    assert assign(df, slot_map).where("_vs = 'x' and _shard = 'x' and virtual_slot >= 0 and shard < 3").count() == len(odd_rows())
    assert assign(df.withColumnRenamed('shard', 'SHARD'), slot_map).columns.count('shard') == 1
    slot_map, rows = build_map(none(spark), 3, fresh_path(spark, "m"))
    assert placed(none(spark), slot_map, rows).count() == 0


def test_map_versions(spark):
    path = fresh_path(spark, "m")
    sizes = [(i * 7919) % 101 for i in range(512)]
    first = SlotMap.balanced(sizes, 8)
    grown = first.grown(sizes, 9)
    first.store(spark, path)
    grown.store(spark, path)
    assert SlotMap.load(spark, path) == grown and SlotMap.load(spark, path, 1) == first
    assert all(b == a or b == 8 for a, b in zip(first.shard_of, grown.shard_of, strict=True))
    skew = [s + (1000 if first.shard_of[i] == 0 else 0) for i, s in enumerate(sizes)]
    moved = grown.rebalanced(skew)
    load = lambda m: max(sum(s for s, k in zip(skew, m.shard_of, strict=True) if k == j) for j in range(9))
    assert moved.version == 3 and load(moved) < load(grown)
