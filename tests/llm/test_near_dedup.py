from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from textloom.llm.components import components
from textloom.llm.near_dedup import near_duplicates, op5_near_dedup
from textloom.llm.shingles import mix
from textloom.llm.superminhash import signatures

from .helpers import SF, docs, none, odd, odd_rows, shingles


def brute(rows, percent):
    """doc_id -> component, by every pair that shares a shingle."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for i in ids:
        for g in sets[i]:
            by[g].append(i)
    seen = set()
    for own in by.values():
        for k, a in enumerate(own):
            for b in own[k + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    common = len(sets[a] & sets[b])
                    if common * 100 >= percent * (len(sets[a]) + len(sets[b]) - common):
                        x, y = find(a), find(b)
                        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, sets


@pytest.mark.parametrize("percent", [80, 85])
def test_groups_equal_brute_force(spark, percent):
    rows = [(r.doc_id, r.text) for r in docs(spark).select("doc_id", "text").collect()]
    expected, sets = brute(rows, percent)
    found = near_duplicates(docs(spark), percent).collect()
    assert {r.doc_id: r.component_id for r in found} == expected
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.component_id == r.doc_id) for r in found)


def test_query_returns_every_document(spark):
    assert op5_near_dedup(spark, SF).select("doc_id").distinct().count() == docs(spark).count()


def test_graded_edits_of_one_text(spark):
    """Copies with one to six edits: many pairs are below the threshold and chains link some of them."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 160):
        w = list(base)
        for at in rng.sample(range(150), 1 + i % 6):
            w[at] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    expected, _ = brute(rows, 85)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert {r.doc_id: r.component_id for r in found} == expected


def test_a_large_group_of_copies_that_hardly_link_with_each_other(spark):
    """Ten thousand edits of one text, most of them linked with few or none: components by every pair, in blocks."""
    rng = np.random.default_rng(5)
    n, size = 10_000, 64
    masks, rows = np.zeros(n, np.uint64), []
    for i in range(n):
        w = [f"w{k}" for k in range(size)]
        gone = np.zeros(size - 4, bool)
        for at in rng.choice(size, 1 + int(rng.integers(0, 4)), replace=False) if i else ():
            w[at] = f"own{i}x{at}"
            gone[max(0, at - 4) : at + 1] = True
        masks[i] = sum(1 << k for k in np.flatnonzero(~gone).tolist())
        rows.append((i, " ".join(w)))
    parent = np.arange(n)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(0, n, 500):
        common = np.bitwise_count(masks[a : a + 500, None] & masks[None, :]).astype(np.int64)
        for x, y in zip(*np.nonzero(common * 100 >= (2 * (size - 4) - common) * 80), strict=True):
            if (u := find(a + x)) != (v := find(y)):
                parent[max(u, v)] = min(u, v)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), 80).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: int(find(i)) for i in range(n)}
    assert 100 < len({r.component_id for r in found}) < n


@pytest.mark.parametrize("hot", [True, False])
def test_salted_join(spark, monkeypatch, hot):
    from textloom.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 8 if hot else 1000)
    monkeypatch.setattr(common, "SALT_ROWS", 4)
    left = spark.range(300).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS key")
    right = spark.range(250).selectExpr("id AS key", "id * 2 AS twice").union(spark.sql("SELECT 1L, 7L"))
    out = common.salted_join(left, right, "key", "id")
    assert sorted(out.columns) == ["id", "key", "twice"]
    assert sorted(map(tuple, out.select("id", "key", "twice").collect())) == sorted(map(tuple, left.join(right, "key").select("id", "key", "twice").collect()))


def test_odd_rows(spark):
    found = near_duplicates(odd(spark), 85).collect()
    assert len(found) == len(odd_rows())
    expected, _ = brute([(i, t) for i, t, *_ in odd_rows()], 85)
    assert all(r.component_id == expected[r.doc_id] for r in found if r.doc_id is not None)
    assert all(r.component_id is None and not r.kept for r in found if r.doc_id is None)
    assert near_duplicates(none(spark), 85).count() == 0


def test_components_of_chains_and_rings_in_either_way(spark):
    links = [(i, i + 1) for i in range(0, 100)] + [(200, 201), (201, 202), (202, 200), (300, 299)]
    df = spark.createDataFrame(links, "u long, v long")
    for local in (1 << 18, 0):
        found = {r.node: r.component for r in components(df, local).collect()}
        assert found == {**{i: 0 for i in range(1, 101)}, 201: 200, 202: 200, 300: 299}


def test_signatures_agree_as_often_as_sets_do():
    rng = np.random.default_rng(1)
    a = mix(rng.integers(0, 2**63, 300, dtype=np.uint64))
    b = np.concatenate([a[:200], mix(rng.integers(0, 2**63, 100, dtype=np.uint64))])
    sig = signatures(np.concatenate([a, b]), np.array([0, 300, 600]), 512)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.08
    assert (signatures(np.zeros(0, np.uint64), np.array([0, 0]), 8) == -1).all()


def test_sketch_never_denies_a_link(spark):
    """A bound on the intersection from sketches is never below it."""
    from textloom.llm.near_dedup import _sketch

    rng = np.random.default_rng(2)
    for n in (5, 100, 5000):
        a = np.unique(mix(rng.integers(0, 2**63, n, dtype=np.uint64)))
        b = np.unique(np.concatenate([a[: n // 2], mix(rng.integers(0, 2**63, n, dtype=np.uint64))]))
        x, y = _sketch(a), _sketch(b)
        missing = int(np.bitwise_count((x & ~y).view(np.uint64)).sum())
        assert len(np.intersect1d(a, b)) <= len(a) - missing
