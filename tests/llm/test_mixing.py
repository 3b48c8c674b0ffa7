from __future__ import annotations

import itertools
from collections import defaultdict

from pyspark.sql import functions as F

from textloom.llm.mixing import mix, mixed_documents, op6_mixing, route, source_targets

from .helpers import WORD, docs, none, odd, odd_rows

MEDIUM = "/root/testdata/sf0.01"


def test_contract(spark):
    found = op6_mixing(spark, MEDIUM).collect()
    again = {r.doc_id: r.taken for r in op6_mixing(spark, MEDIUM).collect()}
    rows = docs(spark, MEDIUM).collect()
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in rows}
    source = {r.doc_id: r.source for r in rows}
    assert {r.doc_id: r["size"] for r in found} == size and {r.doc_id: r.taken for r in found} == again
    by, taken, target = defaultdict(int), defaultdict(int), {}
    for r in found:
        assert r.taken <= 2 * r["size"]
        by[source[r.doc_id]] += r["size"]
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    names = sorted(by, key=lambda s: (s is None, s or ""))
    expected = source_targets([by[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    for s, t in zip(names, expected, strict=True):
        assert abs(target[s] - t) < 1e-6 and t <= 2 * by[s] + 1e-9
        assert abs(taken[s] - t) <= max(0.01 * t, max(size[d] for d in size if source[d] == s) / 2 + 1)
    assert abs(sum(expected) - min(1.5 * sum(by.values()), 2 * sum(by.values()))) < 1e-6


def test_targets_stop_at_twice_the_source():
    assert source_targets([100, 10, 1000], [5, 2, 1]) == [200, 20, 1445]
    assert source_targets([10], [5]) == [15]
    assert source_targets([], []) == []
    assert source_targets([0, 10], [5, 2]) == [0, 15]


def test_route_is_a_cheapest_flow():
    """Against all ways to route, on small cases: quotas are met as far as they can be, at the least cost of repetition."""
    cases = [([((0,), 2), ((0, 1), 2)], [3, 2]), ([((0, 1), 1), ((1,), 2)], [1, 3]), ([((0,), 1), ((1,), 1), ((0, 1), 2)], [2, 3]), ([((0, 1), 3)], [3, 3])]
    for patterns, quotas in cases:
        edges = [(p, k, s) for p, (sources, _) in enumerate(patterns) for k in range(2) for s in sources]
        best = None
        for flow in itertools.product(*[range(patterns[p][1] + 1) for p, _, _ in edges]):
            used, got = defaultdict(int), defaultdict(int)
            for (p, k, s), x in zip(edges, flow, strict=True):
                used[p, k] += x
                got[s] += x
            if all(v <= patterns[p][1] for (p, _), v in used.items()) and all(got[s] <= q for s, q in enumerate(quotas)):
                key = (-sum(flow), sum((k + 1) * x for (_, k, _), x in zip(edges, flow, strict=True)))
                best = key if best is None or key < best else best
        found = route(patterns, quotas)
        total = sum(x for p in found for k in p for x in k.values())
        cost = sum((k + 1) * x for p in found for k, f in enumerate(p) for x in f.values())
        assert (-total, cost) == best


def test_overlapping_sources(spark):
    rows = [(i, 10, ["a"] if i % 3 == 0 else ["b"] if i % 3 == 1 else ["b", "a", "a"]) for i in range(300)]
    out = mix(spark.createDataFrame(rows, "doc_id long, size long, sources array<string>")).collect()
    assert len(out) == 300 and all(r.taken in (0, 10, 20) for r in out)
    assert abs(sum(r.taken for r in out) - sum(next(r.target for r in out if len(r.target) == 2))) <= 10


def test_odd_rows(spark):
    df = odd(spark)
    out = mixed_documents(df)
    assert out.columns == df.columns
    assert out.count() == mixed_documents(df).count()
    assert mixed_documents(none(spark)).count() == 0
    sized = df.select("doc_id", F.lit(0).cast("long").alias("size"), F.array("source").alias("sources"))
    assert {r.taken for r in mix(sized).collect()} == {0} and mix(sized).count() == len(odd_rows())


def test_names_ties_and_equal_rows(spark):
    """Columns named like those used inside stay; rows that differ in one column only are told apart, equal ones drawn among."""
    df = odd(spark).withColumns({"taken": F.lit("x"), "size": F.lit(3).cast("long"), "sources": F.array("source")})
    out = mix(df)
    assert set(out.columns) == set(df.columns) | {"source_size", "target", "times"} and out.where("whole = 'x' and rest = 'x' and _bin = 'x' and _h = 'x'").count() == len(odd_rows())
    rows = [(7, f"text {i}", "a" if i % 4 else "b") for i in range(4000)]
    ties = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    once, again = (sorted((r.text, r.source) for r in mixed_documents(ties).collect()) for _ in range(2))
    assert once == again and abs(len(once) - 6000) <= 2
    same = spark.createDataFrame([(None, "one two", "a")] * 4000 + [(1, "one two", "b")], "doc_id long, text string, source string").repartition(4)
    taken = mixed_documents(same).groupBy("source").count().collect()
    assert abs(next(r["count"] for r in taken if r.source == "a") - 6000) < 200


def test_bound_of_patterns():
    """As many patterns as the planner takes are routed in seconds."""
    import random
    import time

    draw = random.Random(1)
    patterns = list({tuple(sorted(draw.sample(range(4000), draw.choice((1, 1, 2, 3))))): draw.randint(1, 10**6) for _ in range(60_000)}.items())
    sizes = [0] * 4000
    for own, total in patterns:
        for s in own:
            sizes[s] += total
    began = time.perf_counter()
    flow = route(patterns, [round(t) for t in source_targets(sizes, [(5, 2, 1)[i % 3] for i in range(4000)])])
    assert time.perf_counter() - began < 60
    assert all(sum(row.values()) <= total for (_, total), own in zip(patterns, flow, strict=True) for row in own)
