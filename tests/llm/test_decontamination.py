from __future__ import annotations

import random

from textloom.llm.decontamination import contamination, op2_decontamination, without_benchmark

from .helpers import SF, counted, docs, none, odd, odd_rows, words


def brute(rows, items):
    found = {}
    for d, text in rows:
        w = words(text)
        for i, item in items:
            it = words(item)
            if not w or not it:
                continue
            g = counted(it)
            m = min(len(it), len(w))
            if len(it) < 5 and len(w) < len(it):
                continue
            for s in range(len(w) - m + 1):
                own = counted(w[s : s + m])
                common = sum((own & g).values())
                if common and common * 100 >= 80 * sum((own | g).values()):
                    found[d, i] = max(found.get((d, i), 0), common / sum((own | g).values()))
    return found


def test_windows_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in docs(spark).collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = {(r.doc_id, r.item_id): r.similarity for r in op2_decontamination(spark, SF).collect()}
    expected = brute(rows, items)
    assert expected and found.keys() == expected.keys()
    assert all(abs(found[k] - expected[k]) < 1e-5 for k in found)


def test_edited_passages_at_the_threshold(spark):
    base = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for at in range(i % 6):
            w[(at * 11 + i) % 60] = f"z{i}"
        rows.append((i, " ".join(["lead"] * (i % 9) + w + ["tail"] * 7)))
    items = [(1, " ".join(base)), (2, "two words"), (3, None), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows.append((100, "has two words inside"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows, items)
    assert (100, 2) in expected and 0 < sum(k[1] == 1 for k in expected) < 60
    assert {(r.doc_id, r.item_id) for r in contamination(df, bench).collect()} == set(expected)
    gone = {d for d, _ in expected}
    assert {r.doc_id for r in without_benchmark(df, bench).collect()} == {d for d, _ in rows} - gone


def test_repeated_shingles_hide_nothing(spark):
    def at_random(n, k):
        rng = random.Random(n * 1000 + k)
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    items, rows = [], []
    for k in range(4):
        for n, filler in ((200, 17), (300, 28), (400, 39)):
            w = at_random(n, k)
            at = 40 + 9 * k
            items.append((len(items), " ".join(w)))
            rows.append((len(rows), " ".join(["lead"] * k + w[:at] + ["x"] * filler + w[at + filler :] + ["tail"] * 5)))
        rows.append((len(rows), " ".join(at_random(200, k)[:179] + ["0"] * 60)))
        # the item has the repeats, or both have and not equally often
        w = at_random(150, k + 100)
        items.append((len(items), " ".join(w[:60] + ["y"] * 40 + w[60:])))
        rows.append((len(rows), " ".join(w[:60] + ["y"] * (20 + 8 * k) + w[60:])))
        rows.append((len(rows), " ".join(w[:60] + at_random(16 + 2 * k, k + 200) + ["y"] * 24 + w[60:])))
    rows.append((len(rows), "y " * 200))
    expected = brute(rows, items)
    assert len(rows) > len({d for d, _ in expected}) > 15
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r.similarity for r in contamination(df, bench).collect()}
    assert found.keys() == expected.keys() and all(abs(found[k] - expected[k]) < 1e-5 for k in found)
    assert {r.doc_id for r in without_benchmark(df, bench).collect()} == {d for d, _ in rows} - {d for d, _ in expected}


def test_odd_rows(spark):
    bench = spark.createDataFrame([(1, "one two three"), (2, None), (None, "no such words at all here")], "item_id long, text string")
    found = contamination(odd(spark), bench).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in found) == [(False, 8), (False, 9), (False, 9), (True, None)]
    clean = without_benchmark(odd(spark), bench)
    assert clean.count() == len(odd_rows()) - 4 and clean.columns == odd(spark).columns
    assert contamination(none(spark), bench).count() == 0
    assert without_benchmark(odd(spark), bench.limit(0)).count() == len(odd_rows())


def test_tables_are_held_within_their_bound(monkeypatch):
    """Items of many sizes and parts of many items: tables are dropped and built anew, and the parts hold all items."""
    import pyarrow as pa

    from textloom.llm import decontamination as D

    rng = random.Random(1)
    rows = [(i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(6 + i % 90))) for i in range(400)]
    items = D.Items(rows)
    texts = [" ".join([rows[i][1], "x y z", rows[(i * 7) % 400][1]]) for i in range(400)]
    whole = [found for _, found in D._scan(pa.array(texts), items)]
    monkeypatch.setattr(D, "TABLE_BYTES", 1 << 20)
    small = D.Items(rows)
    assert [found for _, found in D._scan(pa.array(texts), small)] == whole and len(whole) == 400
    assert sum(c.table.nbytes for c in small._chunks.values()) <= 1 << 20
