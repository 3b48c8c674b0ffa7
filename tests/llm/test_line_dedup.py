from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest

from textloom.llm.line_dedup import OP3_SQL, dedup_lines, filter_bits, seen_twice

from .helpers import LINE, docs, low, none, odd, odd_rows

STRIP = " \t\n\x0b\x0c\r"


def brute(rows, points=40, documents=5):
    held = defaultdict(list)
    for n, (i, text) in enumerate(rows):
        for key in {low(x.strip(STRIP)) for x in (text or "").split("\n")}:
            if len(key) >= points:
                held[key].append((n, i))
    last = {k: max((i for _, i in v), key=lambda i: (i is not None, i or 0)) for k, v in held.items() if len(v) >= documents}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if last.get(low(x.strip(STRIP)), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def plain(rows):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in rows), key=str)


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_equals_brute_force(spark, broadcast):
    rows = [(r.doc_id, r.text) for r in docs(spark).collect()]
    assert plain(dedup_lines(docs(spark), broadcast_bytes=broadcast, bits=1 << 20).collect()) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_odd_rows(spark, broadcast):
    rows = [(i, t) for i, t, *_ in odd_rows()]
    found = dedup_lines(odd(spark), broadcast_bytes=broadcast, bits=1 << 18).collect()
    assert plain(found) == sorted(brute(rows), key=str)
    assert sum(r.n_dropped for r in found) == 10
    assert dedup_lines(none(spark), bits=1 << 18).count() == 0


def test_a_full_filter_changes_no_result(spark):
    rows = [(i, t) for i, t, *_ in odd_rows()]
    assert plain(dedup_lines(odd(spark), bits=1 << 10).collect()) == sorted(brute(rows), key=str)


def test_digest(spark):
    by = {r.doc_id: r.kept_text for r in dedup_lines(odd(spark), bits=1 << 18).where("doc_id < 9").collect()}
    for r in dedup_lines(odd(spark), bits=1 << 18, digest=True).where("doc_id < 9").collect():
        assert r.kept_text == hashlib.sha256(by[r.doc_id].encode()).hexdigest()


def test_filter_size_follows_the_texts(spark):
    assert len(seen_twice(docs(spark).select("text"), bits=1 << 18)) == 1 << 15
    room = sum(len((r.text or "").encode()) for r in docs(spark).collect()) // 41
    assert filter_bits(docs(spark).select("text"), 40) == max(1 << 18, 1 << (4 * room).bit_length())
    assert filter_bits(none(spark), 40) == 1 << 18


def test_rows_that_repeat_a_doc_id_in_operator_and_sql(spark):
    """Every row is a document of its own in both."""
    import duckdb

    rows = [(i, t) for i, t, *_ in odd_rows()] + [(30, f"{LINE}\nb")] * 3 + [(30, f"other\n{LINE}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in dedup_lines(df, bits=1 << 18, digest=True).collect()), key=str)
    documents = df.toPandas().astype({"doc_id": "Int64"})  # noqa: F841
    assert found == sorted(duckdb.sql(OP3_SQL).fetchall(), key=str)
    assert plain(dedup_lines(df, bits=1 << 18).collect()) == sorted(brute(rows), key=str)
