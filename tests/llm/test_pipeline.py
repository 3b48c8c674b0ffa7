from __future__ import annotations

import corpus_pipeline
from textloom.llm.common import table

from .helpers import SF, docs, none, odd, shingles, words
from .test_decontamination import brute as leaks
from .test_near_dedup import brute as groups

NAMES = ["language", "near_dedup", "decontamination", "mixing", "sharding"]


def test_stages_on_documents(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    rows = {r.doc_id: r.text for r in docs(spark).collect()}
    at, seen = table(spark, SF, "documents"), {}
    columns = at.columns
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SF).cache()
        if name != "sharding":
            assert at.columns == columns
        seen[name] = [r.doc_id for r in at.collect()]
    has_letter = {i for i, t in rows.items() if any(c.isalpha() for c in t or "")}
    assert set(seen["language"]) == has_letter
    component, _ = groups([(i, t) for i, t in rows.items() if i in has_letter], 80)
    assert set(seen["near_dedup"]) == {i for i, c in component.items() if i == c} and len(seen["near_dedup"]) == len(set(seen["near_dedup"]))
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    bad = {d for d, _ in leaks([(i, rows[i]) for i in seen["near_dedup"]], items)}
    assert bad and set(seen["decontamination"]) == set(seen["near_dedup"]) - bad
    total = sum(len(words(rows[i])) for i in seen["decontamination"])
    mixed = sum(len(words(rows[i])) for i in seen["mixing"])
    assert max(map(seen["mixing"].count, set(seen["mixing"]))) <= 2 and abs(mixed - 1.5 * total) < 0.1 * total
    assert sorted(seen["sharding"]) == sorted(seen["mixing"])
    assert at.where("shard between 0 and 39").count() == len(seen["mixing"]) and {*columns, "shard"} <= {*at.columns}


def test_run_reads_the_written_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "shard"} <= {*out.columns} and out.count() > 0


def test_odd_rows_and_none(spark):
    for df in (odd(spark), none(spark)):
        columns = df.columns
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, SF).cache()
            assert set(columns) <= set(df.columns), name
        kept = [r for r in df.collect() if r.doc_id is not None]
        ids = {r.doc_id for r in kept}
        assert not ids & {1, 2, 3, 10, 5, 7}
    assert shingles("a b") == frozenset([("a", "b")])


def test_many_dropped_ids_are_joined(spark, monkeypatch):
    """Past the bound of what is broadcast, the same rows by a shuffle."""
    from textloom.llm import near_dedup

    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs(spark), SF).collect())
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", -1)
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_IDS", -1)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs(spark), SF).collect()) == kept


def test_batches_to_python_are_bounded(spark):
    from textloom.llm.common import BATCH_ROWS, bounded_batches

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for given, kept in (("10000", str(BATCH_ROWS)), ("0", str(BATCH_ROWS)), ("64", "64")):
            spark.conf.set(key, given)
            bounded_batches(spark)
            assert spark.conf.get(key) == kept
    finally:
        spark.conf.set(key, before)
