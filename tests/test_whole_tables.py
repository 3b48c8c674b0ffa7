"""Queries that give every row its result, on all turns and documents and not only those within some bound."""

from __future__ import annotations

from textloom.operators.segment import paragraphs
from textloom.operators.subtitles import midpoint, midpoint_of
from textloom.plans import catalog

SF = "/root/testdata/sf0.001"


def test_every_turn_has_its_midpoint(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    expected = {(r.conv_id, r.turn, midpoint_of(r.text) + 1) for r in turns if r.text and " " in r.text}
    assert any(len(r.text or "") > 400 for r in turns)
    assert {tuple(r) for r in catalog.QUERIES["midpoint_breaks"](spark, SF).collect()} == expected
    texts = ["", " ", "  ", "a", " a", "a ", "a  b", "\U0001f600 é x", "word " * 100_000, None]
    found = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(midpoint("t")).collect()]
    assert found == [None if t is None or " " not in t else midpoint_of(t) + 1 for t in texts]


def test_documents_with_blank_lines_keep_their_paragraphs(spark, tmp_path):
    texts = ["one", "one\n\ntwo", " a \n \t\nb\nc\n\n\n\nd\n", "\n\n", "", None, "\n\nlast\n \n", "\u00e9\r\n\r\n\U0001f600 x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {tuple(r) for r in catalog.QUERIES["paragraphs"](spark, str(tmp_path)).collect()}
    assert found == {(i, k, len(p)) for i, t in enumerate(texts) for k, (_, p) in enumerate(paragraphs(t or ""))}
    assert {i for i, k, _ in found if k} == {1, 2, 7}


def test_rare_bigrams_are_counted(spark, tmp_path):
    spark.createDataFrame([(1, "a b a b"), (2, "b a"), (3, "one"), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in catalog.QUERIES["bigram_counts"](spark, str(tmp_path)).collect()} == {("a", "b", 2), ("b", "a", 2)}
