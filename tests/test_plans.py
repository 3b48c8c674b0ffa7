"""Plans hold what they should at any size: pushed filters, pruned columns, no products of tables."""

from __future__ import annotations

import re

import pytest

from textloom.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(catalog.QUERIES["tpch_pricing"](spark, SF))
    assert re.search(r"PushedFilters: \[.*LessThanOrEqual\(l_shipdate", p)
    assert "l_orderkey" not in p.split("ReadSchema")[1].split("\n")[0]
    p = plan(catalog.QUERIES["tpch_semi"](spark, SF))
    assert re.search(r"PushedFilters: \[.*GreaterThan\(o_totalprice", p) and "LeftSemi" in p


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if n.startswith(("tpch", "event", "conv", "doc_", "name", "span"))))
def test_no_products(spark, name):
    p = plan(catalog.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in p
    # the two range lookups have a table of fixed size on the broadcast side
    assert name in ("tpch_range_join", "clearing_lookup") or "BroadcastNestedLoopJoin" not in p


def test_an_asof_join_is_one_window(spark):
    p = plan(catalog.QUERIES["event_asof"](spark, SF))
    assert "Join" not in p and "Window" in p


def test_row_local_text_queries_do_not_shuffle(spark, monkeypatch):
    from textloom import session

    # only an input of few pieces is spread over the cores; here all count as large
    assert "RoundRobinPartitioning" in plan(catalog.QUERIES["sentence_tokens"](spark, SF))
    monkeypatch.setattr(session, "SMALL_INPUT", 0)
    for name in ("line_split", "sentence_counts", "doc_offsets", "ws_normalize", "email_counts", "idnumber_candidates", "mask_documents", "masked_people", "chunk_documents", "sentence_tokens", "paragraphs", "token_space", "shape_flags", "pii_spans"):
        assert "Exchange" not in plan(catalog.QUERIES[name](spark, SF)), name
