"""Side-by-side runs of a query and its DuckDB SQL."""

from __future__ import annotations

import decimal
import os
from pathlib import Path

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _value(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.6f}"
    return "null" if v is None else str(v)


def _rows(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_value(r[i]) for i in order) for r in rows)


def both(spark, query, sql: str, sf: str = SF):
    db = duckdb.connect()
    for p in Path(sf).iterdir():
        if p.suffix == ".parquet":
            db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    theirs = db.execute(sql)
    expected = _rows([d[0] for d in theirs.description], theirs.fetchall())
    df = query(spark, sf)
    return _rows(df.columns, df.collect()), expected
