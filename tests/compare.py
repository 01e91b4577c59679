"""Compare a Spark result with a DuckDB result, row order aside."""

from __future__ import annotations

import os

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _kind(dtype) -> str:
    kind = str(dtype)
    return "datetime" if kind.startswith("datetime") else kind


def _rows(df) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple("" if v is None or v != v else str(v) for v in row)
                   for row in df.itertuples(index=False, name=None)))


def differences(spark_pdf, duck_pdf) -> str | None:
    """None when equal, else what differs first."""
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} / {sorted(duck_pdf.columns)}"
    if len(spark_pdf) != len(duck_pdf):
        return f"row count {len(spark_pdf)} / {len(duck_pdf)}"
    for c in spark_pdf.columns:
        a, b = _kind(spark_pdf[c].dtype), _kind(duck_pdf[c].dtype)
        if len(spark_pdf) and a != b:
            return f"type of {c}: {a} / {b}"
    for mine, theirs in zip(_rows(spark_pdf), _rows(duck_pdf), strict=True):
        if mine != theirs:
            return f"row {mine} / {theirs}"
    return None
