"""Compare a registered query with its SQL counterpart run in DuckDB."""

from __future__ import annotations

from collections import Counter

import duckdb

from ledgerloom.sources.tables import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def differences(df, con, sql: str) -> list[str]:
    """Empty when columns and the bag of rows agree."""
    got_rows, want = df.collect(), con.execute(sql)
    names = [d[0] for d in want.description]
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    got, expected = _bag(df.columns, got_rows), _bag(names, want.fetchall())
    out = []
    if got != expected:
        out.append(f"rows {sum(got.values())} vs {sum(expected.values())}, columns {sorted(names)}")
        out += [f"only spark: {r}" for r in sorted((got - expected), key=str)[:3]]
        out += [f"only sql:   {r}" for r in sorted((expected - got), key=str)[:3]]
    return out
