"""Order-insensitive comparison of a Spark result with a DuckDB result, for tests and checks."""

from __future__ import annotations

import datetime
import decimal

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return v


def rows_of(table) -> tuple[list[str], list[tuple]]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    rows = [tuple(_plain(v) for v in r) for r in zip(*columns)] if columns else []
    return names, sorted(rows, key=repr)


def difference(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short account of the first difference."""
    got_names, got = rows_of(spark_df.toArrow())
    want_names, want = rows_of(con.execute(sql).to_arrow_table())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        extra, lack = set(map(repr, got)) - set(map(repr, want)), set(map(repr, want)) - set(map(repr, got))
        return f"rows {len(got)} != {len(want)}; only spark {sorted(extra)[:2]}; only sql {sorted(lack)[:2]}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} != {b} ({got_names})"
    return None
