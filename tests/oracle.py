"""Rows of a query against DuckDB's rows of its SQL."""

from pathlib import Path

import duckdb


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    found = con.execute(sql)
    names = sorted(range(len(found.description)), key=lambda k: found.description[k][0])
    rows = found.fetchall()
    return [found.description[k][0] for k in names], [tuple(r[k] for k in names) for r in rows]


def same_rows(df, sql: str, sf_dir: str) -> int:
    names, expected = sql_rows(sql, sf_dir)
    assert sorted(df.columns) == names
    got = [tuple(r[c] for c in names) for r in df.collect()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(expected, key=key)
    return len(got)
