"""Query results against DuckDB statements over the same Parquet tables."""

import math
from pathlib import Path

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/**/*.parquet' if f.is_dir() else ''}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
        return ""
    if isinstance(v, float):
        return f"{v + 0.0:.5f}"
    if hasattr(v, "tz_localize"):
        return str(v.tz_localize(None))
    return str(v)


def rows(df) -> list[tuple[str, ...]]:
    df = df[sorted(df.columns)]
    ints = {c for c in df.columns if str(df[c].dtype).lower().startswith(("int", "uint", "float", "double"))}
    return sorted(tuple(plain(float(v)) if c in ints and plain(v) != "" else plain(v) for c, v in zip(df.columns, r)) for r in df.itertuples(index=False))
