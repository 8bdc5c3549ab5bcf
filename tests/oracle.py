"""Compare a query with its SQL in DuckDB, as bags of rows."""

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(x):
    if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
        return None
    x = x.item() if hasattr(x, "item") else x
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def bag(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted(repr([_value(x) for x in row]) for row in frame.itertuples(index=False))


def expected(sql: str, sf: str = SF, **replace: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{replace.get(t, f'{sf}/{t}.parquet')}'")
    return con.sql(sql).df()
