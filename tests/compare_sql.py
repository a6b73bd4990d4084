"""Compare queries with their SQL over one folder of tables.

``python tests/compare_sql.py /root/testdata/sf0.01 [query ...]``
"""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _normal(value):
    if isinstance(value, (float, Decimal)):
        value = float(value)
        return round(value, 6) if math.isfinite(value) else str(value)
    return value


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder: str, name: str) -> tuple[bool, str]:
    """Whether the query and its SQL agree, and a line saying so."""
    start = time.perf_counter()
    df = contract.queries()[name](spark, folder)
    ours = _table(df.columns, [tuple(r) for r in df.collect()])
    spent = time.perf_counter() - start
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return True, f"{name}: {len(ours[1])} rows, no SQL, {spent:.1f}s"
    cursor = con.execute(sql)
    theirs = _table([c[0] for c in cursor.description], cursor.fetchall())
    if ours == theirs:
        return True, f"{name}: {len(ours[1])} equal rows, {spent:.1f}s"
    mine, other = set(ours[1]), set(theirs[1])
    return False, (
        f"{name}: DIFFERS columns {ours[0]} / {theirs[0]} rows {len(ours[1])} / {len(theirs[1])}"
        f" only here {sorted(mine - other, key=repr)[:3]} only SQL {sorted(other - mine, key=repr)[:3]}"
    )


if __name__ == "__main__":
    from oremill.session import local_session

    tables = sys.argv[1]
    session, connection = local_session(8, 8), connect(tables)
    results = [compare(session, connection, tables, n) for n in sys.argv[2:] or contract.queries()]
    for _, line in results:
        print(line)
    sys.exit(not all(ok for ok, _ in results))
