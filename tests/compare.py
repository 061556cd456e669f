"""Run registered queries next to their SQL twins and compare all rows."""

from __future__ import annotations

import glob
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def sql_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if glob.glob(f"{sf_dir}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(
        tuple((type(v).__name__, plain(v)) for v in (row[i] for i in order)) for row in rows
    )


def compare(spark, sf_dir, function, sql):
    """Differences as text; empty when both sides agree."""
    frame = function(spark, sf_dir)
    got = frame.collect()
    if sql is None:
        return f"" if got else "no rows", len(got)
    cursor = sql_connection(sf_dir).execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(names) != sorted(frame.columns):
        return f"columns {frame.columns} and {names}", len(got)
    a, b = rows_of(frame.columns, got), rows_of(names, want)
    if a == b:
        return "", len(got)
    only_spark, only_sql = list((a - b).items()), list((b - a).items())
    return (
        f"rows {len(got)} and {len(want)}; {len(only_spark)} only in Spark, {len(only_sql)} only "
        f"in SQL; {str(only_spark[:2])[:600]} ... {str(only_sql[:2])[:600]}"
    ), len(got)


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from shelfvec.session import local_session

    import __spark_entry__ as entry

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    session = local_session(8)
    sqls = entry.oracle_sql()
    for query_name, fn in entry.queries().items():
        if wanted and not any(query_name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            difference, count = compare(session, sf_dir, fn, sqls.get(query_name))
        except Exception as error:  # noqa: BLE001
            difference, count = f"{type(error).__name__}: {str(error)[:900]}", -1
        kind = "sql" if query_name in sqls else "rows"
        print(f"{'ok ' if not difference else 'BAD'} {query_name} {kind} {count} rows {time.time() - start:.1f}s {difference}", flush=True)
