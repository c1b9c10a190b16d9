"""Run a query on Spark and its SQL on DuckDB and compare rows and types.

Also a command line: ``python tests/oracle.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import datetime
import decimal
import sys
import time
import traceback
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, datetime.datetime) and value.tzinfo is not None:
        return value.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    if isinstance(value, decimal.Decimal):
        return ("decimal", value.as_tuple().exponent, str(value))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


KINDS = {
    "tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
    "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP",
}


def spark_type(name: str) -> str:
    return KINDS.get(name, name.upper())


def compare(spark, con, fn, sql: str | None, sf_dir: str) -> str:
    """'' when equal, else what differs."""
    df = fn(spark, sf_dir)
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if sql is None:
        return "" if rows else "no rows"
    rel = con.sql(sql)
    if sorted(rel.columns) != columns:
        return f"columns {columns} against {sorted(rel.columns)}"
    mine = {f.name: spark_type(f.dataType.simpleString()) for f in df.schema}
    theirs = {c: str(t).split("(")[0] if "DECIMAL" not in str(t) else str(t).replace(" ", "") for c, t in zip(rel.columns, rel.types)}
    types = {c: (mine[c], theirs[c]) for c in columns if mine[c] != theirs[c]}
    if types:
        return f"types {types}"
    position = [rel.columns.index(c) for c in columns]
    expected = Counter(tuple(plain(r[i]) for i in position) for r in rel.fetchall())
    if rows != expected:
        extra, missing = rows - expected, expected - rows
        return (
            f"{sum(rows.values())} rows against {sum(expected.values())}; {columns}\n"
            f"   only spark {sum(extra.values())}: {[k for k in list(extra)[:3]]}\n"
            f"   only sql   {sum(missing.values())}: {[k for k in list(missing)[:3]]}"
        )
    return "" if rows else "no rows"


def main() -> int:
    import __spark_entry__ as entry
    from tallyroom.session import session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.001"
    spark = session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args[1:] or queries:
        start = time.time()
        try:
            problem = compare(spark, con, queries[name], oracles.get(name), sf_dir)
        except Exception:
            problem = traceback.format_exc()[-1800:]
        bad += bool(problem)
        kind = "" if name in oracles else " [rows]"
        print(f"{'FAIL' if problem else 'ok  '} {name}{kind} {time.time() - start:.2f}s {problem}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(main())
