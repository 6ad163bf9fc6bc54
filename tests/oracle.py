"""Runs registered queries on Spark and their SQL on DuckDB and compares the rows.

As a script: python tests/oracle.py <sf dir> [query ...]
"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def rows_of_spark(df):
    names = sorted(df.columns)
    table = df.toArrow()
    return names, sorted((tuple(_plain(dict(v) if n == "attributes" and isinstance(v, list) else v) for n, v in zip(names, r)) for r in zip(*[table.column(n).to_pylist() for n in names])), key=repr)


def rows_of_duckdb(con, sql):
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    rows = rel.fetchall()
    return [rel.columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark_side, duck_side):
    """None when equal, else a short description."""
    if spark_side[0] != duck_side[0]:
        return f"columns {spark_side[0]} vs {duck_side[0]}"
    a, b = spark_side[1], duck_side[1]
    if len(a) != len(b):
        return f"{len(a)} rows vs {len(b)}; only spark {sorted(set(a) - set(b), key=repr)[:2]} only duckdb {sorted(set(b) - set(a), key=repr)[:2]}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ, e.g. {wrong[0]}" if wrong else None


def main(sf_dir, only):
    import __spark_entry__ as entry
    from spanloom.session import local_session

    spark = local_session(8)
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if only and name not in only:
            continue
        began = time.time()
        try:
            mine = rows_of_spark(build(spark, sf_dir))
            took = time.time() - began
            diff = difference(mine, rows_of_duckdb(con, oracles[name])) if name in oracles else None
            state = f"DIFF {diff}" if diff else ("ok" if name in oracles else "rows only")
        except Exception as error:  # noqa: BLE001
            took, state = time.time() - began, f"FAILED {type(error).__name__} {str(error)[:1500]}"
            mine = ([], [])
        bad += not state.startswith(("ok", "rows"))
        print(f"{name:38s} {len(mine[1]):7d} rows {took:6.2f}s {state[:2500]}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main(sys.argv[1], set(sys.argv[2:]))
