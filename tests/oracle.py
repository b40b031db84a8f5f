"""Run registered queries next to their SQL oracle in DuckDB and compare the rows.

    python tests/oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return str(v)


def rows_of(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def kind(t: str) -> str:
    t = t.lower()
    for name, words in {"int": ("int", "long"), "float": ("double", "float"), "bool": ("bool",), "str": ("varchar", "string")}.items():
        if any(w in t for w in words):
            return name
    return t


def compare(spark, name: str, sf_dir: str, con=None) -> tuple[bool, str]:
    from __spark_entry__ import oracle_sql, queries

    df = queries()[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    sql = oracle_sql().get(name)
    if sql is None:
        return False, f"no oracle: {len(got)} rows"
    cur = (con or duck(sf_dir)).execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: kind(str(d[1])) for d in cur.description}
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    spark_types = {n: kind(t) for n, t in df.dtypes}
    if spark_types != types:
        bad = {n: (spark_types[n], types[n]) for n in types if spark_types[n] != types[n]}
        return False, f"types {bad}"
    exact = {n: t for n, t in df.dtypes}
    wide = {d[0]: str(d[1]) for d in cur.description}
    note = [n for n in exact if (exact[n] == "bigint") != (wide[n] == "BIGINT") and types[n] == "int"]
    if got != want:
        extra, missing = [r for r in got if r not in set(want)][:3], [r for r in want if r not in set(got)][:3]
        return False, f"{len(got)} rows vs {len(want)}; only spark {extra}; only sql {missing}"
    return True, f"{len(got)} rows" + (f" (int width differs: {note})" if note else "") + (" EMPTY" if not got else "")


def main() -> None:
    from evq.session import build_session

    args = sys.argv[1:]
    sf = "0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    spark = build_session("oracle", "local[8]", 8)
    from __spark_entry__ import queries

    sf_dir = f"/root/testdata/sf{sf}"
    con = duck(sf_dir)
    failed = []
    for name in args or queries():
        started = time.time()
        try:
            ok, note = compare(spark, name, sf_dir, con)
        except Exception as exc:  # report and go on with the next query
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - started:6.2f}s {note}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
