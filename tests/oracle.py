"""Runs registered queries on Spark and their SQL on DuckDB and compares the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from strata import queries, schemas


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in schemas.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value)
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


FAMILY_TYPE = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
    "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz",
}


def compare(spark, con, q, sf_dir) -> str | None:
    """None when equal, else a description of the first difference."""
    df = q.run(spark, sf_dir)
    got = df.collect()
    result = con.execute(q.sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    types = {n: str(d[1]) for n, d in zip(names, result.description)}
    for field, dtype in df.dtypes:
        expect = FAMILY_TYPE.get(types[field])
        if expect != dtype:
            return f"type of {field}: spark {dtype}, sql {types[field]}"
    a, b = normal(df.columns, got), normal(names, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; e.g. {sorted(set(a) ^ set(b))[:3]}"
    for x, y in zip(a, b):
        if x != y:
            return f"{sorted(names)}: spark {x} sql {y}; {sum(p != q for p, q in zip(a, b))} rows differ"
    return None if a else "EMPTY"


def main(sf_dir: str, only: list[str]):
    from strata.session import build

    spark = build("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, q in queries.load_all().items():
        if only and not any(o in name for o in only):
            continue
        start = time.time()
        try:
            if q.sql is None:
                n = q.run(spark, sf_dir).count()
                print(f"rows {name}: {n}")
                continue
            diff = compare(spark, con, q, sf_dir)
        except Exception as e:  # report and go on
            diff = f"{type(e).__name__}: {str(e)[:700]}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {name} {time.time() - start:.1f}s {diff or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
