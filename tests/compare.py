"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

python tests/compare.py [data dir] [query name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, build, sql: str, sf_dir: str) -> str:
    """Empty when both sides agree, else a short description of the difference."""
    df = build(spark, sf_dir)
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    got_types = sorted((n, kinds.get(t, t)) for n, t in df.dtypes)
    con.execute(sql)
    desc = con.description
    want_types = sorted((d[0], str(d[1])) for d in desc)
    want = _rows([d[0] for d in desc], con.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if got_types != want_types:
        diff = [x for x in got_types if x not in want_types], [x for x in want_types if x not in got_types]
        return f"schema {diff}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}: {got[:2]} {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if not bad:
        return ""
    cols = sorted(df.columns)
    g, w = bad[0]
    cells = [(c, x, y) for c, x, y in zip(cols, g, w) if x != y]
    return f"{len(bad)} of {len(got)} rows differ, first: {str(cells)[:300]}"


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('COMPARE_CPUS', 8)}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in argv[1:] or queries:
        start = time.time()
        if name not in oracle:
            print(f"-- {name}: no SQL, {queries[name](spark, sf_dir).count()} rows")
            continue
        try:
            problem = compare(spark, con, queries[name], oracle[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:500]}"
            con = connect(sf_dir)
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
