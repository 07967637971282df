"""Run a registered query on Spark and its SQL twin on DuckDB and compare whole results."""

from __future__ import annotations

import glob
import math
import os
import tempfile
import time

import duckdb

from folioframe.plans import registry


def rows_of(values, names) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 9) + 0.0
        if v is None or isinstance(v, (bool, int, str)):
            return v
        return str(v)

    return sorted((tuple(plain(row[i]) for i in order) for row in values), key=repr)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute("SET memory_limit='8GB'")
    con.execute(f"SET temp_directory='{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def compare(spark, sf_dir: str, name: str, con=None) -> tuple[bool, str]:
    started = time.time()
    df = registry.QUERIES[name](spark, sf_dir)
    names = df.columns
    got = rows_of([tuple(r) for r in df.collect()], names)
    spent = time.time() - started
    if name not in registry.ORACLES:
        return len(got) > 0, f"rows={len(got)} spark={spent:.1f}s (no oracle)"
    started = time.time()
    con = con or duck(sf_dir)
    result = con.execute(registry.ORACLES[name])
    expected_names = [d[0] for d in result.description]
    want = rows_of(result.fetchall(), expected_names)
    note = f"rows={len(got)}/{len(want)} spark={spent:.1f}s duck={time.time() - started:.1f}s"
    if sorted(names) != sorted(expected_names):
        return False, f"{note} columns {sorted(names)} vs {sorted(expected_names)}"
    if got != want:
        diff = [(g, w) for g, w in zip(got, want) if g != w][:3]
        wrong = sum(g != w for g, w in zip(got, want))
        return False, f"{note} wrong={wrong} first={diff}"
    return len(got) > 0, note
