"""Run every query beside its SQL oracle: ``python tests/check_oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(normal(r[i]) for i in order) for r in rows),
        key=lambda r: tuple((v is None, str(v)) for v in r),
    )


def family(kind: str) -> str:
    """One name for the same type in both engines."""
    kind = kind.lower()
    return {
        "varchar": "string", "integer": "int", "timestamp_ntz": "timestamp",
    }.get(kind, kind)


def compare(con, df, sql) -> str | None:
    """None when both agree, else what differs."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    types = {c[0]: family(str(c[1])) for c in cur.description}
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    kinds = {f.name: family(f.dataType.simpleString()) for f in df.schema.fields}
    if kinds != types:
        return f"types {[(k, kinds[k], types[k]) for k in kinds if kinds[k] != types[k]]}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"first difference {a} != {b}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry_module
    from framewright.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = build_session(
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry_module.oracle_sql()
    bad = 0
    for name, build in entry_module.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            result = (
                compare(con, build(spark, sf_dir), oracles[name])
                if name in oracles
                else f"no oracle, {build(spark, sf_dir).count()} rows"
            )
        except Exception as error:  # report every query
            result = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += result is not None
        print(f"{'ok ' if result is None else 'BAD'} {name} {time.time() - start:.1f}s {result or ''}", flush=True)
    print("bad:", bad)
