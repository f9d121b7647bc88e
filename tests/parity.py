"""Compare a registered query with its DuckDB text on one test directory.

Run directly: ``python tests/parity.py [sf_dir] [name-part ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from palisade.fixtures import BASE_TABLES  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    import decimal

    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(query, spark, con, sf_dir: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    df = query(spark, sf_dir)
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if query.sql is None:
        return None if got else "no rows"
    rel = con.sql(query.sql)
    want_columns, want = rows_of(rel.columns, rel.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        return f"{len(got)} rows != {len(want)}; extra {extra} missing {missing}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} != {b}"
    return None


if __name__ == "__main__":
    from palisade.plans.catalog import CATALOG
    from palisade.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = build_session(master="local[8]", shuffle_partitions=8,
                          extra={"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name, q in CATALOG.items():
        if sys.argv[2:] and not any(p in name for p in sys.argv[2:]):
            continue
        start = time.time()
        try:
            problem = compare(q, spark, con, sf)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.2f}s {'' if q.sql else '(rows only)'} {problem or ''}",
              flush=True)
    print("bad:", bad)
