"""Run registered queries beside their SQL in DuckDB and compare the two results."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

KINDS = {
    "tinyint": "int", "smallint": "int", "int": "int", "bigint": "bigint", "double": "double", "float": "double",
    "string": "string", "boolean": "boolean",
    "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}".replace("-0.000000", "0.000000")
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> list[str]:
    """Problems found; empty when the results agree."""
    got_cols = df.columns
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want_types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    problems = []
    if sorted(got_cols) != sorted(want_cols):
        return [f"columns {sorted(got_cols)} vs {sorted(want_cols)}"]
    for name, kind in df.dtypes:
        if KINDS.get(kind, kind) != KINDS.get(want_types[name], want_types[name]):
            problems.append(f"type of {name}: {kind} vs {want_types[name]}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} vs {len(want)}")
    if not want:
        problems.append("no rows")
    a, b = _rows(got_cols, got), _rows(want_cols, want)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        problems.append(f"{len(bad)} rows differ, e.g. {bad[0] if bad else ''}")
    return problems


def main() -> int:
    import __spark_entry__ as entry
    from canvass.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session()
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracle:
                problems = compare(df, con, oracle[name])
            else:
                problems = [] if df.count() else ["no rows"]
        except Exception as e:  # noqa: BLE001
            problems = [f"{type(e).__name__}: {str(e)[:600]}"]
        failed += bool(problems)
        tag = "ok" if name in oracle else "ok (rows only)"
        print(f"{time.time() - start:6.2f}s {name}: {problems or tag}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
