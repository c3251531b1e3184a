"""Run every registered query on Spark and its DuckDB oracle; compare.

Usage: ``python tests/oracle_check.py [sf_dir] [key ...]``. Prints one line
per query and exits non-zero on any mismatch. Also used by the test suite.
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


TYPE_MAP = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
            "boolean": "BOOLEAN", "date": "DATE", "float": "FLOAT"}


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _key(row):
    return tuple((0, "") if v is None else (1, round(v, 6)) if isinstance(v, float)
                 else (2, str(v)) for v in row)


def rows_equal(a, b, rel=1e-9, abs_=1e-9) -> str | None:
    if len(a) != len(b):
        return f"row count {len(a)} != {len(b)}"
    sa, sb = sorted(a, key=_key), sorted(b, key=_key)
    for i, (x, y) in enumerate(zip(sa, sb)):
        for j, (u, v) in enumerate(zip(x, y)):
            if u is None or v is None:
                if u is not v:
                    return f"row {i} col {j}: {u!r} != {v!r}"
            elif isinstance(u, float) or isinstance(v, float):
                if not math.isclose(float(u), float(v), rel_tol=rel, abs_tol=abs_):
                    return f"row {i} col {j}: {u!r} != {v!r}"
            elif u != v:
                return f"row {i} col {j}: {u!r} != {v!r}"
    return None


def compare(spark, sf_dir: str, keys=None, verbose=True) -> dict[str, str]:
    import __spark_entry__ as E
    qs, oracle = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for k in keys or qs:
        t0 = time.time()
        try:
            sdf = qs[k](spark, sf_dir)
            cols = sorted(sdf.columns)
            srows = [tuple(_norm(r[c]) for c in cols) for r in sdf.collect()]
            ts = time.time() - t0
            if k not in oracle:
                out[k] = f"NO-ORACLE rows={len(srows)}"
            else:
                rel = con.execute(oracle[k])
                dcols = [d[0] for d in rel.description]
                drows = rel.fetchall()
                dtypes = {d[0]: str(d[1]) for d in rel.description}
                stypes = dict(sdf.dtypes)
                type_diff = {c: (stypes[c], dtypes.get(c)) for c in cols
                             if c in dtypes and TYPE_MAP.get(stypes[c]) != dtypes[c]}
                if sorted(dcols) != cols:
                    out[k] = f"COLS spark={cols} duck={sorted(dcols)}"
                elif type_diff:
                    out[k] = f"TYPES {type_diff}"
                else:
                    idx = [dcols.index(c) for c in cols]
                    drows = [tuple(_norm(r[i]) for i in idx) for r in drows]
                    err = rows_equal(srows, drows)
                    out[k] = f"OK rows={len(srows)} {ts:.1f}s" if err is None else f"DIFF {err}"
        except Exception as e:  # report and continue
            out[k] = f"ERROR {type(e).__name__}: {str(e)[:300]}"
        if verbose:
            print(f"{k:28s} {out[k]}", flush=True)
    return out


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or None
    from quadrat.session import build_session
    spark = build_session("oracle-check", master="local[8]", shuffle_partitions=8)
    res = compare(spark, sf_dir, keys)
    bad = [k for k, v in res.items() if not v.startswith(("OK", "NO-ORACLE"))]
    ok = sum(v.startswith("OK") for v in res.values())
    print(f"{ok}/{len(res)} ok; bad: {bad}")
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
