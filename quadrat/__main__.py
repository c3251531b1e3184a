"""Command line: ``python -m quadrat report TABLES_DIR OUT_DIR [options]``.

Reads the survey tables (``<name>.parquet`` or ``<name>.csv`` under
TABLES_DIR, on any file system) and writes every report dataset under OUT_DIR -
the report run (S5). Outputs whose tables are missing are listed; a folder
without any table is an error.
"""

from __future__ import annotations

import argparse

from .plans import regeneration, trees
from .plans.report import INPUTS, NEEDS, export_report
from .session import build_session
from .sources.catalog import find_table


def main(argv: list[str] | None = None) -> dict[str, str]:
    ap = argparse.ArgumentParser(prog="python -m quadrat")
    sub = ap.add_subparsers(dest="cmd", required=True)
    r = sub.add_parser("report", help="write every report dataset")
    r.add_argument("tables")
    r.add_argument("out")
    r.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    r.add_argument("--start", type=int, default=trees.START_YEAR)
    r.add_argument("--end", type=int, default=trees.END_YEAR)
    r.add_argument("--bin-size", type=float, default=3.0)
    r.add_argument("--islands", default=",".join(regeneration.ISLAND_ORDER),
                   help="island display order, comma separated")
    r.add_argument("--checkpoint-inputs", action="store_true")
    a = ap.parse_args(argv)

    spark = build_session("quadrat-report")
    tables = {}
    for name in INPUTS:
        df = find_table(spark, a.tables, name)
        if df is not None:
            tables[name] = df
    if not tables:
        raise SystemExit(f"no survey table under {a.tables}: expected {', '.join(INPUTS)} as .parquet or .csv")
    paths = export_report(tables, a.out, fmt=a.format, checkpoint_inputs=a.checkpoint_inputs,
                          start=a.start, end=a.end, bin_size=a.bin_size,
                          island_order=tuple(s.strip() for s in a.islands.split(",")))
    for k, v in sorted(paths.items()):
        print(f"{k}\t{v}")
    for k, need in sorted(NEEDS.items()):
        if k not in paths:
            print(f"skipped {k}: no table {', '.join(n for n in need if n not in tables)}")
    return paths


if __name__ == "__main__":
    main()
