"""Run reports and write their results.

    python -m ledgerlens --warehouse /path/to/parquet/dir --out /path/out [--report NAME ...]
    python -m ledgerlens --warehouse DIR --stage-to /shared/staged          (load only)
    python -m ledgerlens --staged /shared/staged --out /path/out            (reuse a load)
    python -m ledgerlens --orders o.csv --details d.csv --targets t.csv --out /path/out

Each report is written to ``<out>/<report>`` in the chosen format
(parquet by default) and named with its rows and digest in
``<out>/_manifest.json``, written last. With CSV input, rows that fail to
parse are written to ``<out>/_rejects/<table>``. ``--list``
prints the report names.
"""

from __future__ import annotations

import argparse
import sys
from functools import partial

from ledgerlens.plans.catalog import REPORTS
from ledgerlens.session import build_session
from ledgerlens.sources.export import write_results


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="ledgerlens", description=__doc__,
                                 formatter_class=argparse.RawDescriptionHelpFormatter)
    ap.add_argument("--warehouse", help="folder with the warehouse Parquet tables")
    ap.add_argument("--stage-to", help="keep the staged tables in this (shared) folder")
    ap.add_argument("--staged", help="open tables staged earlier with --stage-to")
    ap.add_argument("--orders", help="orders CSV")
    ap.add_argument("--details", help="order lines CSV")
    ap.add_argument("--targets", help="sales targets CSV")
    ap.add_argument("--trim", action="store_true", help="trim blanks around CSV text values")
    ap.add_argument("--ignore-case", action="store_true",
                    help="compare and group CSV text without regard to case")
    ap.add_argument("--orders-per-mark", type=int, default=1,
                    help="orders that one mark of the weekday histogram stands for")
    ap.add_argument("--out", help="output folder")
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    ap.add_argument("--report", action="append", help="report name (repeatable); default all")
    ap.add_argument("--master", default=None, help="Spark master, e.g. local[8]")
    ap.add_argument("--list", action="store_true", help="list report names and exit")
    args = ap.parse_args(argv)
    if args.list:
        print("\n".join(REPORTS))
        return 0
    names = args.report or list(REPORTS)
    unknown = [n for n in names if n not in REPORTS]
    has_input = args.staged or args.warehouse or (args.orders and args.details and args.targets)
    if unknown or not has_input or not (args.out or args.stage_to):
        ap.error(f"unknown reports {unknown}" if unknown else
                 "need --out (or --stage-to) and one of --staged, --warehouse or "
                 "--orders/--details/--targets")
    spark = build_session(args.master)
    if args.staged:
        from ledgerlens.sources.staging import open_staged
        tables = open_staged(spark, args.staged)
    elif args.warehouse:
        from ledgerlens.sources.staging import stage_tables
        tables = stage_tables(spark, args.warehouse, location=args.stage_to)
    else:
        from ledgerlens.sources.staging import load_csv_tables
        tables, loads = load_csv_tables(spark, args.orders, args.details, args.targets, args.trim,
                                        args.ignore_case)
        for table, load in loads.items():
            print(f"{table}: {load.lines} lines, {load.loaded} loaded, {load.rejected} rejected",
                  file=sys.stderr)
            (load.rejects.write.mode("overwrite").option("header", True)
             .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
             .csv(f"{args.out}/_rejects/{table}"))
    if not args.out:
        return 0
    reports = REPORTS | {"weekday_histogram": partial(REPORTS["weekday_histogram"],
                                                      orders_per_mark=args.orders_per_mark)}
    entries = write_results(spark, {name: partial(reports[name], tables) for name in names}, args.out,
                            args.format)
    for entry in entries:
        print(f"wrote {args.out}/{entry['name']}: {entry['rows']} rows", file=sys.stderr)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
