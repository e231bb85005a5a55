"""Run reports as batch jobs and write their results.

    python -m shoplens list
    python -m shoplens run REPORT [REPORT ...] --out DIR
        (--published DIR | --catalog DB | --fixture SF_DIR) [--format parquet|csv|json]
        [--collation UNICODE_CI_AI]

Each report is written to ``DIR/<report>`` by the executors (Spark's file
commit protocol); nothing is collected to the driver.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from shoplens.functions.collation import collate_tables
from shoplens.plans.reports import FIXTURE, REPORTS, Parameters, reports
from shoplens.sources.tables import read_catalog, read_published


def _tables(spark: SparkSession, args):
    if args.published:
        return read_published(spark, args.published)
    if args.catalog:
        return read_catalog(spark, args.catalog)
    from shoplens.sources.fixture import fixture_tables

    return fixture_tables(spark, args.fixture)


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="shoplens")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list report names")
    run = sub.add_parser("run", help="run reports and write results")
    run.add_argument("reports", nargs="+")
    run.add_argument("--out", required=True)
    run.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    src = run.add_mutually_exclusive_group(required=True)
    src.add_argument("--published", help="root written by prep.publish")
    src.add_argument("--catalog", help="database holding the six shop tables")
    src.add_argument("--fixture", help="driver fixture directory (mapped, then published)")
    run.add_argument("--collation", help="group and compare URLs and UTM values under this collation")
    args = ap.parse_args(argv)

    if args.cmd == "list":
        print("\n".join(REPORTS))
        return 0
    unknown = [r for r in args.reports if r not in REPORTS]
    if unknown:
        ap.error(f"unknown reports: {unknown}")
    spark = SparkSession.builder.appName("shoplens").getOrCreate()
    tables = _tables(spark, args)
    parameters = FIXTURE if args.fixture else Parameters()  # else the scripts' own page lists, cutoff and grains
    catalog = reports(parameters)
    if args.collation:
        tables = collate_tables(tables, args.collation, parameters.pages())
    for name in args.reports:
        writer = catalog[name](tables).write.mode("overwrite").format(args.format)
        if args.format == "csv":
            writer = writer.option("header", "true")
        writer.save(f"{args.out}/{name}")
        print(f"{name} -> {args.out}/{name}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
