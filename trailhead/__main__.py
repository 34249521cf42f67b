"""Lists and runs the library's queries: list, sql NAME, run NAME TABLES OUT."""

from __future__ import annotations

import argparse

from trailhead.plans import catalog


def main(given: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="trailhead", description=__doc__)
    actions = parser.add_subparsers(dest="action", required=True)
    actions.add_parser("list", help="names of all queries")
    names = sorted(catalog.queries())
    actions.add_parser("sql", help="the SQL that gives the same rows").add_argument("name", choices=names, metavar="NAME")
    run = actions.add_parser("run", help="write a query's result as Parquet; the session's settings come from spark-submit")
    run.add_argument("name", choices=names, metavar="NAME")
    run.add_argument("tables", help="folder of the tables")
    run.add_argument("out", help="folder to write, which must not exist")
    args = parser.parse_args(given)
    if args.action == "list":
        print("\n".join(names))
    elif args.action == "sql":
        print(catalog.oracle_sql()[args.name])
    else:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName(f"trailhead {args.name}").getOrCreate()
        catalog.queries()[args.name](spark, args.tables).write.parquet(args.out)


if __name__ == "__main__":
    main()
