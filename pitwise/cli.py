"""Command line: list, run and explain queries, snapshot and publish results."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from pitwise.plans import catalogue
from pitwise.sources import snapshots, tables


def _session() -> SparkSession:
    return SparkSession.builder.appName("pitwise").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pitwise", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    for name, text in (("run", "run a query and write its result by suffix"), ("explain", "print a query's plan")):
        sub = commands.add_parser(name, help=text)
        sub.add_argument("query")
        sub.add_argument("tables", help="folder of the tables")
        if name == "run":
            sub.add_argument("out", nargs="?", help="where to write; without it the first rows are shown")
    sub = commands.add_parser("publish", help="run queries and publish their results as one run")
    sub.add_argument("tables")
    sub.add_argument("root")
    sub.add_argument("run_id")
    sub.add_argument("queries", nargs="+")
    sub = commands.add_parser("verify", help="check the files of a published run")
    sub.add_argument("folder")
    given = parser.parse_args(args)
    if given.command == "list":
        print("\n".join(sorted(catalogue.queries())))
        return 0
    if given.command == "verify":
        broken = snapshots.verify_run(given.folder)
        print("\n".join(broken) or "complete")
        return int(bool(broken))
    spark = _session()
    queries = catalogue.queries()
    if given.command == "explain":
        queries[given.query](spark, given.tables).explain("formatted")
    elif given.command == "run":
        df = queries[given.query](spark, given.tables)
        if given.out:
            tables.write_table(df, given.out)
        else:
            df.show(20, False)
    else:
        results = {n: queries[n](spark, given.tables) for n in given.queries}
        mark = "|".join(snapshots.table_fingerprint(df) for df in results.values())

        def build(folder: Path) -> dict:
            for n, df in results.items():
                tables.write_table(df, f"{folder}/{n}.parquet")
            return {"queries": sorted(results)}

        print(snapshots.publish(given.root, given.run_id, build, mark)["state"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
