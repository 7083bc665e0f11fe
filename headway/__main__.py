"""Commands: ``python -m headway queries | run | status | freeze | index | route | archive``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from headway.errors import StaleIndexError
from headway.functions.time import cutoff
from headway.operators import merge, reports, retrieval
from headway.session import build_session
from headway.sources import store


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="headway")
    sub = out.add_subparsers(dest="command", required=True)
    sub.add_parser("queries", help="names of all queries")
    run = sub.add_parser("run", help="one query over a folder of tables")
    run.add_argument("query")
    run.add_argument("tables")
    run.add_argument("--out", help="where to write the rows as Parquet; without it the first are shown")
    run.add_argument("--rows", type=int, default=20, help="rows shown")
    status = sub.add_parser("status", help="what a table holds, by a column")
    status.add_argument("table")
    status.add_argument("--ts", default="last_seen_utc")
    status.add_argument("--by", default="service_date")
    freeze = sub.add_parser("freeze", help="a copy of what a table held at the end of a service day")
    freeze.add_argument("table")
    freeze.add_argument("out")
    freeze.add_argument("--date", required=True)
    freeze.add_argument("--first", default="first_seen_utc")
    freeze.add_argument("--last", default="last_seen_utc")
    index = sub.add_parser("index", help="whether an index is what these settings would build; 1 if it is stale")
    index.add_argument("path")
    index.add_argument("--expect", required=True, help="the settings, as JSON")
    route = sub.add_parser("route", help="routes and stations of timetable zips, as CSV")
    route.add_argument("zips")
    route.add_argument("out")
    archive = sub.add_parser("archive", help="timetable zips, one of each content")
    archive.add_argument("zips")
    return out


def main(argv: list[str] | None = None, spark=None, say=print) -> int:  # noqa: ANN001
    """Runs one command; 0 if all is well, 1 if what was asked for is not as it should be."""
    args = parser().parse_args(argv)
    if args.command == "queries":
        from headway.plans import catalogue

        for name, f in sorted(catalogue.queries().items()):
            say(f"{name}: {(f.__doc__ or '').strip()}")
        return 0
    spark = spark or build_session("headway")
    if args.command == "run":
        from headway.plans import catalogue

        if args.query not in catalogue.queries():
            say(f"no query {args.query}")
            return 1
        df = catalogue.queries()[args.query](spark, args.tables)
        if args.out:
            df.write.parquet(args.out)
        else:
            for row in df.limit(args.rows).toJSON().collect():
                say(row)
    elif args.command == "status":
        for row in reports.store_status(spark.read.parquet(args.table), args.ts, args.by).orderBy(args.by).toJSON().toLocalIterator():
            say(row)
    elif args.command == "freeze":
        end = cutoff(F.lit(args.date))
        rows = merge.freeze(spark.read.parquet(args.table), args.date, end, date_col="service_date", first=args.first, clip=args.last)
        rows.write.parquet(args.out)
    elif args.command == "index":
        try:
            retrieval.open_index(spark, args.path, json.loads(args.expect))
        except StaleIndexError as e:
            say(str(e))
            return 1
    elif args.command == "route":
        tables = store.timetable(spark, args.zips)
        store.write_route_lookup(tables["routes"], f"{args.out}/routes")
        tables["stops"].select("stop_id", "stop_name", "parent_station").distinct().write.option("header", True).csv(f"{args.out}/stops")
    elif args.command == "archive":
        for row in store.distinct_bundles(spark, args.zips).orderBy("path").toLocalIterator():
            say(f"{row['sha256'][:12]} {row['length']} {row['path']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
