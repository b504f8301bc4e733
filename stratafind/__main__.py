"""Command line: list and run queries, ingest a folder, check tables, evaluate, clear what is kept."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import api, registry
from .operators import stores


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="stratafind")
    todo = parser.add_subparsers(dest="what", required=True)
    todo.add_parser("list")
    run = todo.add_parser("run")
    run.add_argument("query", choices=sorted(registry.QUERIES))
    run.add_argument("data")
    run.add_argument("--out", help="write the result there as Parquet instead of showing twenty rows")
    for name, arguments in (("ingest", ("root", "table")), ("check", ("data",)), ("evaluate", ("data",)), ("clear", ("path",))):
        part = todo.add_parser(name)
        for a in arguments:
            part.add_argument(a)
    args = parser.parse_args(argv)
    if args.what == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    spark = spark or SparkSession.builder.appName("stratafind").getOrCreate()
    if args.what == "run":
        result = registry.QUERIES[args.query](spark, args.data)
        result.write.parquet(args.out) if args.out else result.show()
    elif args.what == "ingest":
        print(api.ingest_trigger(spark, args.root, args.table))
    elif args.what == "check":
        print(api.health(spark, args.data))
    elif args.what == "evaluate":
        registry.QUERIES["snk_eval"](spark, args.data).show()
    else:
        print(stores.clear(spark, args.path))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
