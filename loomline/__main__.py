"""python -m loomline list | run NAME DIR [--out PATH] | explain NAME DIR | sql NAME"""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loomline", description=__doc__)
    sub = p.add_subparsers(dest="mode", required=True)
    sub.add_parser("list", help="names of all queries")
    sub.add_parser("sql", help="a query's SQL twin").add_argument("name")
    for mode, text in (("run", "run a query"), ("explain", "show its physical plan")):
        s = sub.add_parser(mode, help=text)
        s.add_argument("name")
        s.add_argument("dir", help="folder of the tables")
    sub.choices["run"].add_argument("--out", help="Parquet folder for the result; shown if not given")
    sub.choices["run"].add_argument("--rows", type=int, default=20, help="rows shown")
    args = p.parse_args(argv)

    from loomline.plans import catalog

    if args.mode == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    if args.name not in catalog.QUERIES:
        p.error(f"no such query: {args.name}")
    if args.mode == "sql":
        print(catalog.ORACLES.get(args.name, "none"))
        return 0

    from pyspark.sql import SparkSession

    from loomline.session import session

    spark = SparkSession.getActiveSession() or session("*")
    df = catalog.QUERIES[args.name](spark, args.dir)
    if args.mode == "explain":
        df.explain("formatted")
    elif args.out:
        df.write.mode("overwrite").parquet(args.out)
    else:
        df.show(args.rows, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
