"""Run one named analysis and show or write its result.

    python -m latebound list
    python -m latebound black_sellers_rfm --data /root/testdata/sf0.01 [--out DIR --format csv]
    python -m latebound sql "SELECT cause, count(*) FROM lines GROUP BY cause" --data DIR
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    from .plans import QUERIES

    parser = argparse.ArgumentParser(prog="latebound")
    parser.add_argument("query", help="query name, 'list', or 'sql'")
    parser.add_argument("text", nargs="?", help="SQL text for 'sql'")
    parser.add_argument("--data", default="/root/testdata/sf0.01", help="folder of the raw tables")
    parser.add_argument("--out", help="write the result here instead of showing it")
    parser.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    parser.add_argument("--rows", type=int, default=50, help="rows to show")
    args = parser.parse_args(argv)

    if args.query == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    from .session import local_session
    from .sources.raw import write_result

    spark = local_session()
    if args.query == "sql":
        from .plans.views import register_views

        register_views(spark, args.data)
        result = spark.sql(args.text)
    elif args.query in QUERIES:
        result = QUERIES[args.query](spark, args.data)
    else:
        parser.error(f"unknown query {args.query!r}; try 'list'")
        return 2
    if args.out:
        write_result(result, args.out, fmt=args.format)
    else:
        result.show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
