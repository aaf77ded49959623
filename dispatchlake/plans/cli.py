"""python -m dispatchlake.plans.cli NAME --data DIR [--out PATH]: runs a query; --list names all."""

from __future__ import annotations

import argparse

from dispatchlake.plans import queries


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="dispatchlake")
    parser.add_argument("name", nargs="?")
    parser.add_argument("--data")
    parser.add_argument("--out", help="a folder for Parquet; without it some rows are shown")
    parser.add_argument("--show", type=int, default=20)
    parser.add_argument("--list", action="store_true")
    a = parser.parse_args(argv)
    known = queries.queries()
    if a.list:
        print("\n".join(known))
        return 0
    if a.name not in known or not a.data:
        parser.error("give the name of a query (--list) and --data")
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    df = known[a.name](spark, a.data)
    if a.out:
        df.write.mode("errorifexists").parquet(a.out)
    else:
        df.show(a.show, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
