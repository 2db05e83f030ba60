"""Command line: list and run queries, evaluate label files.

    python -m rallyplan queries
    python -m rallyplan run rally_table /root/testdata/sf0.01 [--rows 20] [--write PATH] [--explain]
    python -m rallyplan eval-hits labels.csv found.parquet [--offset S] [--resolution S]
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from rallyplan import api
from rallyplan.plans import registry
from rallyplan.session import importable, local_session
from rallyplan.sources import files


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rallyplan", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("queries")
    run = commands.add_parser("run")
    run.add_argument("name", choices=sorted(registry.QUERIES), metavar="NAME")
    run.add_argument("sf_dir")
    run.add_argument("--rows", type=int, default=20)
    run.add_argument("--write")
    run.add_argument("--explain", action="store_true")
    hits = commands.add_parser("eval-hits")
    hits.add_argument("labels")
    hits.add_argument("found")
    hits.add_argument("--offset", type=float, default=0.0)
    hits.add_argument("--resolution", type=float, default=0.0)
    a = parser.parse_args(argv)
    if a.command == "queries":
        for name, f in sorted(registry.QUERIES.items()):
            print(f"{name}: {(f.__doc__ or '').strip().splitlines()[0]}")
        return 0
    spark = importable(local_session())
    if a.command == "run":
        df = registry.QUERIES[a.name](spark, a.sf_dir)
        if a.explain:
            df.explain("formatted")
        elif a.write:
            df.write.mode("overwrite").parquet(a.write)
        else:
            df.show(a.rows, truncate=False)
        return 0
    one = lambda df, name: df.select(F.lit(1).cast("long").alias("all"), F.monotonically_increasing_id().alias(name), F.col("t").cast("double").alias("t"))
    api.evaluate_hits(one(files.labels(spark, a.labels), "label_id"), one(spark.read.parquet(a.found), "found_id"), "all", a.offset, a.resolution).drop("all").show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
