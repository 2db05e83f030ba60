"""Where queries and their oracle SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def settled(sql: str) -> str:
    """Each ``round_even(x, n)`` spelled out as operators.robust.half_even does it: first to nine digits, as sums in another order differ in the last bits, then by the same products."""
    out, at = [], 0
    while (i := sql.find("round_even(", at)) >= 0:
        start, depth, comma = i + len("round_even("), 1, -1
        j = start
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            if sql[j] == "," and depth == 1:
                comma = j
            j += 1
        n = sql[comma + 1 : j - 1].strip()
        out.append(f"{sql[at:i]}(round_even(round_even(CAST({settled(sql[start:comma])} AS DOUBLE) * 1e9, 0) / 1e9 * 1e{n}, 0) / 1e{n} + 0e0)")
        at = j
    return "".join(out) + sql[at:]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with DuckDB SQL for the same rows if there is any."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = settled(sql)
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
