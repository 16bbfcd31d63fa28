"""Registered queries: a callable over (spark, sf_dir), and the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.examples import with_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, rounded: int | None = 6, positive: bool = False) -> Callable[[Query], Query]:
    """Registers a query; doubles in its result are rounded, and `sql` is expected to round them too.

    `sql` may read the example tables, which are put before it. Where all doubles are
    `positive` and their digits fit a long, they are rounded in plain arithmetic, as
    the built-in rounding goes through decimals and costs more than a distance.
    """

    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            if rounded is None:
                return df
            near = _half_up if positive else F.round
            return df.select(*[near(c, rounded).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_tables(sql if rounded is None else _expand(sql, rounded))
        return f

    return register


def _half_up(c: str, digits: int) -> Column:
    return F.when(F.isnan(c), F.col(c)).otherwise(F.floor(F.col(c) * 10.0**digits + 0.5) / 10.0**digits)


def _expand(sql: str, digits: int) -> str:
    """R(x) in a query's SQL stands for a double rounded to `digits`."""
    out, at = [], 0
    while (k := sql.find("R(", at)) >= 0:
        if k and (sql[k - 1].isalnum() or sql[k - 1] == "_"):
            out.append(sql[at : k + 2])
            at = k + 2
            continue
        depth, end = 1, k + 2
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out.append(sql[at:k] + f"round(CAST({sql[k + 2 : end - 1]} AS DOUBLE), {digits})")
        at = end
    return "".join(out) + sql[at:]
