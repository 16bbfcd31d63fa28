"""Example tables in the shapes of the data model, derived from the given tables.

Each is one SELECT in SQL that Spark and other engines read alike; sums run over
integers, so they do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_WEATHER = """
SELECT CAST(CASE CAST(l_suppkey % 4 AS INT) WHEN 0 THEN 2116266 WHEN 1 THEN 757942
            WHEN 2 THEN 2121748 ELSE 757859 END AS BIGINT) AS qid,
  CAST(l_shipdate AS DATE) AS date,
  CAST(SUM(CASE WHEN l_linenumber <= 2 AND l_discount < 0.035
           THEN CAST(l_quantity AS INT) ELSE 0 END) AS DOUBLE) / 10 AS pre,
  CAST(SUM(CAST(l_quantity AS INT)) AS DOUBLE) / COUNT(*) / 2 + 16
    + CAST(SUM(CAST(ROUND(l_tax*100) AS INT)) AS DOUBLE) / COUNT(*) AS tmax,
  CAST(SUM(CAST(l_quantity AS INT)) AS DOUBLE) / COUNT(*) / 2 + 1 AS tmin,
  CAST(SUM(CAST(l_quantity AS INT)) AS DOUBLE) / COUNT(*) / 5 + 10 AS rs,
  40 + 4 * CAST(SUM(CAST(ROUND(l_discount*100) AS INT)) AS DOUBLE) / COUNT(*) AS rh,
  1 + CAST(SUM(l_linenumber) AS DOUBLE) / COUNT(*) / 2 AS u2
FROM lineitem {where} GROUP BY 1, 2
"""
_MONTHLY = """
SELECT qid, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month,
  CAST(SUM(CAST(ROUND(pre*10) AS BIGINT)) AS DOUBLE) / 10 AS pre,
  CAST(SUM(CAST(ROUND(tmax*1000) AS BIGINT)) AS DOUBLE) / 1000 / COUNT(*) AS tmax,
  CAST(SUM(CAST(ROUND(tmin*1000) AS BIGINT)) AS DOUBLE) / 1000 / COUNT(*) AS tmin
FROM {table} GROUP BY 1, 2, 3
"""
_LONG = """
SELECT 'pre' AS variable, qid, year, month, pre AS value FROM {table}
UNION ALL SELECT 'tmax', qid, year, month, tmax FROM {table}
UNION ALL SELECT 'tmin', qid, year, month, tmin FROM {table}
"""
CELLS = ((2116266, 1100.0), (757942, 220.0), (2121748, 850.0), (757859, None))

#: Name -> SELECT; later ones may read earlier ones.
TABLES: dict[str, str] = {
    "weather_daily": _WEATHER.format(where=""),
    "weather_hist": _WEATHER.format(where="WHERE l_orderkey % 2 = 0"),
    "weather_stoc": _WEATHER.format(where="WHERE l_orderkey % 2 = 1"),
    "month_wide": _MONTHLY.format(table="weather_daily"),
    "hist_wide": _MONTHLY.format(table="weather_hist"),
    "stoc_wide": _MONTHLY.format(table="weather_stoc"),
    "weather_monthly": _LONG.format(table="month_wide"),
    "hist_monthly": _LONG.format(table="hist_wide"),
    "stoc_monthly": _LONG.format(table="stoc_wide"),
    "climate": """
SELECT CAST(year(CAST(o_orderdate AS DATE)) AS INT) AS year, CAST(month(CAST(o_orderdate AS DATE)) AS INT) AS month,
  CAST(SUM(CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END) AS DOUBLE)/COUNT(*) - 0.5 AS mei
FROM orders GROUP BY 1, 2
""",
    "prices": """
SELECT CAST(year(CAST(o_orderdate AS DATE)) + CAST(o_custkey % 2 AS INT) AS INT) AS matyear,
  CAST(o_orderdate AS DATE) AS date,
  CAST(SUM(CAST(ROUND(o_totalprice*100) AS BIGINT)) AS DOUBLE) / 100 / COUNT(*) AS price
FROM orders GROUP BY 1, 2
""",
    "points": """
SELECT CAST(s_suppkey AS BIGINT) AS id, CAST(s_suppkey * 37 % 360 AS DOUBLE) - 179.6e0 AS lon,
  CAST(s_suppkey * 53 % 178 AS DOUBLE) - 88.7e0 AS lat
FROM supplier
""",
    "customer_points": """
SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_custkey * 41 % 360 AS DOUBLE) - 179.3e0 AS lon,
  CAST(c_custkey * 59 % 178 AS DOUBLE) - 88.4e0 AS lat
FROM customer
""",
    "cells": " UNION ALL ".join(f"SELECT CAST({q} AS BIGINT) AS qid, CAST({'NULL' if z is None else f'{z}e0'} AS DOUBLE) AS z" for q, z in CELLS),
    "trend": """
SELECT v.variable, c.qid, CAST(m.month AS INT) AS month, CASE WHEN v.variable = 'pre' THEN 0e0 ELSE m.month * 0.01e0 END AS slope
FROM (SELECT DISTINCT variable FROM weather_monthly) v CROSS JOIN cells c
CROSS JOIN (SELECT DISTINCT month FROM weather_monthly) m
""",
}


def names_in(sql: str) -> list[str]:
    """The example tables that a SELECT reads, each after those that it reads itself."""
    import re

    out: list[str] = []

    def visit(text: str) -> None:
        for name in TABLES:
            if name not in out and re.search(rf"\b{name}\b", text):
                visit(TABLES[name])
                out.append(name)

    visit(sql)
    return out


def with_tables(sql: str) -> str:
    """A SELECT (or WITH ... SELECT) preceded by the example tables that it reads."""
    head = ",\n".join(f"{n} AS ({TABLES[n].strip()})" for n in names_in(sql))
    body = sql.strip()
    if not head:
        return body
    return f"WITH {head},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head}\n{body}"


def example(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An example table over the tables in `sf_dir`."""
    import re

    sql = with_tables(f"SELECT * FROM {name}")
    for base in ("lineitem", "orders", "supplier", "customer"):
        sql = re.sub(rf"(?<=FROM ){base}\b", f"parquet.`{sf_dir}/{base}.parquet`", sql)
    return spark.sql(sql)
