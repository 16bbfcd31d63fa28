"""Queries through files: what is written from the given tables is read back by the readers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables
from ..sources.examples import CELLS, example
from ..sources.scratch import scratch
from ..streaming import rain
from .places import LAT, LON
from .registry import query

_IDS = [q for q, _ in CELLS]


_VARIABLES = ("pre", "tmax", "tmin")


@query("read_monthly_wide", "SELECT variable, qid, year, month, R(value) AS value FROM weather_monthly")
def read_monthly_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every variable through a file of its own."""
    path = scratch(spark, "wide")
    wide = example(spark, sf_dir, "month_wide")
    for v in _VARIABLES:
        wide.groupBy("year", "month").pivot("qid", _IDS).agg(F.first(v)).write.parquet(f"{path}/{v}")
    return reduce(DataFrame.unionByName, [tables.read_monthly_wide(spark, f"{path}/{v}", v) for v in _VARIABLES])


@query("read_climate", "SELECT year, month, R(mei) AS mei FROM climate")
def read_climate(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "climate")
    example(spark, sf_dir, "climate").select("month", "year", "mei", F.lit(0.0).alias("other")).write.option("header", True).csv(path)
    return tables.read_climate(spark, path, ["mei"])


@query("read_trend", "SELECT variable, qid, month, R(slope) AS slope FROM trend")
def read_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "trend")
    slopes = example(spark, sf_dir, "trend")
    for v in _VARIABLES:
        slopes.filter(F.col("variable") == v).groupBy("qid").pivot("month", list(range(1, 13))).agg(F.first("slope")).write.parquet(f"{path}/{v}")
    return reduce(DataFrame.unionByName, [tables.read_trend(spark, f"{path}/{v}", v) for v in _VARIABLES])


@query("read_daily_by_cell", "SELECT qid, date, R(pre) AS pre, R(tmax) AS tmax FROM weather_daily")
def read_daily_by_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "cells")
    daily = example(spark, sf_dir, "weather_daily").select("qid", "date", "pre", "tmax").withColumn("cell", F.col("qid"))
    daily.repartition("cell").select("cell", "date", "pre", "tmax").write.partitionBy("cell").parquet(path)  # a folder a cell
    return tables.read_daily_by_cell(spark, path).select("qid", "date", "pre", "tmax")


@query("read_elevation", "SELECT qid, R(coalesce(z, 0)) AS z, count(*) AS days FROM weather_daily LEFT JOIN cells USING (qid) GROUP BY ALL")
def read_elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "elevation")
    example(spark, sf_dir, "cells").filter("z is not null").write.csv(path)
    days = example(spark, sf_dir, "weather_daily").groupBy("qid").agg(F.count("*").alias("days"))
    return days.join(tables.read_elevation(spark, path), "qid", "left").select("qid", F.coalesce("z", F.lit(0.0)).alias("z"), "days")


@query(
    "parse_climate_text",
    """WITH g AS (SELECT y.year, m.month, round(mei, 2) AS v FROM (SELECT DISTINCT year FROM climate) y CROSS JOIN (SELECT DISTINCT month FROM climate) m LEFT JOIN climate c ON c.year = y.year AND c.month = m.month)
SELECT year, month, R(v) AS mei, R(CASE WHEN v + 1 < 1.3 THEN v + 1 END) AS soi FROM g""",
)
def parse_climate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of two indices, made from `climate`; one drops its high values to the missing flag."""
    c = example(spark, sf_dir, "climate").withColumn("mei", F.round("mei", 2))
    both = c.select("year", "month", F.explode(F.array(F.struct(F.lit("mei").alias("index_name"), F.col("mei").alias("v")), F.struct(F.lit("soi").alias("index_name"), F.when(F.col("mei") + 1 < 1.3, F.col("mei") + 1).alias("v")))).alias("x"))
    cells = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.coalesce(F.format_number(F.element_at("by", m), 2), F.lit("-99.90"))), "  ")
    rows = both.filter("x.v is not null").groupBy("x.index_name", "year").agg(F.map_from_entries(F.collect_list(F.struct("month", "x.v"))).alias("by"))
    every = c.select("year").distinct().join(rows.select("index_name").distinct(), how="cross")
    rows = every.join(rows, ["index_name", "year"], "left").select("index_name", "year", F.concat(F.lit(" "), F.col("year").cast("string"), F.lit("  "), F.when(F.col("by").isNull(), F.array_join(F.array_repeat(F.lit("-99.90"), 12), "  ")).otherwise(cells)).alias("line"))
    texts = rows.groupBy("index_name").agg(F.min("year").alias("a"), F.max("year").alias("b"), F.array_sort(F.collect_list(F.struct("year", "line"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    texts = texts.select("index_name", F.concat(F.lit("  "), F.col("a").cast("string"), F.lit(" "), F.col("b").cast("string"), F.lit("\n"), body, F.lit("\n  -99.90\n source: made\n")).alias("text"))
    return tables.climate_wide(tables.parse_climate_text(texts), ["mei", "soi"])


@query("write_tables", "SELECT variable, qid, year, month, R(CAST(CAST(value AS FLOAT) AS DOUBLE)) AS value FROM weather_monthly", rounded=3)
def write_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "monthly")
    tables.write_table(example(spark, sf_dir, "weather_monthly"), path, ["variable"])
    return spark.read.parquet(path).select("variable", "qid", "year", "month", F.col("value").cast("double").alias("value"))


@query("write_cube", f"SELECT variable, qid, month, R({LON}) AS lon, R({LAT}) AS lat, R(avg(value)) AS value FROM weather_monthly GROUP BY ALL")
def write_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "cube")
    tables.write_cube(example(spark, sf_dir, "weather_monthly").groupBy("variable", "qid", "month").agg(F.avg("value").alias("value")), path)
    return spark.read.parquet(path).select("variable", "qid", "month", "lon", "lat", "value")


_NEAR = (-60.0, -30.0, 80.0, 30.0)


@query(
    "read_cube",
    f"""SELECT * FROM (SELECT source, variable, qid, year, month, R({LON}) AS lon, R({LAT}) AS lat, R(value) AS value FROM (
  SELECT 'hist' AS source, * FROM hist_monthly UNION ALL SELECT 'stoc', * FROM stoc_monthly)) WHERE lon BETWEEN {_NEAR[0]} AND {_NEAR[2]} AND lat BETWEEN {_NEAR[1]} AND {_NEAR[3]}""",
)
def read_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sources as one stored cube, of which the cells of a box are read."""
    path = scratch(spark, "cube")
    sides = [example(spark, sf_dir, f"{s}_monthly").select(F.lit(s).alias("source"), "variable", "qid", "year", "month", "value") for s in ("hist", "stoc")]
    tables.write_cube(sides[0].unionByName(sides[1]), path)
    return tables.read_cube(spark, path, _NEAR).select("source", "variable", "qid", "year", "month", "lon", "lat", "value")


@query("rain_stream", "SELECT qid, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, R(sum(pre)) AS rsum, count(pre) AS days FROM weather_daily GROUP BY ALL")
def rain_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rain dropped as a folder of files, summed by a stream; the delay spans all years, as drops come in any order here."""
    drops, out, marks = (scratch(spark, n) for n in ("drops", "months", "marks"))
    example(spark, sf_dir, "weather_daily").select("qid", "date", "pre", F.year("date").alias("y")).repartition("y").write.partitionBy("y").parquet(drops)
    stream = rain.read_drops(spark, drops, "qid long, date date, pre double")
    rain.append_changes(rain.monthly_rain(stream, "36500 days"), out, marks).awaitTermination()
    d = rain.latest(spark, out)
    return d.select("qid", F.year("month_start").alias("year"), F.month("month_start").alias("month"), "rsum", "days")
