"""Queries on cells, grids, masks and distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid
from ..sources.examples import example
from .registry import query

RES = 0.25


def code_sql(lon: str, lat: str, res: float, reach: float, n: int) -> str:
    """A cell's id from its point, digit by digit from the top, in SQL."""
    top = (1 << n) - 1
    ix = f"CAST(least(greatest(floor(({lon} + {reach}e0) / {res}e0), 0), {top}) AS BIGINT)"
    iy = f"CAST(least(greatest(floor(({lat} + {reach}e0) / {res}e0), 0), {top}) AS BIGINT)"
    digit = lambda k: f"(CASE WHEN ({iy} // {1 << k}) % 2 = 1 THEN 1 - ({ix} // {1 << k}) % 2 ELSE 2 + ({ix} // {1 << k}) % 2 END)"
    return "CAST(" + " + ".join(f"{digit(k)} * {4**k}" for k in range(n)) + " AS BIGINT)"


def point_sql(code: str, res: float, reach: float, n: int) -> tuple[str, str]:
    digit = lambda k: f"(({code}) // {4**k}) % 4"
    ix = " + ".join(f"CASE WHEN {digit(k)} IN (0, 3) THEN {1 << k} ELSE 0 END" for k in range(n))
    iy = " + ".join(f"CASE WHEN {digit(k)} < 2 THEN {1 << k} ELSE 0 END" for k in range(n))
    return f"(({ix}) * {res}e0 - {reach}e0 + {res / 2}e0)", f"(({iy}) * {res}e0 - {reach}e0 + {res / 2}e0)"


N = grid.levels(RES)
REACH = RES * 2 ** (N - 1)
QID = code_sql("lon", "lat", RES, REACH, N)
LON, LAT = point_sql("qid", RES, REACH, N)


@query("ll_to_qid", f"SELECT id, CASE WHEN abs(lon) <= 180 AND abs(lat) < 90 THEN {QID} END AS qid FROM points")
def ll_to_qid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return example(spark, sf_dir, "points").select("id", grid.ll_to_qid(F.col("lon"), F.col("lat"), RES).alias("qid"))


@query("qid_to_ll", f"SELECT id, qid, R({LON}) AS lon, R({LAT}) AS lat FROM (SELECT id, {QID} AS qid FROM points)")
def qid_to_ll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.with_lonlat(ll_to_qid(spark, sf_dir), RES)


_QT = code_sql("(lon - 0.1e0)", "(lat + 0.2e0)", 0.5, 128.0, 9)
_QLON, _QLAT = point_sql("qtid", 0.5, 128.0, 9)


@query("ll_to_qtid", f"SELECT id, {_QT} AS qtid FROM points")
def ll_to_qtid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return example(spark, sf_dir, "points").select("id", grid.ll_to_qtid(F.col("lon"), F.col("lat"), 9, 64.0, 0.1, -0.2).alias("qtid"))


@query("qtid_to_ll", f"SELECT id, R({_QLON} + 0.1e0) AS lon, R({_QLAT} - 0.2e0) AS lat FROM (SELECT id, {_QT} AS qtid FROM points)")
def qtid_to_ll(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = grid.qtid_to_ll(F.col("qtid"), 9, 64.0, 0.1, -0.2)
    return ll_to_qtid(spark, sf_dir).select("id", lon.alias("lon"), lat.alias("lat"))


# Grids around the suppliers' points: a 4 by 3 degree box whose corner is the rounded point; boxes go on beyond the date line and end at the pole.
_BOX = """SELECT id, CAST(floor(lon) AS INT) AS x0, CAST(least(floor(lat), 87) AS INT) AS y0 FROM points"""
_GRID = f"""
WITH box AS ({_BOX}),
u AS (SELECT id, x0 + 0.5e0 + i AS x, y0 + 0.5e0 + j AS lat FROM box CROSS JOIN (SELECT unnest(range(4)) AS i) CROSS JOIN (SELECT unnest(range(3)) AS j)),
g AS (SELECT id, x, CASE WHEN x >= 180 THEN x - 360 ELSE x END AS lon, lat FROM u)
"""
_GRID_QID = code_sql("lon", "lat", 1.0, 256.0, 9)


def _corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return example(spark, sf_dir, "points").select("id", F.floor("lon").cast("int").alias("x0"), F.least(F.floor("lat"), F.lit(87)).cast("int").alias("y0"))


def _boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of a world grid at one degree that lie in the boxes, by cell id."""
    box = grid.spread(_corners(spark, sf_dir), "id")
    wanted = box.select("id", F.explode(F.sequence("x0", F.col("x0") + 3)).alias("x"), "y0").select("id", "x", F.explode(F.sequence("y0", F.col("y0") + 2)).alias("y"))
    wanted = wanted.select("id", grid.ll_to_qid(F.when(F.col("x") >= 180, F.col("x") - 359.5).otherwise(F.col("x") + 0.5), F.col("y") + 0.5, 1.0).alias("qid"))
    return wanted.join(grid.make_grid(spark, 1.0), "qid").select("id", "qid", "lon", "lat")


@query("make_grid", f"{_GRID} SELECT id, {_GRID_QID} AS qid, R(lon) AS lon, R(lat) AS lat FROM g")
def make_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxed(spark, sf_dir)


_CORNERS = ((0.5, 0.5), (0.5, -0.5), (-0.5, -0.5), (-0.5, 0.5), (0.5, 0.5))
_WKT = " || ', ' || ".join(f"printf('%.6f %.6f', lon + {x}e0, lat + {y}e0)" for x, y in _CORNERS)


@query("make_grid_polygons", f"{_GRID} SELECT id, {_GRID_QID} AS qid, 'POLYGON ((' || {_WKT} || '))' AS wkt FROM g")
def make_grid_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxed(spark, sf_dir).select("id", "qid", grid.cell_polygon(F.col("lon"), F.col("lat"), 1.0).alias("wkt"))


_RING = ((0.2, 0.1), (3.6, 0.1), (3.6, 1.2), (1.9, 1.2), (1.9, 2.8), (0.2, 2.8))
_EDGES = ", ".join(f"({a[0]}e0, {a[1]}e0, {b[0]}e0, {b[1]}e0)" for a, b in zip(_RING, _RING[1:] + _RING[:1]))


@query(
    "polygon_mask",
    f"""{_GRID}, e(x1, y1, x2, y2) AS (VALUES {_EDGES}),
j AS (SELECT id, x, lon, lat, (y0 + y1 > lat) <> (y0 + y2 > lat) AND x < x0 + x1 + (lat - y0 - y1) * (x2 - x1) / nullif(y2 - y1, 0) AS hit,
  least(greatest(((x - x0 - x1) * (x2 - x1) + (lat - y0 - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0), 1) AS t, x0, y0, x1, y1, x2, y2
  FROM g JOIN box USING (id) CROSS JOIN e),
m AS (SELECT id, lon, lat, sum(CASE WHEN hit THEN 1 ELSE 0 END) AS n,
  min(sqrt((x - x0 - x1 - t * (x2 - x1)) * (x - x0 - x1 - t * (x2 - x1)) + (lat - y0 - y1 - t * (y2 - y1)) * (lat - y0 - y1 - t * (y2 - y1)))) AS gap
  FROM j GROUP BY id, lon, lat)
SELECT id, R(lon) AS lon, R(lat) AS lat, n % 2 = 1 OR gap <= 0.25 AS mask FROM m""",
)
def polygon_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An L-shaped ring in every box, grown by a quarter of a degree; the cells of the world meet the blocks that cover the rings."""
    ring = F.array(*[F.struct((F.col("x0") + x).alias("lon"), (F.col("y0") + y).alias("lat")) for x, y in _RING])
    rings = _corners(spark, sf_dir).select("id", ring.alias("ring"))
    found = grid.polygon_cells(grid.make_grid(spark, 1.0), rings, 1.0, 0.25, "id").select("id", "qid", F.lit(True).alias("mask"))
    return _boxed(spark, sf_dir).join(found, ["id", "qid"], "left").select("id", "lon", "lat", F.coalesce("mask", F.lit(False)).alias("mask"))


@query("area_weights", f"SELECT id, R(sqrt(cos(radians({LAT})))) AS weight FROM (SELECT id, {QID} AS qid FROM points)")
def area_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qid_to_ll(spark, sf_dir).select("id", grid.area_weight(F.col("lat")).alias("weight"))


_KM = """12742e0 * asin(least(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2)
  + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)), 1e0))"""


@query("haversine_self", f"SELECT a.id AS id_a, b.id AS id_b, R(CASE WHEN a.id = b.id THEN 0 ELSE {_KM} END) AS km FROM points a CROSS JOIN points b", rounded=4, positive=True)
def haversine_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.self_distances(example(spark, sf_dir, "points"))


@query("haversine_pairs", f"SELECT a.id AS id_a, b.id AS id_b, R({_KM}) AS km FROM points a CROSS JOIN (SELECT qid AS id, {LON} AS lon, {LAT} AS lat FROM cells) b", rounded=4, positive=True)
def haversine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets of places: every point against every reference cell's centre."""
    cells = grid.with_lonlat(example(spark, sf_dir, "cells")).withColumnRenamed("qid", "id")
    return grid.distances(example(spark, sf_dir, "points"), cells)


@query("haversine_sets", f"SELECT a.id AS id_a, b.id AS id_b, R({_KM}) AS km FROM points a CROSS JOIN customer_points b", rounded=4, positive=True)
def haversine_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two whole sets of places: every supplier's point against every customer's."""
    return grid.distances(example(spark, sf_dir, "points"), example(spark, sf_dir, "customer_points"))


@query("haversine_within", f"SELECT a.id AS id_a, b.id AS id_b, R({_KM}) AS km FROM points a CROSS JOIN points b WHERE {_KM} <= 800", rounded=4)
def haversine_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = example(spark, sf_dir, "points")
    return grid.pairs_within(p, p, 800.0)


@query(
    "attach_lonlat",
    f"""SELECT source, variable, qid, year, month, R({LON}) AS lon, R({LAT}) AS lat, R(value) AS value FROM (
  SELECT 'hist' AS source, * FROM hist_monthly UNION ALL SELECT 'stoc', * FROM stoc_monthly)""",
)
def attach_lonlat(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = example(spark, sf_dir, "hist_monthly").withColumn("source", F.lit("hist")).unionByName(example(spark, sf_dir, "stoc_monthly").withColumn("source", F.lit("stoc")))
    return grid.with_lonlat(both).select("source", "variable", "qid", "year", "month", "lon", "lat", "value")


@query("spatial_bbox", f"SELECT id, R({LON}) AS lon, R({LAT}) AS lat FROM (SELECT id, {QID} AS qid FROM points) WHERE {LON} BETWEEN -60 AND 60 AND {LAT} BETWEEN -30 AND 30")
def spatial_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qid_to_ll(spark, sf_dir).filter("lon between -60 and 60 and lat between -30 and 30").select("id", "lon", "lat")


@query("elevation_of_cells", f"SELECT qid, R({LON}) AS lon, R({LAT}) AS lat, R(z) AS z FROM cells WHERE z IS NOT NULL AND qid IN (SELECT qid FROM weather_monthly)")
def elevation_of_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = example(spark, sf_dir, "weather_monthly").select("qid").distinct()
    return grid.with_lonlat(example(spark, sf_dir, "cells").filter("z is not null").join(used, "qid", "left_semi")).select("qid", "lon", "lat", "z")
