"""Readers and writers of the data model's files. Every one goes through Spark's own readers, so any store that Spark knows will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_monthly_wide(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """(variable, qid, year, month, value) from a file with one column per cell."""
    wide = spark.read.parquet(path)
    cells = [c for c in wide.columns if c not in ("year", "month")]
    long = wide.unpivot(["year", "month"], cells, "qid", "value").filter("value is not null and not isnan(value)")
    return long.select(F.lit(variable).alias("variable"), F.col("qid").cast("long").alias("qid"), "year", "month", "value")


def read_climate(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(year, month, names) from CSV with a header."""
    header = spark.read.option("header", True).csv(path).columns
    schema = ", ".join(f"`{c}` {'int' if c in ('year', 'month') else 'double'}" for c in header)
    return spark.read.schema(schema).option("header", True).csv(path).select("year", "month", *names)


def read_trend(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """(variable, qid, month, slope) from a file with a row per cell and a column per month."""
    wide = spark.read.parquet(path)
    months = [c for c in wide.columns if c != "qid"]
    long = wide.unpivot(["qid"], months, "month", "slope")
    return long.select(F.lit(variable).alias("variable"), F.col("qid").cast("long").alias("qid"), F.col("month").cast("int").alias("month"), "slope")


def read_daily_by_cell(spark: SparkSession, path: str) -> DataFrame:
    """Daily rows of a folder with a file (or a folder) per cell; the cell's id is its name, or what follows = in it."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/(?:[^/=]*=)?(\d+)(?:\.parquet)?(?:/[^/]*)?$", 1)
    return spark.read.option("recursiveFileLookup", True).parquet(path).select("*", name.cast("long").alias("qid"))


def read_elevation(spark: SparkSession, path: str) -> DataFrame:
    """(qid, z) from CSV without a header."""
    return spark.read.schema("qid long, z double").csv(path)


def parse_climate_text(texts: DataFrame, name: str = "index_name", text: str = "text") -> DataFrame:
    """(index_name, year, month, value) from whole texts: a line of first and last year, a line per year, the missing flag.

    The flag may stand with other words after it; lines that do not start with a year are left out.
    """
    lines = F.transform(F.split(F.trim(text), r"\r?\n"), lambda s: F.split(F.trim(s), r"\s+"))
    d = texts.select(name, lines.alias("_lines"))
    count = (F.try_element_at(F.col("_lines")[0], F.lit(2)).cast("int") - F.col("_lines")[0][0].cast("int") + 1).alias("_n")
    d = d.select(name, "_lines", count)
    flag = F.get(F.col("_lines"), F.col("_n") + 1)[0].cast("double")
    d = d.select(name, flag.alias("_flag"), F.explode(F.slice("_lines", F.lit(2), F.col("_n"))).alias("_row"))
    d = d.select(name, "_flag", F.col("_row")[0].cast("int").alias("year"), F.posexplode(F.slice("_row", 2, 12)).alias("_i", "_value"))
    value = F.col("_value").cast("double")
    return d.select(name, "year", (F.col("_i") + 1).alias("month"), F.when(value == F.col("_flag"), None).otherwise(value).alias("value"))


def climate_wide(long: DataFrame, names: list[str], name: str = "index_name") -> DataFrame:
    """(year, month, a column per index)."""
    return long.groupBy("year", "month").pivot(name, names).agg(F.first("value"))


def write_table(df: DataFrame, path: str, by: list[str] | None = None, fmt: str = "parquet") -> None:
    """Writes a table, in folders by `by`; floats are narrowed to 32 bits, as the stored products are."""
    narrow = df.select(*[F.col(c).cast("float").alias(c) if t == "double" and fmt == "parquet" else F.col(c) for c, t in df.dtypes])
    writer = narrow.write.mode("errorifexists")
    if by:
        writer = writer.partitionBy(*by)
    writer.option("header", True).format(fmt).save(path)


def write_cube(df: DataFrame, path: str, res: float = 0.25, files: int | None = None) -> None:
    """Writes a cell table in long form with its coordinates, laid out by cell id: neighbouring cells lie in one file and in one row group.

    Ids follow the quadtree, so a box of the map is a few ranges of them, which `read_cube` asks for. Where
    `files` is not given, Spark sizes them.
    """
    from ..operators.grid import with_lonlat

    out = with_lonlat(df, res)
    first = [c for c in out.columns if c not in ("lon", "lat")]
    ranged = out.repartitionByRange("qid") if files is None else out.repartitionByRange(files, "qid")
    ranged.sortWithinPartitions("qid").select(*first, "lat", "lon").write.mode("errorifexists").parquet(path)


def read_cube(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, res: float = 0.25, ranges: int = 32) -> DataFrame:
    """A stored cube, or its cells with centres in a box (west, south, east, north), ends included; west above east runs over the date line.

    The box becomes at most `ranges` ranges of cell ids, which Parquet's statistics
    answer without reading the row groups of other places; the coordinates decide.
    """
    from ..operators.grid import box_ranges

    cube = spark.read.parquet(path)
    if box is None:
        return cube
    west, south, east, north = box
    near = F.lit(False)
    for a, b in box_ranges(west, south, east, north, res, ranges):
        near = near | F.col("qid").between(a, b)
    across = F.col("lon").between(west, east) if west <= east else (F.col("lon") >= west) | (F.col("lon") <= east)
    return cube.filter(near).filter(across & F.col("lat").between(south, north))
