"""Reference evapotranspiration of daily rows.

Radiation outside the atmosphere depends on a cell's latitude and the day of the
year only. `solar_table` has it once per cell and day, and daily rows join it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fao
from ..functions.stats import corr
from .grid import with_lonlat


def solar_table(cells: DataFrame, res: float = 0.25, cell: str = "qid") -> DataFrame:
    """(cell, doy, lat, dec, sha, ird, daylight, et_rad) for the days 1 to 366."""
    days = with_lonlat(cells.select(cell), res, cell).withColumn("doy", F.explode(F.sequence(F.lit(1), F.lit(366))))
    lat = F.radians("lat")
    d = days.withColumns({"dec": fao.declination(F.col("doy")), "ird": fao.inverse_distance(F.col("doy"))})
    d = d.withColumn("sha", fao.sunset_hour_angle(lat, F.col("dec")))
    return d.select(
        cell, "doy", "lat", "dec", "sha", "ird",
        fao.daylight_hours(F.col("sha")).alias("daylight"),
        fao.extraterrestrial(lat, F.col("dec"), F.col("sha"), F.col("ird")).alias("et_rad"),
    )


def with_solar(daily: DataFrame, res: float = 0.25, cell: str = "qid") -> DataFrame:
    """`daily` with `doy` and `et_rad` by a formula on the cell's latitude: no join and no shuffle."""
    d = with_lonlat(daily, res, cell).withColumn("doy", F.dayofyear("date"))
    lat, dec = F.radians("lat"), fao.declination(F.col("doy"))
    sha = fao.sunset_hour_angle(lat, dec)
    return d.withColumn("et_rad", fao.extraterrestrial(lat, dec, sha, fao.inverse_distance(F.col("doy"))))


def with_elevation(daily: DataFrame, elevation: DataFrame, cell: str = "qid") -> DataFrame:
    """`daily` with `z`; cells without one are at sea level."""
    z = elevation.select(F.col(cell), F.col("z").alias("_z"))
    return daily.join(z, cell, "left").withColumn("z", F.coalesce("_z", F.lit(0.0))).drop("_z")


def hargreaves(daily: DataFrame, res: float = 0.25, cell: str = "qid") -> DataFrame:
    d = with_solar(daily, res, cell)
    return d.withColumn("eto", fao.hargreaves(F.col("tmin"), F.col("tmax"), F.col("et_rad")))


def penman_monteith(daily: DataFrame, elevation: DataFrame, res: float = 0.25, cell: str = "qid") -> DataFrame:
    d = with_solar(with_elevation(daily, elevation, cell), res, cell)
    tmin, tmax = F.col("tmin"), F.col("tmax")
    svp = fao.mean_saturation(tmin, tmax)
    avp = fao.vapour_from_mean_humidity(fao.saturation(tmin), fao.saturation(tmax), F.col("rh"))
    longwave = fao.net_longwave(tmin + 273.15, tmax + 273.15, F.col("rs"), fao.clear_sky(F.col("z"), F.col("et_rad")), avp)
    return d.withColumn(
        "eto",
        fao.penman_monteith(
            fao.net_shortwave(F.col("rs")) - longwave, (tmin + 273.15 + tmax + 273.15) / 2, F.col("u2"), svp, avp,
            fao.saturation_slope((tmin + tmax) / 2), fao.psychrometric(fao.air_pressure(F.col("z"))),
        ),
    )


def compared(daily: DataFrame, elevation: DataFrame, res: float = 0.25, cell: str = "qid") -> DataFrame:
    """(cell, year, harg, pm, r): yearly means of both methods and their correlation."""
    d = penman_monteith(daily, elevation, res, cell).withColumn("pm", F.col("eto"))
    d = d.withColumn("harg", fao.hargreaves(F.col("tmin"), F.col("tmax"), F.col("et_rad")))
    return d.groupBy(cell, F.year("date").alias("year")).agg(F.avg("harg").alias("harg"), F.avg("pm").alias("pm"), corr("harg", "pm").alias("r"))
