"""Queries on daily weather: evapotranspiration, indices, thresholds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fao, normal
from ..operators import eto, grid, indices
from ..sources.examples import example
from .places import LAT, LON
from .registry import query

DAILY, CELLS = "weather_daily", "cells"
_2PI = f"{2 * math.pi / 365!r}"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return example(spark, sf_dir, DAILY)


# The formulas once more in SQL, as common table expressions on top of each other.
_SOLAR = f"""
WITH s0 AS (SELECT *, CAST(dayofyear(date) AS DOUBLE) AS doy, {LAT} AS lat, radians({LAT}) AS rlat FROM weather_daily),
s1 AS (SELECT *, 0.409e0 * sin({_2PI} * doy - 1.39e0) AS dc, 1 + 0.033e0 * cos({_2PI} * doy) AS ird FROM s0),
s2 AS (SELECT *, acos(least(greatest(-tan(rlat) * tan(dc), -1e0), 1e0)) AS sha FROM s1),
s AS (SELECT *, {24 * 60 / math.pi!r} * 0.0820e0 * ird * (sha * sin(rlat) * sin(dc) + cos(rlat) * cos(dc) * sin(sha)) AS ra FROM s2)"""
_SVP = "(0.6108e0 * exp(17.27e0 * {0} / ({0} + 237.3e0)))"
_PM = _SOLAR + f""",
p0 AS (SELECT s.*, coalesce(z, 0e0) AS alt FROM s LEFT JOIN cells USING (qid)),
p1 AS (SELECT *, ({_SVP.format('tmin')} + {_SVP.format('tmax')}) / 2 AS es, rh / 100 * ({_SVP.format('tmin')} + {_SVP.format('tmax')}) / 2 AS ea,
  (0.00002e0 * alt + 0.75e0) * ra AS cs, 0.000665e0 * 101.3e0 * pow((293 - 0.0065e0 * alt) / 293, 5.26e0) AS psy,
  4098 * {_SVP.format('((tmin + tmax) / 2)')} / pow((tmin + tmax) / 2 + 237.3e0, 2) AS delta FROM p0),
p2 AS (SELECT *, 0.77e0 * rs - 0.000000004903e0 * (pow(tmax + 273.15e0, 4) + pow(tmin + 273.15e0, 4)) / 2 * (0.34e0 - 0.14e0 * sqrt(ea)) * (1.35e0 * rs / cs - 0.35e0) AS rn FROM p1),
p AS (SELECT *, 0.408e0 * rn * delta / (delta + psy * (1 + 0.34e0 * u2)) + 900 * u2 / ((tmin + tmax) / 2 + 273.15e0) * (es - ea) * psy / (delta + psy * (1 + 0.34e0 * u2)) AS pm,
  0.0023e0 * ((tmin + tmax) / 2 + 17.8e0) * sqrt(tmax - tmin) * 0.408e0 * ra AS harg FROM p2)"""


# Evapotranspiration by Hargreaves of a table with qid, date, tmin and tmax; none where tmax is under tmin.
eto_sql = lambda d: f"""(SELECT *, CASE WHEN tmax >= tmin THEN 0.0023e0 * ((tmin + tmax) / 2 + 17.8e0) * sqrt(CASE WHEN tmax >= tmin THEN tmax - tmin END) * 0.408e0
  * {24 * 60 / math.pi!r} * 0.0820e0 * ird * (sha * sin(rlat) * sin(dc) + cos(rlat) * cos(dc) * sin(sha)) END AS eto
  FROM (SELECT *, acos(least(greatest(-tan(rlat) * tan(dc), -1e0), 1e0)) AS sha
  FROM (SELECT *, radians({LAT}) AS rlat, 0.409e0 * sin({2 * math.pi / 365!r} * dayofyear(date) - 1.39e0) AS dc, 1 + 0.033e0 * cos({2 * math.pi / 365!r} * dayofyear(date)) AS ird FROM {d})))"""  # noqa: E731


@query(
    "solar_geometry",
    _SOLAR + f" SELECT DISTINCT qid, CAST(doy AS INT) AS doy, R(dc) AS dec, R(sha) AS sha, R(ird) AS ird, R({24 / math.pi!r} * sha) AS daylight, R(ra) AS et_rad FROM s",
)
def solar_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = daily(spark, sf_dir).select("qid", F.dayofyear("date").alias("doy")).distinct()
    table = eto.solar_table(days.select("qid").distinct())
    return table.join(days, ["qid", "doy"], "left_semi").select("qid", "doy", "dec", "sha", "ird", "daylight", "et_rad")


@query(
    "vapour_pressure",
    f"""SELECT qid, date, R({_SVP.format('tmax')}) AS svp, R(({_SVP.format('tmin')} + {_SVP.format('tmax')}) / 2) AS mean_svp,
  R(4098 * {_SVP.format('tmax')} / pow(tmax + 237.3e0, 2)) AS delta, R(0.611e0 * exp(17.27e0 * tmin / (tmin + 237.3e0))) AS from_tmin,
  R(({_SVP.format('tmin')} * rh / 100 + {_SVP.format('tmax')} * (rh / 2) / 100) / 2) AS from_min_max, R({_SVP.format('tmin')} * rh / 100) AS from_max,
  R(rh / 100 * ({_SVP.format('tmin')} + {_SVP.format('tmax')}) / 2) AS from_mean, R({_SVP.format('(tmin - 2)')}) AS from_dew,
  R({_SVP.format('tmin')} - 0.0673e0 * (tmax - tmin)) AS from_wet FROM weather_daily""",
)
def vapour_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    tmin, tmax, rh = F.col("tmin"), F.col("tmax"), F.col("rh")
    low, high = fao.saturation(tmin), fao.saturation(tmax)
    return daily(spark, sf_dir).select(
        "qid", "date", high.alias("svp"), fao.mean_saturation(tmin, tmax).alias("mean_svp"), fao.saturation_slope(tmax).alias("delta"), fao.vapour_from_tmin(tmin).alias("from_tmin"),
        fao.vapour_from_humidities(low, high, rh / 2, rh).alias("from_min_max"), fao.vapour_from_max_humidity(low, rh).alias("from_max"),
        fao.vapour_from_mean_humidity(low, high, rh).alias("from_mean"), fao.vapour_from_dew(tmin - 2).alias("from_dew"),
        fao.vapour_from_wet_bulb(tmin, tmax, low, F.lit(0.0673)).alias("from_wet"),
    )


@query(
    "humidity_pressure",
    """SELECT qid, date, R(100 * 1.5e0 / (2 + u2)) AS rh, R(kpa) AS pressure, R(0.000665e0 * kpa) AS psy,
  R(kpa * CASE CAST(day(date) AS INT) % 3 WHEN 0 THEN 0.000662e0 WHEN 1 THEN 0.0008e0 ELSE 0.0012e0 END) AS psy_of
FROM (SELECT w.*, 101.3e0 * pow((293 - 0.0065e0 * coalesce(z, 0)) / 293, 5.26e0) AS kpa FROM weather_daily w LEFT JOIN cells USING (qid))""",
)
def humidity_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = eto.with_elevation(daily(spark, sf_dir), example(spark, sf_dir, CELLS))
    p = fao.air_pressure(F.col("z"))
    return d.select(
        "qid", "date", fao.relative_humidity(F.lit(1.5), 2 + F.col("u2")).alias("rh"), p.alias("pressure"), fao.psychrometric(p).alias("psy"),
        fao.psychrometric_of(F.day("date") % 3 + 1, p).alias("psy_of"),
    )


@query(
    "radiation_balance",
    _PM + """ SELECT qid, date, R(cs) AS clear_sky, R(0.77e0 * rs) AS shortwave, R(0.77e0 * rs - rn) AS longwave, R(rn) AS net, R(0.408e0 * rn) AS evaporation FROM p""",
)
def radiation_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = eto.with_solar(eto.with_elevation(daily(spark, sf_dir), example(spark, sf_dir, CELLS)))
    tmin, tmax = F.col("tmin"), F.col("tmax")
    d = d.withColumn("cs", fao.clear_sky(F.col("z"), F.col("et_rad")))
    avp = fao.vapour_from_mean_humidity(fao.saturation(tmin), fao.saturation(tmax), F.col("rh"))
    d = d.withColumns({"sw": fao.net_shortwave(F.col("rs")), "lw": fao.net_longwave(tmin + 273.15, tmax + 273.15, F.col("rs"), F.col("cs"), avp)})
    net = F.col("sw") - F.col("lw")
    return d.select("qid", "date", F.col("cs").alias("clear_sky"), F.col("sw").alias("shortwave"), F.col("lw").alias("longwave"), net.alias("net"), fao.evaporation_of(net).alias("evaporation"))


@query(
    "solar_radiation_fill",
    _SOLAR
    + f""" SELECT qid, date, R(0.7e0 * ra - 4) AS island, R(coalesce(CASE WHEN u2 < 2 THEN rs END,
  CASE WHEN u2 < 3 THEN (0.5e0 * (rs / 4) / ({24 / math.pi!r} * sha) + 0.25e0) * ra END,
  least(CASE WHEN qid % 2 = 1 THEN 0.19e0 ELSE 0.16e0 END * sqrt(tmax - tmin) * ra, 0.75e0 * ra))) AS rs FROM s""",
)
def solar_radiation_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured radiation where wind is low (as if it had been measured there only), else from sun hours, else from temperature."""
    d = eto.with_solar(daily(spark, sf_dir))
    lat, dec = F.radians("lat"), fao.declination(F.col("doy"))
    light = fao.daylight_hours(fao.sunset_hour_angle(lat, dec))
    ra = F.col("et_rad")
    filled = F.coalesce(
        F.when(F.col("u2") < 2, F.col("rs")),
        F.when(F.col("u2") < 3, fao.radiation_from_sun_hours(light, F.col("rs") / 4, ra)),
        fao.radiation_from_temperature(ra, fao.clear_sky(F.lit(0.0), ra), F.col("tmin"), F.col("tmax"), F.col("qid") % 2 == 1),
    )
    return d.select("qid", "date", fao.radiation_of_island(ra).alias("island"), filled.alias("rs"))


@query("wind_at_2m", "SELECT qid, date, R(u2 * (4.87e0 / ln(67.8e0 * 10 - 5.42e0))) AS u2 FROM weather_daily")
def wind_at_2m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir).select("qid", "date", fao.wind_at_2m(F.col("u2"), F.lit(10.0)).alias("u2"))


@query(
    "soil_heat_flux",
    """SELECT qid, year, month, R(0.07e0 * (lead(t) OVER w - lag(t) OVER w)) AS flux, R(0.14e0 * (t - lag(t) OVER w)) AS flux_to_now
FROM (SELECT qid, year, month, (tmin + tmax) / 2 AS t FROM month_wide) WINDOW w AS (PARTITION BY qid ORDER BY year, month)""",
)
def soil_heat_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("qid").orderBy("year", "month")
    d = example(spark, sf_dir, "month_wide").withColumn("t", (F.col("tmin") + F.col("tmax")) / 2)
    return d.select("qid", "year", "month", (0.07 * (F.lead("t").over(w) - F.lag("t").over(w))).alias("flux"), (0.14 * (F.col("t") - F.lag("t").over(w))).alias("flux_to_now"))


@query("daily_mean_temp", "SELECT qid, date, R((tmin + tmax) / 2) AS t FROM weather_daily")
def daily_mean_temp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir).select("qid", "date", ((F.col("tmin") + F.col("tmax")) / 2).alias("t"))


@query("eto_hargreaves", _PM + " SELECT qid, date, R(harg) AS eto FROM p")
def eto_hargreaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eto.hargreaves(daily(spark, sf_dir)).select("qid", "date", "eto")


@query("eto_penman_monteith", _PM + " SELECT qid, date, R(pm) AS eto FROM p")
def eto_penman_monteith(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eto.penman_monteith(daily(spark, sf_dir), example(spark, sf_dir, CELLS)).select("qid", "date", "eto")


@query("eto_compare", _PM + " SELECT qid, CAST(year(date) AS INT) AS year, R(avg(harg)) AS harg, R(avg(pm)) AS pm, R(corr(harg, pm)) AS r FROM p GROUP BY ALL")
def eto_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eto.compared(daily(spark, sf_dir), example(spark, sf_dir, CELLS))


# Indices


@query(
    "spell_length",
    """WITH f AS (SELECT qid, date, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, pre > 1 AS wet FROM weather_daily),
r AS (SELECT *, row_number() OVER (PARTITION BY qid, year, month ORDER BY date) AS k FROM f),
i AS (SELECT *, k - row_number() OVER (PARTITION BY qid, year, month ORDER BY date) AS island FROM r WHERE wet)
SELECT qid, year, month, min(date) AS start, count(*) AS days FROM i GROUP BY qid, year, month, island""",
)
def spell_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indices.spells(daily(spark, sf_dir).withColumn("wet", F.col("pre") > 1), "wet")


_MONTHS = "CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month"


@query(
    "month_pctl_flags",
    """WITH q AS (SELECT qid, month(date) AS m, quantile_cont(pre, 0.05) AS lo, quantile_cont(pre, 0.95) AS hi FROM weather_daily GROUP BY ALL)
SELECT qid, date, R(lo) AS pre_p05, R(hi) AS pre_p95, pre <= lo AS low, pre > hi AS high FROM weather_daily JOIN q USING (qid) WHERE m = month(date)""",
)
def month_pctl_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir)
    p = indices.month_percentiles(d, ["pre"])
    d = d.withColumn("month", F.month("date")).join(p, ["qid", "month"])
    return d.select("qid", "date", "pre_p05", "pre_p95", (F.col("pre") <= F.col("pre_p05")).alias("low"), (F.col("pre") > F.col("pre_p95")).alias("high"))


def _runs(flag: str, name: str, base: str = "d") -> str:
    return f"""{name} AS (SELECT qid, year, month, max(n) AS n FROM (SELECT qid, year, month, count(*) AS n FROM (
  SELECT qid, year, month, k - row_number() OVER (PARTITION BY qid, year, month ORDER BY date) AS island FROM {base} WHERE {flag}) GROUP BY qid, year, month, island) GROUP BY ALL)"""


_ROLL = lambda v, n, how: f"CASE WHEN count({v}) OVER (PARTITION BY qid ORDER BY date ROWS {n - 1} PRECEDING) = {n} THEN {how}({v}) OVER (PARTITION BY qid ORDER BY date ROWS {n - 1} PRECEDING) END"
_RAIN = f"""
WITH q AS (SELECT qid, month(date) AS m, quantile_cont(pre, 0.05) AS lo, quantile_cont(pre, 0.95) AS hi FROM weather_daily GROUP BY ALL),
d AS (SELECT *, {_MONTHS}, row_number() OVER (PARTITION BY qid, year(date), month(date) ORDER BY date) AS k, {_ROLL('pre', 2, 'sum')} AS p2, {_ROLL('pre', 3, 'sum')} AS p3
  FROM weather_daily JOIN q USING (qid) WHERE m = month(date)),
d2 AS (SELECT qid, date, {_ROLL('pre', 2, 'sum')} AS p2, {_ROLL('pre', 3, 'sum')} AS p3 FROM weather_daily),
{_runs('pre <= lo', 'rl')}, {_runs('pre > hi', 'rh')},
a AS (SELECT d.qid, d.year, d.month, sum(pre) AS rsum, CAST(sum(CASE WHEN pre > 1 THEN 1 ELSE 0 END) AS DOUBLE) AS rday, CAST(sum(CASE WHEN pre <= lo THEN 1 ELSE 0 END) AS DOUBLE) AS r_count_lt_p05,
  CAST(sum(CASE WHEN pre > hi THEN 1 ELSE 0 END) AS DOUBLE) AS r_count_gt_p95, sum(greatest(pre - hi, 0)) AS r_sum_gt_p95, max(pre) AS pre24, max(d2.p2) AS pre48, max(d2.p3) AS pre72
  FROM d JOIN d2 USING (qid, date) GROUP BY ALL),
m AS (SELECT a.*, CAST(coalesce(rl.n, 0) AS DOUBLE) AS r_spell_lt_p05, CAST(coalesce(rh.n, 0) AS DOUBLE) AS r_spell_gt_p95 FROM a LEFT JOIN rl USING (qid, year, month) LEFT JOIN rh USING (qid, year, month))"""
_RAIN_LONG = "UNPIVOT m ON rsum, rday, r_count_lt_p05, r_count_gt_p95, r_sum_gt_p95, pre24, pre48, pre72, r_spell_lt_p05, r_spell_gt_p95 INTO NAME index_name VALUE value"


@query("index_pre", _RAIN + f" SELECT qid, year, month, index_name, R(value) AS value FROM ({_RAIN_LONG})")
def index_pre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indices.index_pre(daily(spark, sf_dir))


@query("index_pre_all")
def index_pre_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All indices of rain: sums, counts, spells, SPI, and with ETo by Hargreaves its sum and SPEI."""
    return indices.index_pre(eto.hargreaves(daily(spark, sf_dir)), eto=True, spi=True)


_BAL = f"be AS (SELECT qid, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, sum(eto) AS eto, sum(pre) - sum(eto) AS value FROM {eto_sql('weather_daily')} GROUP BY ALL)"
_RANKED = lambda n: f"""SELECT qid, year, month, 'spei{n}' AS index_name, R({normal.ppf_sql('p')}) AS value FROM (
  SELECT *, (k - CASE WHEN n <= 10 THEN 0.375e0 ELSE 0.5e0 END) / (n + 1 - 2 * CASE WHEN n <= 10 THEN 0.375e0 ELSE 0.5e0 END) AS p FROM (
  SELECT *, count(*) OVER (PARTITION BY qid, month) AS n, row_number() OVER (PARTITION BY qid, month ORDER BY value, year) AS k FROM (
  SELECT qid, year, month, CASE WHEN count(value) OVER w = {n} THEN sum(value) OVER w END AS value FROM be WINDOW w AS (PARTITION BY qid ORDER BY year, month ROWS {n - 1} PRECEDING)) WHERE value IS NOT NULL))"""  # noqa: E731


@query(
    "index_pre_eto",
    _RAIN + f", {_BAL} SELECT qid, year, month, index_name, R(value) AS value FROM ({_RAIN_LONG}) UNION ALL SELECT qid, year, month, 'eto', R(eto) FROM be UNION ALL " + " UNION ALL ".join(map(_RANKED, (1, 3, 6))),
)
def index_pre_eto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With ETo by Hargreaves: also its monthly sum and SPEI."""
    return indices.index_pre(eto.hargreaves(daily(spark, sf_dir)), eto=True)


_TMP_FLAGS = {
    **{f"{v}_{{}}_lt_p05": (f"{v} <= {v}_p05", f"{v}_p05 - {v}") for v in ("tmax", "tmin")},
    **{f"{v}_{{}}_gt_p95": (f"{v} > {v}_p95", f"{v} - {v}_p95") for v in ("tmax", "tmin")},
    **{f"{v}_{{}}_gt_{t}": (f"{v} > {t}", f"{v} - {t}") for v, ts in (("tmax", (35, 40)), ("tmin", (15, 20))) for t in ts},
    "tmin_{}_lt_0": ("tmin <= 0", "0 - tmin"),
}
_TMP = f"""
WITH q AS (SELECT qid, month(date) AS m, {', '.join(f"quantile_cont({v}, {p}) AS {v}_{n}" for v in ('tmax', 'tmin') for p, n in ((0.05, 'p05'), (0.95, 'p95')))} FROM weather_daily GROUP BY ALL),
w AS (SELECT *, {_MONTHS}, month(date) AS m, row_number() OVER (PARTITION BY qid, year(date), month(date) ORDER BY date) AS k,
  {', '.join(f"{_ROLL(v, n, 'avg')} AS {v}_{n}d" for v in ('tmax', 'tmin') for n in (2, 3))} FROM weather_daily),
d AS (SELECT * FROM w JOIN q USING (qid, m)),
{', '.join(_runs(f, 's_' + k.format('spell')) for k, (f, _) in _TMP_FLAGS.items())},
a AS (SELECT qid, year, month, avg(tmax) AS tmax_mean, avg(tmin) AS tmin_mean, avg(tmax) - avg(tmin) AS dtr_mean,
  {', '.join(f"CAST(sum(CASE WHEN {f} THEN 1 ELSE 0 END) AS DOUBLE) AS {k.format('count')}, CAST(sum(greatest({e}, 0)) AS DOUBLE) AS {k.format('sum')}" for k, (f, e) in _TMP_FLAGS.items())},
  max(tmax) AS tmax24, max(tmax_2d) AS tmax48, max(tmax_3d) AS tmax72, min(tmin) AS tmin24, min(tmin_2d) AS tmin48, min(tmin_3d) AS tmin72 FROM d GROUP BY ALL),
m AS (SELECT a.*, {', '.join(f"CAST(coalesce(s_{k.format('spell')}.n, 0) AS DOUBLE) AS {k.format('spell')}" for k in _TMP_FLAGS)} FROM a
  {' '.join(f"LEFT JOIN s_{k.format('spell')} USING (qid, year, month)" for k in _TMP_FLAGS)})
SELECT qid, year, month, index_name, R(value) AS value FROM (UNPIVOT m ON COLUMNS(* EXCLUDE (qid, year, month)) INTO NAME index_name VALUE value)"""


@query("index_tmp", _TMP)
def index_tmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indices.index_tmp(daily(spark, sf_dir))


@query(
    "degree_days",
    f"SELECT qid, {_MONTHS}, CAST(t AS DOUBLE) AS threshold, R(sum(greatest(tmax - t, 0))) AS degree_days FROM weather_daily CROSS JOIN (VALUES (30), (35)) AS v(t) GROUP BY ALL",
)
def degree_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indices.degree_days(daily(spark, sf_dir), "tmax", (30, 35))


_BALANCE = "(SELECT qid, year, month, pre AS value FROM month_wide)"
_RMS = lambda n: f"(SELECT * FROM (SELECT qid, year, month, CASE WHEN count(*) OVER w = {n} THEN sum(value) OVER w END AS value FROM {_BALANCE} WINDOW w AS (PARTITION BY qid ORDER BY year, month ROWS {n - 1} PRECEDING)) WHERE value IS NOT NULL)"


def _rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return example(spark, sf_dir, "month_wide").select("qid", "year", "month", F.col("pre").alias("value"))


@query("rolling_month_sum", f"SELECT qid, year, month, R(value) AS value FROM {_RMS(3)}")
def rolling_month_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indices.rolling_month(_rain(spark, sf_dir), 3)


@query(
    "spei_ecdf",
    f"""WITH c AS (SELECT *, count(*) OVER (PARTITION BY qid, month) AS n, row_number() OVER (PARTITION BY qid, month ORDER BY value, year) AS k FROM {_RMS(3)}),
p AS (SELECT *, (k - CASE WHEN n <= 10 THEN 0.375e0 ELSE 0.5e0 END) / (n + 1 - 2 * CASE WHEN n <= 10 THEN 0.375e0 ELSE 0.5e0 END) AS p FROM c)
SELECT qid, year, month, R(value) AS value, R({normal.ppf_sql('p')}) AS spei FROM p""",
)
def spei_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indices.spei_ecdf(_rain(spark, sf_dir), 3)


def _moments_sql(plotting: bool) -> str:
    if plotting:
        a = [f"sum(value * pow(1 - (j - 0.35e0) / n, {r}) / n)" for r in range(4)]
    else:
        a = ["sum(value / n)", "sum(value * (n - j) / nullif(n * (n - 1), 0))", "sum(value * (n - j) * (n - j - 1) / nullif(n * (n - 1) * (n - 2), 0))", "sum(value * (n - j) * (n - j - 1) * (n - j - 2) / nullif(n * (n - 1) * (n - 2) * (n - 3), 0))"]
    return f"""r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid, month ORDER BY value) AS DOUBLE) AS j, CAST(count(*) OVER (PARTITION BY qid, month) AS DOUBLE) AS n FROM {_RMS(3)}),
a AS (SELECT qid, month, count(*) AS n, {', '.join(f'{x} AS a{i}' for i, x in enumerate(a))} FROM r GROUP BY qid, month),
l AS (SELECT qid, month, n, a0 AS l1, a0 - 2 * a1 AS l2, a0 - 6 * a1 + 6 * a2 AS l3, a0 - 12 * a1 + 30 * a2 - 20 * a3 AS l4 FROM a),
g0 AS (SELECT *, -l3 / nullif(l2, 0) AS k FROM l),
g1 AS (SELECT *, l2 * sin(k * pi()) / nullif(k * pi(), 0) AS alpha FROM g0),
g AS (SELECT *, l1 - alpha * (1 / nullif(k, 0) - pi() / nullif(sin(k * pi()), 0)) AS xi FROM g1),
y0 AS (SELECT x.*, k, alpha, 1 - k * ((x.value - xi) / nullif(alpha, 0)) AS t FROM {_RMS(3)} x JOIN g USING (qid, month)),
y AS (SELECT *, CASE WHEN t > 0 THEN -ln(t) / nullif(k, 0) END AS y FROM y0)"""


@query("l_moments", f"WITH {_moments_sql(False)} SELECT qid, month, n, R(l1) AS l1, R(l2) AS l2, R(l3) AS l3, R(l4) AS l4, R(l2 / nullif(l2, 0)) AS t2, R(l3 / nullif(l2, 0)) AS t3, R(l4 / nullif(l2, 0)) AS t4 FROM l")
def l_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indices.l_moments(indices.rolling_month(_rain(spark, sf_dir), 3), ["qid", "month"])


def _spei_l(plotting: bool) -> str:
    return f"WITH {_moments_sql(plotting)}, p AS (SELECT *, 1 / (1 + exp(-y)) AS p FROM y) SELECT qid, year, month, R(value) AS value, R({normal.ppf_sql('p')}) AS spei FROM p"


@query("spei_lmoment", _spei_l(False), rounded=5)
def spei_lmoment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indices.spei_lmoment(_rain(spark, sf_dir), 3)


@query("spei_lmoment_pp", _spei_l(True), rounded=5)
def spei_lmoment_pp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indices.spei_lmoment(_rain(spark, sf_dir), 3, plotting=True)


@query("genlogistic_density", f"WITH {_moments_sql(False)} SELECT qid, year, month, R(exp(-(1 - k) * y) / alpha / pow(1 + exp(-y), 2)) AS density FROM y")
def genlogistic_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = indices.rolling_month(_rain(spark, sf_dir), 3)
    p = indices.genlogistic_params(indices.l_moments(d, ["qid", "month"])).select("qid", "month", "k", "alpha", "xi")
    return d.join(p, ["qid", "month"]).select("qid", "year", "month", indices.genlogistic_pdf(F.col("value"), F.col("k"), F.col("alpha"), F.col("xi")).alias("density"))


# Row predicates


@query("wet_dry_threshold", "SELECT qid, date, R(CASE WHEN pre >= 1 THEN pre ELSE 0 END) AS pre FROM weather_daily")
def wet_dry_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir).select("qid", "date", F.when(F.col("pre") >= 1, F.col("pre")).otherwise(0.0).alias("pre"))


@query("clip_bounds", "SELECT qid, date, R(coalesce(greatest(least(tmax, 40e0), 20e0), 0)) AS tmax, R(coalesce(greatest(least(pre, 10e0), 0e0), 0)) AS pre FROM weather_daily")
def clip_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    clip = lambda c, lo, hi: F.coalesce(F.greatest(F.least(c, F.lit(hi)), F.lit(lo)), F.lit(0.0)).alias(c)
    return daily(spark, sf_dir).select("qid", "date", clip("tmax", 20.0, 40.0), clip("pre", 0.0, 10.0))


@query("reference_cells", "SELECT qid, date, R(pre) AS pre, R(tmax) AS tmax FROM weather_daily WHERE qid IN (2116266, 757942)")
def reference_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir).filter(F.col("qid").isin(2116266, 757942)).select("qid", "date", "pre", "tmax")


@query("flagship", _RAIN + f" SELECT qid, {LON} AS lon, {LAT} AS lat, year, month, index_name, R(value) AS value FROM ({_RAIN_LONG})")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days to rain indices with coordinates: what `entry` runs."""
    return grid.with_lonlat(indices.index_pre(daily(spark, sf_dir))).select("qid", "lon", "lat", "year", "month", "index_name", "value")
