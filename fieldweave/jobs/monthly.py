"""Queries on monthly and seasonal tables: trends, mapping, patterns, analogues, validation."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normal
from ..operators import analytics, distributions, eto, grid, rebuild, seasonal, trend
from ..sources.examples import example
from ..sources.scratch import stored
from .daily import eto_sql
from .places import LAT, LON
from .registry import query

KEYS = ["variable", "qid"]
_YM = "variable, qid, year, month"

# Trends

_YEARLY = "y AS (SELECT qid, year, sum(pre) AS value FROM month_wide GROUP BY ALL HAVING count(*) = 12)"


def _yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return example(spark, sf_dir, "month_wide").groupBy("qid", "year").agg(F.sum("pre").alias("value"), F.count("*").alias("n")).filter("n = 12").drop("n")


@query(
    "mann_kendall",
    f"""WITH {_YEARLY}, s AS (SELECT a.qid, CAST(sum(sign(b.value - a.value)) AS DOUBLE) AS s FROM y a JOIN y b ON a.qid = b.qid AND a.year < b.year GROUP BY ALL),
t AS (SELECT qid, sum(t) AS n, sum(t * (t - 1)) AS tied, sum(t * (t - 1) * (2 * t + 5)) AS v FROM (SELECT qid, value, count(*) AS t FROM y GROUP BY ALL) GROUP BY qid),
z AS (SELECT qid, CAST(n AS BIGINT) AS n, s, 2 * s / (sqrt(n * (n - 1)) * sqrt(n * (n - 1) - tied)) AS tau, -abs(s / sqrt((n * (n - 1) * (2 * n + 5) - v) / 18e0)) AS z FROM s JOIN t USING (qid))
SELECT qid, n, R(s) AS s, R(tau) AS tau, R(2 * {normal.cdf_sql('z')}) AS p FROM z""",
)
def mann_kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.mann_kendall(_yearly(spark, sf_dir), ["qid"], "year")


_DAYS = "y AS (UNPIVOT (SELECT qid, date, pre, tmax, tmin, rs, rh, u2 FROM weather_daily) ON pre, tmax, tmin, rs, rh, u2 INTO NAME variable VALUE value)"


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["pre", "tmax", "tmin", "rs", "rh", "u2"]
    return example(spark, sf_dir, "weather_daily").unpivot(["qid", "date"], names, "variable", "value").filter("value is not null")


@query(
    "mann_kendall_daily",
    f"""WITH {_DAYS}, s AS (SELECT a.variable, a.qid, CAST(sum(sign(b.value - a.value)) AS DOUBLE) AS s FROM y a JOIN y b ON a.variable = b.variable AND a.qid = b.qid AND a.date < b.date GROUP BY ALL),
t AS (SELECT variable, qid, sum(t) AS n, sum(t * (t - 1)) AS tied, sum(t * (t - 1) * (2 * t + 5)) AS v FROM (SELECT variable, qid, value, count(*) AS t FROM y GROUP BY ALL) GROUP BY ALL),
z AS (SELECT variable, qid, CAST(n AS BIGINT) AS n, s, 2 * s / (sqrt(n * (n - 1)) * sqrt(n * (n - 1) - tied)) AS tau, -abs(s / sqrt((n * (n - 1) * (2 * n + 5) - v) / 18e0)) AS z FROM s JOIN t USING (variable, qid))
SELECT variable, qid, n, R(s) AS s, R(tau) AS tau, R(2 * {normal.cdf_sql('z')}) AS p FROM z""",
)
def mann_kendall_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every variable's days, cell by cell."""
    return trend.mann_kendall(_days(spark, sf_dir), KEYS, "date")


@query("theil_sen_daily")
def theil_sen_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every variable's days, cell by cell; the slopes of all pairs are too many for SQL."""
    return trend.theil_sen(_days(spark, sf_dir), KEYS, "date")


@query("mann_kendall_exact")
def mann_kendall_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the exact p of short series without ties."""
    return trend.mann_kendall(_yearly(spark, sf_dir), ["qid"], "year", exact=True)


@query(
    "theil_sen",
    f"""WITH {_YEARLY}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY year) - 1 AS t FROM y),
p AS (SELECT a.qid, (b.value - a.value) / (b.t - a.t) AS slope FROM r a JOIN r b ON a.qid = b.qid AND a.t < b.t),
n AS (SELECT qid, count(*) AS n, median(value) AS y, median(t) AS x FROM r GROUP BY qid),
v AS (SELECT qid, sum(t * (t - 1) * (2 * t + 5)) AS v FROM (SELECT qid, value, count(*) AS t FROM r GROUP BY ALL) GROUP BY qid),
b AS (SELECT qid, y, x, n * (n - 1) / 2 AS m, sqrt((n * (n - 1) * (2 * n + 5) - v) / 18e0) AS s FROM n JOIN v USING (qid)),
l AS (SELECT *, greatest(CAST(round_even((m - 1.959963984540054e0 * s) / 2, 0) AS BIGINT) - 1, 0) AS lo, least(CAST(round_even((m + 1.959963984540054e0 * s) / 2, 0) AS BIGINT), CAST(m AS BIGINT) - 1) AS hi FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY slope) - 1 AS k FROM p),
e AS (SELECT k.qid, median(slope) AS slope, max(CASE WHEN k = lo THEN slope END) AS low, max(CASE WHEN k = hi THEN slope END) AS high FROM k JOIN l USING (qid) GROUP BY ALL)
SELECT qid, R(slope) AS slope, R(y - slope * x) AS intercept, R(low) AS low, R(high) AS high FROM e JOIN l USING (qid)""",
)
def theil_sen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.theil_sen(_yearly(spark, sf_dir), ["qid"], "year")


@query(
    "linear_trend",
    """WITH r AS (SELECT *, CAST(row_number() OVER (PARTITION BY variable, qid ORDER BY year, month) - 1 AS DOUBLE) AS t FROM weather_monthly),
f AS (SELECT variable, qid, count(*) AS n, regr_slope(value, t) AS slope, regr_intercept(value, t) AS intercept, corr(value, t) AS r FROM r GROUP BY ALL)
SELECT variable, qid, n, R(slope) AS slope, R(intercept) AS intercept, R(r) AS r, R(abs(slope) * sqrt((1 / (r * r) - 1) / (n - 2))) AS stderr FROM f""",
)
def linear_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = example(spark, sf_dir, "weather_monthly").withColumn("_o", F.col("year") * 12 + F.col("month"))
    return trend.linear_trend(d, KEYS, "_o")


@query("linear_trend_p")
def linear_trend_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With Student's t and its two-sided p."""
    return seasonal.with_correlation_p(linear_trend(spark, sf_dir))


@query(
    "decompose_daily",
    f"""WITH {_DAYS}, t AS (SELECT *, CASE WHEN count(*) OVER w = 365 THEN avg(value) OVER w END AS trend FROM y WINDOW w AS (PARTITION BY variable, qid ORDER BY date ROWS BETWEEN 182 PRECEDING AND 182 FOLLOWING)),
s AS (SELECT *, avg(value - trend) OVER (PARTITION BY variable, qid, dayofyear(date)) AS seasonal FROM t)
SELECT variable, qid, date, R(trend) AS trend, R(seasonal) AS seasonal, R(value - trend - seasonal) AS residual FROM s""",
)
def decompose_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _days(spark, sf_dir).withColumn("doy", F.dayofyear("date"))
    return trend.decompose(d, KEYS, ["date"], "doy", 182, 182).select("variable", "qid", "date", "trend", "seasonal", "residual")


@query(
    "decompose_monthly",
    """WITH t AS (SELECT *, CASE WHEN count(*) OVER w = 12 THEN avg(value) OVER w END AS trend FROM weather_monthly WINDOW w AS (PARTITION BY variable, qid ORDER BY year, month ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)),
s AS (SELECT *, avg(value / nullif(trend, 0)) OVER (PARTITION BY variable, qid, month) AS seasonal FROM t)
SELECT variable, qid, year, month, R(trend) AS trend, R(seasonal) AS seasonal, R(value / nullif(trend * seasonal, 0)) AS residual FROM s""",
)
def decompose_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trend.decompose(example(spark, sf_dir, "weather_monthly"), KEYS, ["year", "month"], "month", 6, 5, multiplicative=True)
    return out.select("variable", "qid", "year", "month", "trend", "seasonal", "residual")


@query("detrend_monthly", f"SELECT {_YM}, R(value + (2000 - year) * slope) AS value FROM weather_monthly JOIN trend USING (variable, qid, month)")
def detrend_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.detrend(example(spark, sf_dir, "weather_monthly"), example(spark, sf_dir, "trend"), 2000, KEYS).select("variable", "qid", "year", "month", "value")


@query("detrend_daily", f"WITH {_DAYS} SELECT variable, qid, date, R(value + (2000 - year(date)) * slope) AS value FROM y JOIN trend t USING (variable, qid) WHERE t.month = month(y.date)")
def detrend_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every variable that has a trend."""
    d = _days(spark, sf_dir).withColumns({"year": F.year("date"), "month": F.month("date")})
    return trend.detrend(d, example(spark, sf_dir, "trend"), 2000, KEYS).select("variable", "qid", "date", "value")


# Distributions


def _hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return example(spark, sf_dir, "weather_hist").select("qid", "date", F.col("pre").alias("value"))


def _stoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return example(spark, sf_dir, "weather_stoc").select("qid", "date", F.col("pre").alias("value"))


@query("ecdf", "SELECT qid, date, R(pre) AS value, R(cume_dist() OVER (PARTITION BY qid ORDER BY pre)) AS p FROM weather_hist")
def ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.ecdf(_hist(spark, sf_dir), ["qid"])


@query(
    "ecdf_at",
    """WITH k AS (SELECT DISTINCT qid, pre AS x, cume_dist() OVER (PARTITION BY qid ORDER BY pre) AS p FROM weather_hist),
l AS (SELECT *, lead(x) OVER w AS x1, lead(p) OVER w AS p1, min(x) OVER (PARTITION BY qid) AS lo, max(x) OVER (PARTITION BY qid) AS hi FROM k WINDOW w AS (PARTITION BY qid ORDER BY x)),
v AS (SELECT qid, date, pre + 0.05e0 AS value FROM weather_stoc)
SELECT v.qid, v.date, R(v.value) AS value, R(coalesce(CASE WHEN l.x1 IS NULL AND v.value > l.x THEN 1 WHEN l.x1 IS NULL THEN l.p ELSE l.p + (v.value - l.x) / (l.x1 - l.x) * (l.p1 - l.p) END, 0)) AS p
FROM v LEFT JOIN l ON v.qid = l.qid AND v.value >= l.x AND (l.x1 IS NULL OR v.value < l.x1)""",
)
def ecdf_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.ecdf_at(_hist(spark, sf_dir), _stoc(spark, sf_dir).withColumn("value", F.col("value") + 0.05), ["qid"])


def _eqf_sql(source: str, target: str) -> str:
    """source has (qid, date, value, p); target has (qid, value)."""
    return f"""r AS (SELECT qid, value AS x, row_number() OVER (PARTITION BY qid ORDER BY value) AS k, count(*) OVER (PARTITION BY qid) AS n FROM {target}),
n AS (SELECT qid, max(n) AS n FROM r GROUP BY qid),
a AS (SELECT s.*, greatest(s.p * n.n, 1) AS pos, n.n AS n FROM {source} s JOIN n USING (qid)),
q AS (SELECT a.qid, a.date, a.value, l.x + (pos - floor(pos)) * (h.x - l.x) AS mapped FROM a JOIN r l ON l.qid = a.qid AND l.k = CAST(floor(pos) AS BIGINT) JOIN r h ON h.qid = a.qid AND h.k = least(CAST(ceil(pos) AS BIGINT), a.n))"""


@query(
    "eqf",
    f"""WITH v AS (SELECT qid, pre AS value FROM weather_hist), w AS (SELECT qid, DATE '2000-01-01' + i AS date, CAST(i AS DOUBLE) AS value, i / 20e0 AS p FROM cells CROSS JOIN (VALUES (1), (5), (10), (15), (20)) AS u(i)),
{_eqf_sql('w', 'v')} SELECT qid, R(value / 20) AS p, R(mapped) AS mapped FROM q""",
)
def eqf(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = example(spark, sf_dir, "cells").select("qid", F.explode(F.array(*[F.lit(i / 20) for i in (1, 5, 10, 15, 20)])).alias("p"))
    return distributions.at_probability(_hist(spark, sf_dir), wanted, ["qid"])


def _map_sql(value: str) -> str:
    return f"""WITH s AS (SELECT qid, date, value, cume_dist() OVER (PARTITION BY qid ORDER BY value) AS p FROM (SELECT qid, date, {value} AS value FROM weather_stoc)),
t AS (SELECT qid, {value} AS value FROM weather_hist), {_eqf_sql('s', 't')} SELECT qid, date, R(value) AS value, R(mapped) AS mapped FROM q"""


@query("quantile_map_empirical", _map_sql("pre"))
def quantile_map_empirical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.quantile_map(_stoc(spark, sf_dir), _hist(spark, sf_dir), ["qid"])


@query("quantile_map_wetday", _map_sql("CASE WHEN pre >= 1 THEN pre ELSE 0 END"))
def quantile_map_wetday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.quantile_map(_stoc(spark, sf_dir), _hist(spark, sf_dir), ["qid"], wet=1.0)


@query(
    "quantile_map_normal",
    """WITH h AS (SELECT qid, avg(tmax) AS m, stddev_pop(tmax) AS s FROM weather_hist GROUP BY qid), o AS (SELECT qid, avg(tmax) AS m, stddev_pop(tmax) AS s FROM weather_stoc GROUP BY qid)
SELECT w.qid, date, R(tmax) AS value, R((tmax - o.m) / nullif(o.s, 0) * h.s + h.m) AS mapped FROM weather_stoc w JOIN h USING (qid) JOIN o USING (qid)""",
)
def quantile_map_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    col = lambda t: example(spark, sf_dir, t).select("qid", "date", F.col("tmax").alias("value"))
    return distributions.quantile_map_normal(col("weather_stoc"), col("weather_hist"), ["qid"])


@query("quantile_map_gamma")
def quantile_map_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day; the gammas are fitted to wet days, and a dry day stays dry."""
    return distributions.quantile_map_gamma(_stoc(spark, sf_dir), _hist(spark, sf_dir), ["qid"])


@query("quantile_map_berngamma")
def quantile_map_berngamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.quantile_map_gamma(_stoc(spark, sf_dir), _hist(spark, sf_dir), ["qid"], dry=True)


@query("fit_distribution")
def fit_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.fit_distribution(_hist(spark, sf_dir), ["qid"])


@query("fit_normal", "SELECT qid, count(*) AS n, R(avg(pre)) AS mean, R(stddev_pop(pre)) AS sd, R(avg(CASE WHEN pre <= 1 THEN 1e0 ELSE 0e0 END)) AS p0 FROM weather_hist GROUP BY qid")
def fit_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.fit_distribution(_hist(spark, sf_dir), ["qid"]).select("qid", "n", "mean", "sd", "p0")


@query("spi")
def spi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.spi(example(spark, sf_dir, "month_wide").select("qid", "year", "month", F.col("pre").alias("value")))


_U = "(SELECT qid, date, (rh - 39) / 42 AS x, 1 + u2 AS a, 2 + u2 / 2 AS b FROM weather_daily)"


@query("kuma_functions", f"SELECT qid, date, R(a * b * pow(x, a - 1) * pow(1 - pow(x, a), b - 1) / 42) AS pdf, R(1 - pow(1 - pow(x, a), b)) AS cdf, R(pow(1 - pow(1 - x, 1 / b), 1 / a)) AS quantile FROM {_U}")
def kuma_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, x = 1 + F.col("u2"), 2 + F.col("u2") / 2, (F.col("rh") - 39) / 42
    return example(spark, sf_dir, "weather_daily").select("qid", "date", distributions.kuma_pdf(F.col("rh"), a, b, 39.0, 81.0).alias("pdf"), distributions.kuma_cdf(x, a, b).alias("cdf"), distributions.kuma_quantile(x, a, b).alias("quantile"))


@query("kuma_moments", f"SELECT qid, date, R(b * exp(lgamma(1 + 2 / a) + lgamma(b) - lgamma(1 + 2 / a + b))) AS moment FROM {_U}")
def kuma_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = example(spark, sf_dir, "weather_daily").select("qid", "date", (1 + F.col("u2")).alias("a"), (2 + F.col("u2") / 2).alias("b"))
    return distributions.kuma_moments(d, "a", "b", 2).select("qid", "date", "moment")


@query("kuma_fit_moments", rounded=4)
def kuma_fit_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = example(spark, sf_dir, "weather_daily").groupBy("qid", F.month("date").alias("month")).agg(F.avg((F.col("rh") - 39) / 42).alias("mean"), F.stddev_pop((F.col("rh") - 39) / 42).alias("sd"))
    return distributions.kuma_fit_moments(d, "mean", "sd")


_GBM = """WITH w AS (SELECT * FROM prices WHERE date BETWEEN make_date(matyear - 1, 1, 1) AND make_date(matyear, 12, 28)),
d AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM w)),
l AS (SELECT matyear, date, price, lag(price) OVER m AS p0, k - lag(k) OVER m AS gap FROM w JOIN d USING (date) WINDOW m AS (PARTITION BY matyear ORDER BY date)),
r AS (SELECT matyear, date, ln(price) - ln(p0) AS lr FROM l WHERE gap = 1)"""


@query("gbm_fit", _GBM + " SELECT matyear, R(avg(lr)) AS drift, R(stddev_samp(lr)) AS volatility FROM r GROUP BY matyear")
def gbm_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.gbm_moments(distributions.gbm_fit(example(spark, sf_dir, "prices")))


_Z = lambda key: f"(sqrt(-2e0 * ln((CAST(CAST('0x' || substr(md5({key}), 1, 13) AS UBIGINT) AS DOUBLE) + 0.5e0) / 4503599627370496e0)) * cos(6.283185307179586e0 * ((CAST(CAST('0x' || substr(md5({key}), 14, 13) AS UBIGINT) AS DOUBLE) + 0.5e0) / 4503599627370496e0)))"


@query(
    "gbm_paths",
    _GBM
    + f""", m AS (SELECT matyear, avg(lr) * 0.01 AS drift, stddev_samp(lr) * 0.01 AS vol FROM r GROUP BY matyear HAVING count(*) > 1),
g AS (SELECT *, {_Z("'7|' || matyear || '|' || sim || '|' || day")} AS z FROM m CROSS JOIN (SELECT unnest(range(5)) AS sim) CROSS JOIN (SELECT unnest(range(20)) AS day)),
b AS (SELECT *, CASE WHEN day = 0 THEN 0 ELSE sum(z) OVER (PARTITION BY matyear, sim ORDER BY day) END AS b FROM g)
SELECT matyear, CAST(sim AS INT) AS sim, CAST(day AS INT) AS day, R(exp((drift - vol * vol / 2) * day + vol * b)) AS level FROM b""",
)
def gbm_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = distributions.gbm_moments(distributions.gbm_fit(example(spark, sf_dir, "prices"))).filter("volatility is not null")
    m = m.select("matyear", (F.col("drift") * 0.01).alias("drift"), (F.col("volatility") * 0.01).alias("volatility"))
    return distributions.gbm_paths(m, 20, 5, "7", ["matyear"])


@query("kuma_fit_quantiles", rounded=3)
def kuma_fit_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = example(spark, sf_dir, "weather_daily").select("qid", F.month("date").alias("month"), ((F.col("rh") - 39) / 42).alias("value"))
    return distributions.kuma_fit_quantiles(d, ["qid", "month"])


@query("kuma_grid", rounded=3)
def kuma_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid for every cell of the daily table."""
    cells = example(spark, sf_dir, "weather_daily").select("qid").distinct()
    return distributions.kuma_grid(cells, (0.1, 0.3, 0.5, 0.7), (0.2, 0.5, 1.0))


@query("spei_mle", rounded=3)
def spei_mle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.spei_mle(example(spark, sf_dir, "month_wide").select("qid", "year", "month", F.col("pre").alias("value")))


# Seasons


def _season_sql(table: str, name: str) -> str:
    return f"""{name}0 AS (SELECT {_YM}, CASE WHEN count(*) OVER w = 3 THEN CASE WHEN variable = 'pre' THEN sum(value) OVER w ELSE avg(value) OVER w END END AS value FROM {table}
  WINDOW w AS (PARTITION BY variable, qid ORDER BY year, month ROWS 2 PRECEDING)),
{name}1 AS (SELECT * FROM {name}0 WHERE value IS NOT NULL AND month IN (2, 5, 8, 11)),
{name} AS (SELECT variable, year, month AS season, qid, value FROM {name}1 JOIN (SELECT variable, year, month FROM {name}1 GROUP BY ALL
  HAVING count(*) = (SELECT count(DISTINCT qid) FROM {name}1)) USING (variable, year, month))"""


_HS, _SS = _season_sql("hist_monthly", "hs"), _season_sql("stoc_monthly", "ss0x")
_SIM = f"{_SS}, ss AS (SELECT variable, year + 100 AS year, season, qid, value FROM ss0x)"
_ANALOGUE = "an AS (SELECT DISTINCT season, year, CAST(1996 + (year * 7 + season * 3) % 5 AS INT) AS histyear FROM ss)"


def hist_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seasonal.season_aggregate(example(spark, sf_dir, "hist_monthly"))


def stoc_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seasonal.season_aggregate(example(spark, sf_dir, "stoc_monthly")).withColumn("year", F.col("year") + 100)


def analogue_table(stoc: DataFrame) -> DataFrame:
    return stoc.select("season", "year").distinct().withColumn("histyear", (F.lit(1996) + (F.col("year") * 7 + F.col("season") * 3) % 5).cast("int"))


@query("season_aggregate", f"WITH {_HS} SELECT variable, year, season, qid, R(value) AS value FROM hs")
def season_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hist_seasons(spark, sf_dir)


_ANOM = f"{_HS}, am AS (SELECT *, avg(value) OVER w AS mean, stddev_samp(value) OVER w AS sd, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS anom FROM hs WINDOW w AS (PARTITION BY variable, season, qid))"


@query("seasonal_anomaly", f"WITH {_ANOM} SELECT variable, year, season, qid, R(mean) AS mean, R(sd) AS sd, R(anom) AS anom FROM am")
def seasonal_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seasonal.anomalies(hist_seasons(spark, sf_dir)).select("variable", "year", "season", "qid", "mean", "sd", "anom")


@query(
    "normality_ks",
    f"""WITH {_ANOM}, r AS (SELECT *, row_number() OVER (PARTITION BY variable, season, qid ORDER BY anom) AS i, count(*) OVER (PARTITION BY variable, season, qid) AS n FROM am WHERE anom IS NOT NULL)
SELECT variable, season, qid, max(n) AS n, R(max(greatest(i / n - {normal.cdf_sql('anom')}, {normal.cdf_sql('anom')} - (i - 1) / n))) AS d FROM r GROUP BY ALL""",
)
def normality_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seasonal.normality_d(seasonal.anomalies(hist_seasons(spark, sf_dir)), ["variable", "season", "qid"])


@query("normality_ks_p")
def normality_ks_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seasonal.with_kolmogorov_p(normality_ks(spark, sf_dir), F.col("n"))


@query("boxcox_fit", rounded=5)
def boxcox_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seasonal.boxcox_fit(hist_seasons(spark, sf_dir), shift=1.0)


_POWER = "CASE WHEN variable = 'pre' THEN 0.301e0 ELSE 0.701e0 END"


def _power(c: str = "variable"):
    return F.when(F.col(c) == "pre", 0.301).otherwise(0.701)


@query("boxcox_apply", f"WITH {_HS} SELECT variable, year, season, qid, R((pow(value + 1, {_POWER}) - 1) / {_POWER}) AS value FROM hs")
def boxcox_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hist_seasons(spark, sf_dir).withColumn("value", seasonal.boxcox(F.col("value"), _power(), 1.0))


@query("boxcox_invert", f"WITH {_HS} SELECT variable, year, season, qid, R(least(coalesce(CASE WHEN (value / 10 - 1) * {_POWER} + 1 >= 0 THEN pow((value / 10 - 1) * {_POWER} + 1, 1 / {_POWER}) - 1 END, 0), 30)) AS value FROM hs")
def boxcox_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hist_seasons(spark, sf_dir).withColumn("value", F.least(seasonal.boxcox_inverse(F.col("value") / 10 - 1, _power(), 1.0), F.lit(30.0)))


def _hist_pca(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = grid.with_lonlat(seasonal.anomalies(hist_seasons(spark, sf_dir)).filter("anom is not null"))
    return seasonal.pca(a, grid.area_weight(F.col("lat")))


@query("pca_eof")
def pca_eof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loadings with coordinates."""
    return grid.with_lonlat(_hist_pca(spark, sf_dir)[0]).select("variable", "season", "mode", "qid", "lon", "lat", "loading")


@query(
    "eof_cube",
    f"""WITH {_ANOM}, k AS (SELECT variable, season, count(DISTINCT year) AS years, count(DISTINCT qid) AS cells FROM am WHERE anom IS NOT NULL GROUP BY ALL),
c AS (SELECT DISTINCT variable, season, qid FROM am WHERE anom IS NOT NULL)
SELECT variable, season, qid, R({LON}) AS lon, R({LAT}) AS lat, CAST(least(years - 1, cells) AS BIGINT) AS modes, R(1) AS ortho FROM c JOIN k USING (variable, season)""",
)
def eof_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading patterns as a long cube with coordinates, a row for each cell; `ortho` is its part in the patterns' squared lengths, summed over cells.

    Every pattern has length one, so the mean over modes of the sum over cells is one.
    """
    cube = pca_eof(spark, sf_dir)
    keys = ["variable", "season"]
    length = cube.groupBy(*keys, "mode").agg(F.sum(F.pow("loading", F.lit(2))).alias("_l")).groupBy(*keys).agg(F.avg("_l").alias("ortho"))
    return cube.groupBy(*keys, "qid", "lon", "lat").agg(F.count("*").alias("modes")).join(F.broadcast(length), keys).select(*keys, "qid", "lon", "lat", "modes", "ortho")


@query("pca_scores")
def pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hist_pca(spark, sf_dir)[1]


@query(
    "pca_gram",
    f"WITH {_ANOM}, x AS (SELECT *, anom * sqrt(cos(radians({LAT}))) AS v FROM am WHERE anom IS NOT NULL) SELECT a.variable, a.season, a.year AS y1, b.year AS y2, R(sum(a.v * b.v)) AS g FROM x a JOIN x b USING (variable, season, qid) GROUP BY ALL",
)
def pca_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = grid.with_lonlat(seasonal.anomalies(hist_seasons(spark, sf_dir)).filter("anom is not null"))
    return seasonal.gram(a, grid.area_weight(F.col("lat")))


@query("pc_normality", rounded=4)
def pc_normality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The K-S distance of each mode's standardised scores from the normal, and its p."""
    keys = ["variable", "season", "mode"]
    scores = _hist_pca(spark, sf_dir)[1].withColumnRenamed("mode", "qid").withColumnRenamed("score", "value")
    d = seasonal.normality_d(seasonal.anomalies(scores).withColumnRenamed("qid", "mode"), keys)
    return seasonal.with_kolmogorov_p(d, F.col("n"))


@query("pc_variance_explained")
def pc_variance_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seasonal.variance_explained(_hist_pca(spark, sf_dir)[1])


def _generator(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """The generator's tables, each stored once: powers, anomalies of transformed seasons, eofs, pcs, simulated scores."""
    hist = stored(spark, hist_seasons(spark, sf_dir), "seasons")
    powers = stored(spark, seasonal.boxcox_fit(hist, shift=1.0), "powers")
    d = hist.join(powers, ["variable", "season", "qid"]).withColumn("value", seasonal.boxcox(F.col("value"), F.col("power"), 1.0))
    anom = stored(spark, seasonal.anomalies(d.select(*hist.columns)), "anomalies")
    usual = seasonal.normal_cells(anom)
    a = grid.with_lonlat(anom.filter("anom is not null").join(usual, ["variable", "season", "qid"], "left_semi"))
    eofs, pcs = (stored(spark, x, "modes") for x in seasonal.pca(a, grid.area_weight(F.col("lat"))))
    mei = example(spark, sf_dir, "climate").filter(F.col("month").isin(*seasonal.SEASONS)).select(F.col("month").alias("season"), "year", F.lit("mei").alias("name"), F.col("mei").alias("x"))
    names = _named(pcs, "score")
    factor = seasonal.cholesky(seasonal.correlations(names.unionByName(mei), ["season"], ["year"]))
    years = pcs.select((F.col("year") + 100).alias("year")).distinct()
    draws = _named(seasonal.random_modes(pcs.select("variable", "season", "mode").distinct(), years, "5"), "z").withColumnRenamed("x", "z")
    index = draws.select("season", "year").distinct().select("season", "year", F.lit("mei").alias("name"), F.expr(normal.hashed_normal_sql("concat_ws('|', 'mei', season, year)")).alias("z"))
    sd = names.groupBy("season", "name").agg(F.stddev_samp("x").alias("sd"))
    scores = seasonal.correlate_modes(draws.unionByName(index), factor, sd)
    parts = F.split("name", "_(?=[0-9]+$)")
    sim = scores.select(parts[0].alias("variable"), "season", "year", parts[1].cast("int").alias("mode"), "score")
    return powers, anom, eofs, pcs, stored(spark, sim, "scores")


@query("simulate_seasons", rounded=4)
def simulate_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generator on real modes: transform, anomalies, patterns, correlated scores, and back to values within bounds."""
    powers, anom, eofs, _, sim = _generator(spark, sf_dir)
    weight = grid.area_weight(F.col("lat"))
    plain = grid.with_lonlat(eofs).withColumn("loading", F.col("loading") / weight).select("variable", "season", "mode", "qid", "loading")
    out = seasonal.synthesise(sim, plain, anom.select("variable", "season", "qid", "mean", "sd").distinct())
    out = out.join(powers.select("variable", "season", "qid", "power"), ["variable", "season", "qid"])
    return seasonal.finished(out, {"pre": (0.0, 2000.0), "tmax": (-60.0, 60.0), "tmin": (-90.0, 50.0)}, shift=1.0)


@query("simulate_analogues", rounded=4)
def simulate_analogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The historic year nearest to each simulated one, by real modes."""
    *_, pcs, sim = _generator(spark, sf_dir)
    return seasonal.analogues(sim, pcs)


# Scores that SQL can state: each cell's anomaly as a mode of its own.
_PC = f"{_ANOM}, md AS (SELECT DISTINCT qid, dense_rank() OVER (ORDER BY qid) - 1 AS mode FROM am), pc AS (SELECT variable, season, CAST(mode AS INT) AS mode, year, anom AS score FROM am JOIN md USING (qid) WHERE anom IS NOT NULL)"
_MODES = {757859: 0, 757942: 1, 2116266: 2, 2121748: 3}


def _cell_modes(d: DataFrame) -> DataFrame:
    mode = F.create_map(*[F.lit(x) for kv in _MODES.items() for x in kv])[F.col("qid").cast("int")]
    return d.filter("anom is not null").select("variable", "season", mode.cast("int").alias("mode"), "year", F.col("anom").alias("score"))


def _hist_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cell_modes(seasonal.anomalies(hist_seasons(spark, sf_dir)))


_CORR = f"""WITH {_PC}, v AS (SELECT season, year, variable || '_' || mode AS name, score AS x FROM pc UNION ALL SELECT month, year, 'mei', mei FROM climate WHERE month IN (2, 5, 8, 11)),
c AS (SELECT a.season, a.name AS var_i, b.name AS var_j, count(*) AS n, corr(a.x, b.x) AS r FROM v a JOIN v b USING (season, year) GROUP BY ALL)"""


def _corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    pcs = _hist_modes(spark, sf_dir).select("season", "year", F.concat_ws("_", "variable", F.col("mode").cast("string")).alias("name"), F.col("score").alias("x"))
    mei = example(spark, sf_dir, "climate").filter(F.col("month").isin(*seasonal.SEASONS)).select(F.col("month").alias("season"), "year", F.lit("mei").alias("name"), F.col("mei").alias("x"))
    return seasonal.correlations(pcs.unionByName(mei), ["season"], ["year"])


@query("pc_climate_corr", _CORR + " SELECT season, var_i, var_j, n, R(r) AS r FROM c")
def pc_climate_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corr(spark, sf_dir)


@query("pc_climate_pval")
def pc_climate_pval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seasonal.with_correlation_p(_corr(spark, sf_dir).filter("var_i < var_j"))


@query("corr_top_modes", _CORR + " SELECT season, var_i, var_j, R(r) AS r FROM c WHERE regexp_matches(var_i, '(mei|_[01])$') AND regexp_matches(var_j, '(mei|_[01])$')")
def corr_top_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = lambda c: F.col(c).rlike("(mei|_[01])$")
    return _corr(spark, sf_dir).filter(top("var_i") & top("var_j")).select("season", "var_i", "var_j", "r")


_RZ = _Z("'5|' || year || '|' || season || '|' || variable || '|' || mode")
_RM = f"md2 AS (SELECT DISTINCT variable, season, mode FROM pc), yr AS (SELECT DISTINCT year + 100 AS year FROM pc), rz AS (SELECT *, {_RZ} AS z FROM md2 CROSS JOIN yr)"


def _random(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hist_modes(spark, sf_dir)
    return seasonal.random_modes(h.select("variable", "season", "mode").distinct(), h.select((F.col("year") + 100).alias("year")).distinct(), "5")


def _named(d: DataFrame, value: str) -> DataFrame:
    return d.select("season", "year", F.concat_ws("_", "variable", F.col("mode").cast("string")).alias("name"), F.col(value).alias("x"))


@query("cholesky_factor", rounded=5)
def cholesky_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seasonal.cholesky(_corr(spark, sf_dir))


@query(
    "correlate_modes",
    f"""WITH {_PC}, {_RM}, n AS (SELECT season, year, variable || '_' || mode AS name, z FROM rz),
s AS (SELECT season, year, name, (z - avg(z) OVER w) / stddev_samp(z) OVER w AS z FROM n WINDOW w AS (PARTITION BY season, name)),
f AS (SELECT a.season, a.name, b.name AS src, 1e0 / (1 + length(a.name) + length(b.name)) AS l FROM (SELECT DISTINCT season, name FROM n) a JOIN (SELECT DISTINCT season, name FROM n) b ON a.season = b.season AND b.name <= a.name),
d AS (SELECT season, variable || '_' || mode AS name, stddev_samp(score) AS sd FROM pc GROUP BY ALL)
SELECT season, year, name, R(x * sd) AS score FROM (SELECT s.season, s.year, f.name, sum(z * l) AS x FROM s JOIN f ON s.season = f.season AND s.name = f.src GROUP BY ALL) JOIN d USING (season, name)""",
)
def correlate_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random modes through a factor that SQL can state: one that falls off with the lengths of names."""
    draws = _named(_random(spark, sf_dir), "z").withColumnRenamed("x", "z")
    names = draws.select("season", "name").distinct()
    pairs = names.withColumnRenamed("name", "var_i").join(names.withColumnRenamed("name", "var_j"), "season").filter("var_j <= var_i")
    factor = pairs.withColumn("l", 1.0 / (1 + F.length("var_i") + F.length("var_j")))
    sd = _named(_hist_modes(spark, sf_dir), "score").groupBy("season", "name").agg(F.stddev_samp("x").alias("sd"))
    return seasonal.correlate_modes(draws, factor, sd)


@query("simulate_modes")
def simulate_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain as it runs: correlation matrix, Cholesky factor, random modes, correlated scores."""
    draws = _named(_random(spark, sf_dir), "z").withColumnRenamed("x", "z")
    mei = draws.select("season", "year").distinct().select("season", "year", F.lit("mei").alias("name"), F.expr(normal.hashed_normal_sql("concat_ws('|', 'mei', season, year)")).alias("z"))
    sd = _named(_hist_modes(spark, sf_dir), "score").groupBy("season", "name").agg(F.stddev_samp("x").alias("sd"))
    return seasonal.correlate_modes(draws.unionByName(mei), seasonal.cholesky(_corr(spark, sf_dir)), sd)


@query("random_modes", f"WITH {_PC}, {_RM} SELECT variable, season, mode, year, R(z) AS z FROM rz")
def random_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _random(spark, sf_dir)


@query(
    "find_analogue",
    f"""WITH {_PC}, {_RM}, w0 AS (SELECT variable, season, mode, var_samp(score) AS v FROM pc GROUP BY ALL), w AS (SELECT *, v / sum(v) OVER (PARTITION BY variable, season) AS w FROM w0),
d AS (SELECT s.season, s.year, h.year AS histyear, sum(w.w * pow(s.z - h.score, 2)) AS d2 FROM rz s JOIN pc h USING (variable, season, mode) JOIN w USING (variable, season, mode) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY season, year ORDER BY d2, histyear) AS k FROM d)
SELECT season, year, histyear, R(d2) AS d2 FROM b WHERE k = 1""",
)
def find_analogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seasonal.analogues(_random(spark, sf_dir).withColumnRenamed("z", "score"), _hist_modes(spark, sf_dir))


@query(
    "synthesise_seasonal",
    f"""WITH {_PC}, {_RM}, ld AS (SELECT DISTINCT md.mode AS mode, c.qid, 1 / (1 + abs(md.mode - m2.mode)) AS loading FROM md CROSS JOIN md m2 JOIN md c ON c.mode = m2.mode),
mo AS (SELECT DISTINCT variable, season, qid, mean, sd FROM am), s AS (SELECT variable, season, year, qid, sum(z * loading) AS a FROM rz JOIN ld USING (mode) GROUP BY ALL)
SELECT variable, season, year, qid, R(a * sd + mean) AS value FROM s JOIN mo USING (variable, season, qid)""",
)
def synthesise_seasonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random scores through loadings that fall off with the difference of mode and cell."""
    a = seasonal.anomalies(hist_seasons(spark, sf_dir))
    mode = F.create_map(*[F.lit(x) for kv in _MODES.items() for x in kv])[F.col("qid").cast("int")]
    eofs = a.select("variable", "season", "qid").distinct().withColumn("mode", F.explode(F.array(*[F.lit(m) for m in _MODES.values()]))).withColumn("loading", 1 / (1 + F.abs(F.col("mode") - mode)))
    return seasonal.synthesise(_random(spark, sf_dir).withColumnRenamed("z", "score"), eofs, a.select("variable", "season", "qid", "mean", "sd").distinct())


# Days from seasons


@query("month_to_season", "SELECT qid, date, CAST(CASE WHEN month(date) <= 2 THEN 2 WHEN month(date) <= 5 THEN 5 WHEN month(date) <= 8 THEN 8 WHEN month(date) <= 11 THEN 11 ELSE 2 END AS INT) AS season FROM weather_daily")
def month_to_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return example(spark, sf_dir, "weather_daily").select("qid", "date", seasonal.season_of(F.month("date")).alias("season"))


@query("season_label", f"WITH {_HS} SELECT variable, year, qid, CASE season WHEN 2 THEN 'DJF' WHEN 5 THEN 'MAM' WHEN 8 THEN 'JJA' ELSE 'SON' END AS label FROM hs")
def season_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hist_seasons(spark, sf_dir).select("variable", "year", "qid", seasonal.season_label(F.col("season")).alias("label"))


_KEY = "CAST((year(date) + CASE WHEN month(date) > 11 THEN 1 ELSE 0 END) * 4 + CASE WHEN month(date) <= 2 OR month(date) = 12 THEN 0 WHEN month(date) <= 5 THEN 1 WHEN month(date) <= 8 THEN 2 ELSE 3 END AS INT)"


@query("season_key", f"SELECT qid, date, {_KEY} AS key FROM weather_daily")
def season_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuild.keyed(example(spark, sf_dir, "weather_daily")).select("qid", "date", "key")


_SSF = f"{_HS}, {_SIM}, {_ANALOGUE}, sf AS (SELECT s.qid, s.variable, s.year, s.season, CAST(histyear * 4 + (s.season - 2) // 3 AS INT) AS key, s.value / nullif(h.value, 0) AS ssf FROM ss s JOIN an USING (season, year) JOIN hs h ON h.variable = s.variable AND h.season = s.season AND h.qid = s.qid AND h.year = an.histyear)"


def _ssf(spark: SparkSession, sf_dir: str) -> DataFrame:
    stoc = stoc_seasons(spark, sf_dir)
    return rebuild.scaling_factors(analogue_table(stoc), hist_seasons(spark, sf_dir), stoc)


@query("scaling_factors", f"WITH {_SSF} SELECT qid, variable, year, season, key, R(ssf) AS ssf FROM sf")
def scaling_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ssf(spark, sf_dir)


_DIS = f"""{_SSF}, wd AS (SELECT qid, year, key, max(CASE WHEN variable = 'pre' THEN ssf END) AS f_pre, max(CASE WHEN variable = 'tmax' THEN ssf END) AS f_tmax, max(CASE WHEN variable = 'tmin' THEN ssf END) AS f_tmin FROM sf GROUP BY ALL),
dy AS (SELECT *, {_KEY} AS key, CASE WHEN month(date) > 11 THEN 1 ELSE 0 END AS early FROM weather_hist),
dd AS (SELECT dy.qid, CAST(wd.year - early AS INT) AS year, key, date, pre * f_pre AS pre, tmax * f_tmax AS tmax, tmin * f_tmin AS tmin FROM dy JOIN wd USING (qid, key))"""


@query("disaggregate_daily", f"WITH {_DIS} SELECT qid, year, key, date, R(pre) AS pre, R(tmax) AS tmax, R(tmin) AS tmin FROM dd")
def disaggregate_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuild.disaggregate(example(spark, sf_dir, "weather_hist"), _ssf(spark, sf_dir))


@query("rebuild_daily", f"WITH {_DIS} SELECT qid, year, date, R(pre) AS pre, R(tmax) AS tmax, R(tmin) AS tmin FROM dd")
def rebuild_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated days of all cells and years from stored factors; `rebuild_days` has their eto as well."""
    d = rebuild.disaggregate(example(spark, sf_dir, "weather_hist"), _ssf(spark, sf_dir))
    return d.select("qid", "year", "date", "pre", "tmax", "tmin")


@query(
    "rebuild_days",
    f"""WITH {_DIS}, he AS (SELECT * FROM {eto_sql('dy')}), eh AS (SELECT qid, key, sum(eto) AS h FROM he GROUP BY ALL),
es AS (SELECT qid, CAST(year + CASE WHEN month(date) > 11 THEN 1 ELSE 0 END AS INT) AS year, key, sum(eto) AS s FROM {eto_sql('dd')} GROUP BY ALL HAVING count(eto) > 0),
ef AS (SELECT es.qid, es.year, es.key, s / nullif(h, 0) AS f_eto FROM es JOIN eh USING (qid, key))
SELECT he.qid, CAST(wd.year - early AS INT) AS year, date, R(pre * f_pre) AS pre, R(tmax * f_tmax) AS tmax, R(tmin * f_tmin) AS tmin, R(eto * f_eto) AS eto
FROM he JOIN wd USING (qid, key) LEFT JOIN ef ON ef.qid = he.qid AND ef.key = he.key AND ef.year = wd.year""",
)
def rebuild_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated days of all cells and years, eto included, from stored factors."""
    return rebuild.rebuilt_from_seasons(example(spark, sf_dir, "weather_hist"), _ssf(spark, sf_dir))


@query(
    "eto_scaling_factor",
    f"""WITH {_DIS}, eh AS (SELECT qid, key, sum(eto) AS h FROM {eto_sql('dy')} GROUP BY ALL),
es AS (SELECT qid, CAST(year + CASE WHEN month(date) > 11 THEN 1 ELSE 0 END AS INT) AS year, key, sum(eto) AS s FROM {eto_sql('dd')} GROUP BY ALL)
SELECT qid, year, key, R(s / nullif(h, 0)) AS ssf_eto FROM es JOIN eh USING (qid, key)""",
)
def eto_scaling_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with tmax under tmin have no eto; a season of such days has no factor."""
    hist = example(spark, sf_dir, "weather_hist")
    return rebuild.eto_factors(hist, rebuild.disaggregate(hist, _ssf(spark, sf_dir)))


_MT = lambda v: f"R({'sum' if v == 'pre' else 'avg'}({v})) AS {v}_agg, R(max({v})) AS {v}_max, R(min({v})) AS {v}_min, R(var_samp({v})) AS {v}_var"


@query("aggregate_month", f"SELECT qid, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, {', '.join(map(_MT, rebuild.VARIABLES))} FROM weather_daily GROUP BY ALL")
def aggregate_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuild.month_table(example(spark, sf_dir, "weather_daily"), "year(date)")


@query(
    "aggregate_season",
    f"""WITH dm AS (SELECT unnest(['pre', 'tmax', 'tmin']) AS variable, qid, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, unnest([sum(pre), avg(tmax), avg(tmin)]) AS value FROM weather_daily GROUP BY qid, year(date), month(date)),
{_HS.replace('hist_monthly', 'dm')} SELECT variable, year, season, qid, R(value) AS value FROM hs""",
)
def aggregate_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = rebuild.month_table(example(spark, sf_dir, "weather_daily"), "year(date)")
    long = m.select("qid", "year", "month", *[F.col(f"{v}_agg").alias(v) for v in rebuild.VARIABLES]).unpivot(["qid", "year", "month"], list(rebuild.VARIABLES), "variable", "value")
    return seasonal.season_aggregate(long)


@query(
    "check_consistency",
    f"""WITH {_HS}, {_SIM}, c AS (SELECT h.qid, abs(h.value - s.value) > 1e-8 + 0.2 * abs(s.value) AS bad FROM hs h JOIN ss s ON h.variable = s.variable AND h.season = s.season AND h.qid = s.qid AND h.year + 100 = s.year)
SELECT qid, count(*) AS n, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS bad FROM c GROUP BY qid""",
)
def check_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hist_seasons(spark, sf_dir).withColumn("year", F.col("year") + 100)
    return rebuild.mismatches(h, stoc_seasons(spark, sf_dir), ["variable", "season", "qid", "year"], rtol=0.2)


_SEASON_DAYS = f"""{_DIS}, mm AS (SELECT qid, CAST(year + CASE WHEN month(date) > 11 THEN 1 ELSE 0 END AS INT) AS year, key, month(date) AS m, sum(pre) AS pre, avg(tmax) AS tmax, avg(tmin) AS tmin FROM dd GROUP BY ALL),
sa AS (SELECT qid, year, CAST(2 + 3 * (key % 4) AS INT) AS season, sum(pre) AS pre, avg(tmax) AS tmax, avg(tmin) AS tmin FROM mm GROUP BY ALL HAVING count(*) = 3),
sl AS (SELECT qid, year, season, unnest(['pre', 'tmax', 'tmin']) AS variable, unnest([pre, tmax, tmin]) AS value FROM sa)"""


@query(
    "check_rebuilt",
    f"""WITH {_SEASON_DAYS}, c AS (SELECT qid, abs(sl.value - ss.value) > 1e-4 + 1e-5 * abs(ss.value) AS bad FROM sl JOIN ss USING (variable, season, qid, year) WHERE sl.value IS NOT NULL)
SELECT qid, count(*) AS n, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS bad FROM c GROUP BY qid""",
)
def check_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rebuilt days, put together to seasons again, against the simulated seasons that they come from."""
    days = rebuild.disaggregate(example(spark, sf_dir, "weather_hist"), _ssf(spark, sf_dir))
    return rebuild.mismatches(rebuild.season_totals(days), stoc_seasons(spark, sf_dir), ["variable", "season", "qid", "year"], atol=1e-4)


# Validation


@query("climatology", "SELECT qid, month, variable, R(avg(value)) AS value FROM hist_monthly GROUP BY ALL")
def climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.climatology(example(spark, sf_dir, "hist_monthly"))


_MQ = lambda table: f"""(SELECT g.qid, g.month, g.variable, q.quantile, list_extract(qs, CAST(q.k AS INT)) AS value FROM (SELECT qid, month, variable, quantile_cont(value, [{', '.join(repr(p / 100) for p in analytics.PERCENTILES)}]) AS qs FROM {table} GROUP BY ALL) g
  JOIN (SELECT qid, max(year) - min(year) + 1 AS n FROM {table} GROUP BY qid) s USING (qid) CROSS JOIN (SELECT unnest(range(1, {len(analytics.PERCENTILES) + 1})) AS k, CAST(unnest([{', '.join(repr(p / 100) for p in analytics.PERCENTILES)}]) AS DOUBLE) AS quantile) q
  WHERE q.quantile > 1 / n AND q.quantile < 1 - 1 / n)"""  # noqa: E731


@query("monthly_quantiles", f"SELECT qid, month, variable, R(quantile) AS quantile, R(value) AS value FROM {_MQ('hist_monthly')}")
def monthly_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.quantiles(example(spark, sf_dir, "hist_monthly"))


_DP = analytics.DAILY_PERCENTILES


@query(
    "daily_quantiles",
    f"""WITH l AS (SELECT qid, CAST(month(date) AS INT) AS month, unnest(['pre', 'tmax', 'tmin']) AS variable, unnest([pre, tmax, tmin]) AS value FROM weather_daily),
g AS (SELECT qid, month, variable, quantile_cont(value, [{', '.join(repr(p / 100) for p in _DP)}]) AS qs, count(*) AS c FROM l GROUP BY ALL),
n AS (SELECT *, max(c) OVER (PARTITION BY qid) AS n FROM g)
SELECT qid, month, variable, R(q) AS quantile, R(v) AS value FROM (SELECT qid, month, variable, n, unnest(qs) AS v, CAST(unnest([{', '.join(repr(p / 100) for p in _DP)}]) AS DOUBLE) AS q FROM n) WHERE q > 1 / n AND q < 1 - 1 / n""",
)
def daily_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.daily_quantiles(example(spark, sf_dir, "weather_daily"), _DP, rebuild.VARIABLES)


_EV = (*rebuild.VARIABLES, "eto")
_BOTH = f"(SELECT 'hist' AS source, qid, date, pre, tmax, tmin, eto FROM {eto_sql('weather_hist')} UNION ALL SELECT 'stoc', qid, date, pre, tmax, tmin, eto FROM {eto_sql('weather_stoc')})"


def _both_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Historic and simulated days with their eto, by source."""
    side = lambda s: eto.hargreaves(example(spark, sf_dir, f"weather_{s}")).select(F.lit(s).alias("source"), "qid", "date", *_EV)
    return side("hist").unionByName(side("stoc"))


_DQ = ", ".join(repr(p / 100) for p in analytics.DAILY_PERCENTILES)


@query(
    "daily_quantiles_all",
    f"""WITH l AS (SELECT source, qid, CAST(month(date) AS INT) AS month, unnest([{', '.join(f"'{v}'" for v in _EV)}]) AS variable, unnest([{', '.join(_EV)}]) AS value FROM {_BOTH}),
g AS (SELECT source, qid, month, variable, quantile_cont(value, [{_DQ}]) AS qs, count(value) AS c FROM l GROUP BY ALL),
n AS (SELECT *, max(c) OVER (PARTITION BY source, qid) AS n FROM g)
SELECT source, qid, month, variable, R(q) AS quantile, R(v) AS value FROM (SELECT source, qid, month, variable, n, unnest(qs) AS v, CAST(unnest([{_DQ}]) AS DOUBLE) AS q FROM n) WHERE q > 1 / n AND q < 1 - 1 / n""",
)
def daily_quantiles_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All percentiles that the days can show, of every variable, for history and simulation."""
    return analytics.daily_quantiles(_both_daily(spark, sf_dir), analytics.DAILY_PERCENTILES, _EV, ("source",))


_KS = """WITH b AS (SELECT qid, month, variable, value, 1 AS h FROM hist_monthly UNION ALL SELECT qid, month, variable, value, 0 FROM stoc_monthly),
c AS (SELECT *, sum(h) OVER u AS a, sum(1 - h) OVER u AS b, sum(h) OVER e AS n, sum(1 - h) OVER e AS m FROM b WINDOW e AS (PARTITION BY qid, month, variable), u AS (PARTITION BY qid, month, variable ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT qid, month, variable, CAST(max(n) AS BIGINT) AS n_hist, CAST(max(m) AS BIGINT) AS n_stoc, R(max(abs(a / n - b / m))) AS d FROM c GROUP BY ALL"""


@query("similarity_ks", _KS)
def similarity_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.similarity_ks(example(spark, sf_dir, "hist_monthly"), example(spark, sf_dir, "stoc_monthly"))


@query("similarity_ks_p")
def similarity_ks_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seasonal.with_two_sample_p(similarity_ks(spark, sf_dir))


_X = ("pre", "tmax", "tmin", "mei")


@query(
    "cross_correlation",
    f"""WITH j AS (SELECT * FROM hist_wide JOIN climate USING (year, month)),
c AS ({' UNION ALL '.join(f"SELECT qid, month, '{a}' AS variable, '{b}' AS variable2, corr({a}, {b}) AS r FROM j GROUP BY qid, month" for a in _X for b in _X)})
SELECT qid, month, variable, variable2, R(r) AS r FROM c WHERE r IS NOT NULL AND NOT isnan(r)""",
)
def cross_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = example(spark, sf_dir, "hist_wide").join(example(spark, sf_dir, "climate"), ["year", "month"])
    return analytics.cross_correlation(wide, _X)


@query("spatial_correlation", "SELECT a.qid, b.qid AS qid_ref, variable, R(corr(a.value, b.value)) AS r FROM hist_monthly a JOIN hist_monthly b USING (variable, year, month) WHERE b.qid IN (2116266, 757942) GROUP BY ALL")
def spatial_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.spatial_correlation(example(spark, sf_dir, "hist_monthly"), [2116266, 757942])


@query("qq_pairs", f"SELECT h.qid, h.month, h.variable, R(h.quantile) AS quantile, R(h.value) AS hist, R(s.value) AS stoc FROM {_MQ('hist_monthly')} h JOIN {_MQ('stoc_monthly')} s USING (qid, month, variable, quantile)")
def qq_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda t, n: analytics.quantiles(example(spark, sf_dir, t)).withColumnRenamed("value", n)
    return side("hist_monthly", "hist").join(side("stoc_monthly", "stoc"), ["qid", "month", "variable", "quantile"])


@query("value_ranges", "SELECT variable, R(min(value)) AS low, R(max(value)) AS high, R(max(abs(value))) AS reach FROM (SELECT * FROM hist_monthly UNION ALL SELECT * FROM stoc_monthly) GROUP BY variable")
def value_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = example(spark, sf_dir, "hist_monthly").unionByName(example(spark, sf_dir, "stoc_monthly"))
    return both.groupBy("variable").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.max(F.abs("value")).alias("reach"))


_ALL = " UNION ALL ".join(
    f"SELECT '{s}' AS source, '{k}' AS stat, qid, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, '{v}' AS variable, CAST({f}({v}) AS DOUBLE) AS value FROM weather_{s} GROUP BY ALL"
    for s in ("hist", "stoc") for v in rebuild.VARIABLES for k, f in (("agg", "sum" if v == "pre" else "avg"), ("max", "max"), ("min", "min"), ("var", "var_samp"))
)


@query("monthly_summary", f"SELECT source, stat, qid, month, variable, count(value) AS n, R(avg(value)) AS mean, R(quantile_cont(value, 0.5)) AS median FROM ({_ALL}) GROUP BY ALL")
def monthly_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and median by source, statistic, cell, month and variable: one long table, one aggregation."""
    parts = []
    for source in ("hist", "stoc"):
        m = rebuild.month_table(example(spark, sf_dir, f"weather_{source}"), "year(date)")
        names = [c for c in m.columns if c not in ("qid", "year", "month")]
        parts.append(m.unpivot(["qid", "year", "month"], names, "_name", "value").withColumn("source", F.lit(source)))
    d = parts[0].unionByName(parts[1]).withColumns({"variable": F.split_part("_name", F.lit("_"), F.lit(1)), "stat": F.split_part("_name", F.lit("_"), F.lit(2))})
    return d.groupBy("source", "stat", "qid", "month", "variable").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"))


_SV = (*_EV, "mei")
_STATS = ("agg", "max", "min", "var")
_MQS = ", ".join(repr(p / 100) for p in analytics.PERCENTILES)
_TAGGED = f"""WITH m AS (SELECT source, qid, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month,
  {', '.join(f"{'sum' if v in ('pre', 'eto') else 'avg'}({v}) AS {v}_agg, max({v}) AS {v}_max, min({v}) AS {v}_min, var_samp({v}) AS {v}_var" for v in _EV)} FROM {_BOTH} GROUP BY ALL),
w AS (SELECT t.*, mei FROM ({' UNION ALL '.join(f"SELECT source, '{k}' AS stat, qid, year, month, {', '.join(f'CAST({v}_{k} AS DOUBLE) AS {v}' for v in _EV)} FROM m" for k in _STATS)}) t LEFT JOIN climate USING (year, month)),
l AS (SELECT source, stat, qid, year, month, unnest([{', '.join(f"'{v}'" for v in _SV)}]) AS variable, unnest([{', '.join(_SV)}]) AS value FROM w)"""


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, stat, qid, year, month, variables, mei): all monthly statistics in one table."""
    m = _both_daily(spark, sf_dir)
    aggs = [f(v).alias(f"{v}_{k}") for v in _EV for k, f in (("agg", F.sum if v in ("pre", "eto") else F.avg), ("max", F.max), ("min", F.min), ("var", F.var_samp))]
    m = m.groupBy("source", "qid", F.year("date").alias("year"), F.month("date").alias("month")).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(k).alias("stat"), *[F.col(f"{v}_{k}").cast("double").alias(v) for v in _EV]) for k in _STATS])
    w = m.select("source", "qid", "year", "month", F.inline(rows))
    return w.join(example(spark, sf_dir, "climate"), ["year", "month"], "left").select("source", "stat", "qid", "year", "month", *_SV)


def _long(wide: DataFrame) -> DataFrame:
    return wide.unpivot(["source", "stat", "qid", "year", "month"], list(_SV), "variable", "value")


_TAGS = ("source", "stat")


_PARTS = f"""{_TAGGED},
g AS (SELECT source, stat, qid, month, variable, quantile_cont(value, [{_MQS}]) AS qs FROM l WHERE value IS NOT NULL GROUP BY ALL),
q AS (SELECT source, stat, qid, month, variable, unnest(qs) AS value, CAST(unnest([{_MQS}]) AS DOUBLE) AS quantile FROM g),
n AS (SELECT source, stat, qid, max(year) - min(year) + 1 AS n FROM l GROUP BY ALL),
x AS ({' UNION ALL '.join(f"SELECT source, stat, qid, month, '{a}' AS variable, '{b}' AS variable2, corr({a}, {b}) AS r FROM w GROUP BY ALL" for a in _SV for b in _SV)})"""
_PARTS_OUT = """SELECT 'climatology' AS part, source, stat, qid, month, variable, CAST(NULL AS VARCHAR) AS variable2, CAST(NULL AS DOUBLE) AS quantile, R(avg(value) + 1e-9) AS value FROM l WHERE value IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'quantile', source, stat, qid, month, variable, NULL, R(quantile), R(value + 1e-9) FROM q JOIN n USING (source, stat, qid) WHERE quantile > 1 / n AND quantile < 1 - 1 / n
UNION ALL SELECT 'correlation', source, stat, qid, month, variable, variable2, NULL, R(r + 1e-9) FROM x WHERE r IS NOT NULL AND NOT isnan(r)"""


@query("run_analytics", f"{_PARTS} {_PARTS_OUT}")
def run_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Climatology, quantiles and cross-correlation of every monthly statistic of history and simulation, climate index included."""
    wide = _tagged(spark, sf_dir)
    long = _long(wide)
    parts = [
        analytics.climatology(long, _TAGS).filter("value is not null").withColumns({"part": F.lit("climatology"), "variable2": F.lit(None).cast("string"), "quantile": F.lit(None).cast("double")}),
        analytics.quantiles(long, by=_TAGS).withColumns({"part": F.lit("quantile"), "variable2": F.lit(None).cast("string")}),
        analytics.cross_correlation(wide, _SV, _TAGS).withColumnRenamed("r", "value").withColumns({"part": F.lit("correlation"), "quantile": F.lit(None).cast("double")}),
    ]
    columns = ["part", *_TAGS, "qid", "month", "variable", "variable2", "quantile", "value"]
    out = parts[0].select(columns).unionByName(parts[1].select(columns)).unionByName(parts[2].select(columns))
    # Means and quantiles often end in a 5 after the last digit shown; this takes them off the edge, where sums in another order would tell.
    return out.withColumn("value", F.col("value") + 1e-9)


def _similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Sums of days depend in their last bits on the order of rows; equal values must stay equal.
    long = _long(_tagged(spark, sf_dir)).filter("variable != 'mei'").withColumn("value", F.round("value", 9))
    return analytics.similarity_ks(long.filter("source = 'hist'"), long.filter("source = 'stoc'"), ("stat",))


_KS_PARTS = """b AS (SELECT stat, qid, month, variable, round(value, 9) AS value, CASE WHEN source = 'hist' THEN 1 ELSE 0 END AS h FROM l WHERE variable <> 'mei' AND value IS NOT NULL),
c AS (SELECT *, sum(h) OVER u AS a, sum(1 - h) OVER u AS b, sum(h) OVER e AS n, sum(1 - h) OVER e AS m FROM b WINDOW e AS (PARTITION BY stat, qid, month, variable), u AS (PARTITION BY stat, qid, month, variable ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(
    "similarity_ks_all",
    f"""{_TAGGED}, {_KS_PARTS}
SELECT stat, qid, month, variable, CAST(max(n) AS BIGINT) AS n_hist, CAST(max(m) AS BIGINT) AS n_stoc, R(max(abs(a / n - b / m))) AS d FROM c WHERE n > 0 AND m > 0 GROUP BY ALL""",
)
def similarity_ks_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similarity(spark, sf_dir)


@query(
    "all_analytics",
    f"""{_PARTS}, {_KS_PARTS} {_PARTS_OUT}
UNION ALL SELECT 'ks', 'both', stat, qid, month, variable, NULL, NULL, R(max(abs(a / n - b / m)) + 1e-9) FROM c WHERE n > 0 AND m > 0 GROUP BY ALL""",
)
def all_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole validation in one table: what `run_analytics` gives, and the K-S distance of simulation from history."""
    parts = run_analytics(spark, sf_dir)
    nothing = {"part": F.lit("ks"), "source": F.lit("both"), "variable2": F.lit(None).cast("string"), "quantile": F.lit(None).cast("double"), "value": F.col("d") + 1e-9}
    return parts.unionByName(_similarity(spark, sf_dir).withColumns(nothing).select(parts.columns))


@query("similarity_ks_all_p")
def similarity_ks_all_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seasonal.with_two_sample_p(_similarity(spark, sf_dir))


# Row sets


@query("restrict_extent", f"SELECT {_YM}, R(value) AS value FROM weather_monthly WHERE year BETWEEN 1996 AND 1999 AND month BETWEEN 3 AND 9")
def restrict_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return example(spark, sf_dir, "weather_monthly").filter("year between 1996 and 1999 and month between 3 and 9")


@query("common_cells", "SELECT DISTINCT qid FROM weather_monthly WHERE qid IN (SELECT qid FROM cells WHERE z IS NOT NULL) AND qid IN (SELECT qid FROM trend WHERE slope > 0)")
def common_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = example(spark, sf_dir, "cells").filter("z is not null").select("qid")
    slopes = example(spark, sf_dir, "trend").filter("slope > 0").select("qid")
    return example(spark, sf_dir, "weather_monthly").select("qid").join(cells, "qid", "left_semi").join(slopes, "qid", "left_semi").distinct()


@query("scan_cells", "SELECT variable, year, month, R(value) AS value FROM weather_monthly WHERE qid = 757942")
def scan_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return example(spark, sf_dir, "weather_monthly").filter("qid = 757942").select("variable", "year", "month", "value")


