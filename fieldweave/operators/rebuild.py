"""Days from seasons: scaling factors and the daily series they give.

The stored product is the table of scaling factors; simulated days are a view on
history and factors, joined on the cell first, so that filters on cells and
years reach both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import bucketed
from .seasonal import SEASONS, season_key, season_of, season_year

VARIABLES = ("pre", "tmax", "tmin")


def keyed(daily: DataFrame, seasons: tuple[int, ...] = SEASONS) -> DataFrame:
    """`daily` with its season, the season's year and the running season key."""
    y, m = F.year("date"), F.month("date")
    d = daily.withColumns({"season": season_of(m, seasons), "season_year": season_year(y, m, seasons)})
    return d.withColumn("key", season_key(F.col("season_year"), F.col("season"), seasons))


def scaling_factors(analogue: DataFrame, hist: DataFrame, stoc: DataFrame, seasons: tuple[int, ...] = SEASONS) -> DataFrame:
    """(qid, variable, year, season, key, ssf): simulated over historic seasonal value of the analogue; null where history is zero."""
    h = hist.select("variable", "season", "qid", F.col("year").alias("histyear"), F.col("value").alias("_h"))
    s = stoc.select("variable", "season", "qid", "year", F.col("value").alias("_s"))
    d = s.join(analogue, ["season", "year"]).join(h, ["variable", "season", "qid", "histyear"])
    return d.select("qid", "variable", "year", "season", season_key(F.col("histyear"), F.col("season"), seasons).alias("key"), F.try_divide("_s", "_h").alias("ssf"))


def widened(ssf: DataFrame, variables: tuple[str, ...] = VARIABLES) -> DataFrame:
    """(qid, year, key, ssf_<variable>...)."""
    return ssf.groupBy("qid", "year", "key").agg(*[F.max(F.when(F.col("variable") == v, F.col("ssf"))).alias(f"ssf_{v}") for v in variables])


def disaggregate(daily: DataFrame, ssf: DataFrame, variables: tuple[str, ...] = VARIABLES, seasons: tuple[int, ...] = SEASONS) -> DataFrame:
    """(qid, year, key, date, variables): historic days times the factors of every simulated year whose analogue they are.

    `year` is the simulated calendar year: days before the turn of a year belong to the year before their season's.
    """
    d = keyed(daily, seasons).join(widened(ssf, variables), ["qid", "key"])
    year = F.col("year") + F.year("date") - F.col("season_year")
    return d.select("qid", year.alias("year"), "key", "date", *[(F.col(v) * F.col(f"ssf_{v}")).alias(v) for v in variables])


def month_table(days: DataFrame, year: str, sums: tuple[str, ...] = ("pre",), variables: tuple[str, ...] = VARIABLES) -> DataFrame:
    """(qid, year, month, and per variable its sum or mean, max, min and sample variance)."""
    aggs = []
    for v in variables:
        aggs += [(F.sum if v in sums else F.avg)(v).alias(f"{v}_agg"), F.max(v).alias(f"{v}_max"), F.min(v).alias(f"{v}_min"), F.var_samp(v).alias(f"{v}_var")]
    return days.groupBy("qid", F.expr(year).alias("year"), F.month("date").alias("month")).agg(*aggs)


def season_totals(days: DataFrame, seasons: tuple[int, ...] = SEASONS, sums: tuple[str, ...] = ("pre",), variables: tuple[str, ...] = VARIABLES) -> DataFrame:
    """(variable, qid, year, season, value) of simulated days (qid, year, key, date, variables): sums, or means of monthly means, of seasons with all months."""
    year = (F.col("year") + F.when(F.month("date") > max(seasons), 1).otherwise(0)).cast("int").alias("year")
    season = F.element_at(F.array(*[F.lit(s) for s in sorted(seasons)]), (F.col("key") % len(seasons)).cast("int") + 1).alias("season")
    how = lambda v: F.sum(v) if v in sums else F.avg(v)
    m = days.groupBy("qid", year, season, F.month("date").alias("_m")).agg(*[how(v).alias(v) for v in variables])
    d = m.groupBy("qid", "year", "season").agg(F.count("*").alias("_n"), *[how(v).alias(v) for v in variables]).filter(F.col("_n") == 12 // len(seasons))
    return d.unpivot(["qid", "year", "season"], list(variables), "variable", "value").filter("value is not null")


def mismatches(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value", rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """(qid, n, bad): how many common values of two tables differ by more than the tolerance, per cell."""
    d = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys)
    off = F.abs(F.col("_a") - F.col("_b")) > atol + rtol * F.abs("_b")
    return d.groupBy("qid").agg(F.count("*").alias("n"), F.sum(F.when(off, 1).otherwise(0)).alias("bad"))


def eto_factors(daily: DataFrame, days: DataFrame, seasons: tuple[int, ...] = SEASONS) -> DataFrame:
    """(qid, year, key, ssf_eto): summed ETo of simulated days over that of the historic days they come from."""
    from .eto import hargreaves

    hist = hargreaves(keyed(daily, seasons)).groupBy("qid", "key").agg(F.sum("eto").alias("_h"))
    d = days.withColumn("season_year", F.col("year") + F.when(F.month("date") > max(seasons), 1).otherwise(0))
    stoc = hargreaves(d).groupBy("qid", F.col("season_year").alias("year"), "key").agg(F.sum("eto").alias("_s"))
    return stoc.join(hist, ["qid", "key"]).select("qid", "year", "key", F.try_divide("_s", "_h").alias("ssf_eto"))


def rebuilt(daily: DataFrame, ssf: DataFrame, eto_ssf: DataFrame, variables: tuple[str, ...] = VARIABLES, seasons: tuple[int, ...] = SEASONS) -> DataFrame:
    """(qid, year, date, variables, eto): simulated days of all cells and years from history, with its eto, and stored factors."""
    from .eto import hargreaves

    return _scaled(keyed(hargreaves(daily), seasons), widened(ssf, variables).join(eto_ssf, ["qid", "year", "key"], "left"), variables)


def _scaled(hist: DataFrame, factors: DataFrame, variables: tuple[str, ...]) -> DataFrame:
    """(qid, year, date, variables, eto) of keyed history with eto times its factors."""
    year = F.col("year") + F.year("date") - F.col("season_year")
    return hist.join(factors, ["qid", "key"]).select("qid", year.alias("year"), "date", *[(F.col(v) * F.col(f"ssf_{v}")).alias(v) for v in (*variables, "eto")])


def rebuilt_from_seasons(daily: DataFrame, ssf: DataFrame, variables: tuple[str, ...] = VARIABLES, seasons: tuple[int, ...] = SEASONS) -> DataFrame:
    """What `rebuilt` gives with the `eto_factors` of the same days, from a history that is exchanged once.

    History is stored with its eto in buckets of cell and season key, the factors likewise.
    History's sums of eto, the simulated days and theirs, and the final scaling all keep these buckets,
    so that days are read several times but never dealt out again; only sums, a row a season, are.
    """
    from .eto import hargreaves

    past_days = keyed(hargreaves(daily), seasons).select("qid", "key", "date", "season_year", *variables, "eto")
    hist = bucketed(daily.sparkSession, past_days, ["qid", "key"], "history")
    wide = bucketed(daily.sparkSession, widened(ssf, variables), ["qid", "key"], "factors")
    days = hist.join(wide, ["qid", "key"])
    days = days.select("qid", "year", "key", "date", *[(F.col(v) * F.col(f"ssf_{v}")).alias(v) for v in variables])
    stoc = hargreaves(days).groupBy("qid", "key", "year").agg(F.sum("eto").alias("_s"))
    past = hist.groupBy("qid", "key").agg(F.sum("eto").alias("_h"))
    eto_ssf = stoc.join(past, ["qid", "key"]).select("qid", "key", "year", F.try_divide("_s", "_h").alias("ssf_eto"))
    return _scaled(hist, wide.join(eto_ssf, ["qid", "key", "year"], "left"), variables)
