"""Monthly rain and temperature indices per cell, spells, and standardised indices.

Rolling sums run over rows, not over the calendar, and are null until complete.
Percentiles are exact, with linear interpolation, over a calendar month of all
years. Spells are cut at month ends. All windows start from the cell, so one
exchange by cell serves them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normal


def rolled(value: Column, n: int, keys: list[str], order: list[str], how: str = "sum") -> Column:
    """The sum or mean of the last n rows, or null if fewer have a value."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - n, 0)
    agg = F.sum(value) if how == "sum" else F.avg(value)
    return F.when(F.count(value).over(w) == n, agg.over(w))


def spells(daily: DataFrame, flag: str, cell: str = "qid") -> DataFrame:
    """(cell, year, month, start, days): every run of rows with `flag` inside a month."""
    keys = [cell, "year", "month"]
    d = daily.withColumns({"year": F.year("date"), "month": F.month("date")})
    every = Window.partitionBy(*keys).orderBy("date")
    d = d.withColumn("_row", F.row_number().over(every)).filter(F.col(flag))
    d = d.withColumn("_island", F.col("_row") - F.row_number().over(every))
    return d.groupBy(*keys, "_island").agg(F.min("date").alias("start"), F.count("*").alias("days")).drop("_island")


def month_percentiles(daily: DataFrame, columns: list[str], cell: str = "qid") -> DataFrame:
    """(cell, month, <column>_p05, <column>_p95) over all years."""
    found = daily.groupBy(cell, F.month("date").alias("month")).agg(
        *[F.percentile(c, F.array(F.lit(0.05), F.lit(0.95))).alias(c) for c in columns]
    )
    return found.select(cell, "month", *[F.col(c)[i].alias(f"{c}_{p}") for c in columns for i, p in enumerate(("p05", "p95"))])


def with_month_percentiles(daily: DataFrame, columns: list[str], cell: str = "qid") -> DataFrame:
    """`daily`, which has `month`, with the percentiles of its cell and month as columns: a window, so rows that lie by cell need no exchange."""
    w = Window.partitionBy(cell, "month")
    d = daily.withColumns({f"_{c}_q": F.percentile(c, F.array(F.lit(0.05), F.lit(0.95))).over(w) for c in columns})
    d = d.withColumns({f"{c}_{p}": F.col(f"_{c}_q")[i] for c in columns for i, p in enumerate(("p05", "p95"))})
    return d.drop(*[f"_{c}_q" for c in columns])


def _longest(flag: Column, keys: list[str]) -> tuple[Column, Column]:
    """Columns to add in turn: the count of unset rows so far, and the run length up to a row."""
    w = Window.partitionBy(*keys).orderBy("date")
    return F.sum(F.when(flag, 0).otherwise(1)).over(w), flag


def with_runs(daily: DataFrame, flags: dict[str, Column], keys: list[str]) -> DataFrame:
    """`daily` with, for each flag, `run_<name>`: the length of the run that a row is in, so far (0 outside)."""
    first = {f"_gap_{k}": _longest(f, keys)[0] for k, f in flags.items()}
    d = daily.withColumns(first)
    runs = {
        f"run_{k}": F.sum(F.when(f, 1).otherwise(0)).over(Window.partitionBy(*keys, f"_gap_{k}").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
        for k, f in flags.items()
    }
    return d.withColumns(runs).drop(*first)


def _stacked(wide: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    wide = wide.select(*keys, *[F.col(n).cast("double").alias(n) for n in names])
    return wide.unpivot(keys, names, "index_name", "value").filter("value is not null")


def rain_month(daily: DataFrame, wet: float = 1.0, cell: str = "qid") -> DataFrame:
    """One row per (cell, year, month) with the rain indices that need no distribution."""
    keys = [cell, "year", "month"]
    d = daily.repartition(cell).withColumns({"year": F.year("date"), "month": F.month("date")})
    d = d.withColumns({"pre48": rolled(F.col("pre"), 2, [cell], ["date"]), "pre72": rolled(F.col("pre"), 3, [cell], ["date"])})
    d = with_month_percentiles(d, ["pre"], cell)
    flags = {"lt": F.col("pre") <= F.col("pre_p05"), "gt": F.col("pre") > F.col("pre_p95")}
    d = with_runs(d, flags, keys)
    count = lambda f: F.sum(F.when(f, 1).otherwise(0))
    return d.groupBy(*keys).agg(
        F.sum("pre").alias("rsum"),
        count(F.col("pre") > wet).alias("rday"),
        count(flags["lt"]).alias("r_count_lt_p05"),
        F.max("run_lt").alias("r_spell_lt_p05"),
        count(flags["gt"]).alias("r_count_gt_p95"),
        F.max("run_gt").alias("r_spell_gt_p95"),
        F.sum(F.greatest(F.col("pre") - F.col("pre_p95"), F.lit(0.0))).alias("r_sum_gt_p95"),
        F.max("pre").alias("pre24"),
        F.max("pre48").alias("pre48"),
        F.max("pre72").alias("pre72"),
    )


RAIN = ["rsum", "rday", "r_count_lt_p05", "r_spell_lt_p05", "r_count_gt_p95", "r_spell_gt_p95", "r_sum_gt_p95", "pre24", "pre48", "pre72"]


def index_pre(daily: DataFrame, eto: bool = False, wet: float = 1.0, cell: str = "qid", spi: bool = False) -> DataFrame:
    """(cell, year, month, index_name, value); with `spi` also SPI 1, 3 and 6; with `eto` (a column of `daily`) also its sum and SPEI 1, 3 and 6."""
    keys = [cell, "year", "month"]
    rain = rain_month(daily, wet, cell)
    out = _stacked(rain, keys, RAIN)
    if spi:
        from .distributions import spi as fitted

        month = rain.select(*keys, F.col("rsum").alias("value"))
        for n in (1, 3, 6):
            s = fitted(month, n, cell).select(*keys, F.col("spi").alias(f"spi{n}"))
            out = out.unionByName(_stacked(s, keys, [f"spi{n}"]))
    if eto:
        month = daily.groupBy(cell, F.year("date").alias("year"), F.month("date").alias("month")).agg(F.sum("eto").alias("eto"), (F.sum("pre") - F.sum("eto")).alias("value"))
        wide = month
        for n in (1, 3, 6):
            s = spei_ecdf(month.select(*keys, "value"), n, cell).select(*keys, F.col("spei").alias(f"spei{n}"))
            wide = wide.join(s, keys, "left")
        out = out.unionByName(_stacked(wide, keys, ["eto", "spei1", "spei3", "spei6"]))
    return out


def index_tmp(
    daily: DataFrame,
    tmax_gt: tuple[float, ...] = (35, 40),
    tmin_gt: tuple[float, ...] = (15, 20),
    tmin_lt: tuple[float, ...] = (0,),
    cell: str = "qid",
) -> DataFrame:
    """(cell, year, month, index_name, value) of the temperature indices."""
    keys = [cell, "year", "month"]
    d = daily.repartition(cell).withColumns({"year": F.year("date"), "month": F.month("date")})
    rolls = {f"{v}{24 * n}": rolled(F.col(v), n, [cell], ["date"], "mean") for v in ("tmax", "tmin") for n in (2, 3)}
    d = with_month_percentiles(d.withColumns(rolls), ["tmax", "tmin"], cell)
    over: dict[str, tuple[Column, Column]] = {}
    for v in ("tmax", "tmin"):
        over[f"{v}_{{}}_lt_p05"] = (F.col(v) <= F.col(f"{v}_p05"), F.col(f"{v}_p05") - F.col(v))
        over[f"{v}_{{}}_gt_p95"] = (F.col(v) > F.col(f"{v}_p95"), F.col(v) - F.col(f"{v}_p95"))
    for v, limits in (("tmax", tmax_gt), ("tmin", tmin_gt)):
        for t in limits:
            over[f"{v}_{{}}_gt_{t}"] = (F.col(v) > t, F.col(v) - t)
    for t in tmin_lt:
        over[f"tmin_{{}}_lt_{t}"] = (F.col("tmin") <= t, t - F.col("tmin"))
    d = with_runs(d, {k.format("spell"): f for k, (f, _) in over.items()}, keys)
    aggs = [F.avg("tmax").alias("tmax_mean"), F.avg("tmin").alias("tmin_mean"), (F.avg("tmax") - F.avg("tmin")).alias("dtr_mean")]
    names = ["tmax_mean", "tmin_mean", "dtr_mean"]
    for k, (flag, excess) in over.items():
        aggs += [
            F.sum(F.when(flag, 1).otherwise(0)).alias(k.format("count")),
            F.sum(F.greatest(excess, F.lit(0.0))).alias(k.format("sum")),
            F.max("run_" + k.format("spell")).alias(k.format("spell")),
        ]
        names += [k.format(x) for x in ("count", "sum", "spell")]
    for v, how in (("tmax", F.max), ("tmin", F.min)):
        for n in (1, 2, 3):
            aggs.append(how(v if n == 1 else f"{v}{24 * n}").alias(f"{v}{24 * n}"))
            names.append(f"{v}{24 * n}")
    return _stacked(d.groupBy(*keys).agg(*aggs), keys, names)


def degree_days(daily: DataFrame, value: str, thresholds: tuple[float, ...], below: bool = False, cell: str = "qid") -> DataFrame:
    """(cell, year, month, threshold, degree_days): clipped sums beyond each threshold."""
    d = daily.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    excess = (F.col("threshold") - F.col(value)) if below else (F.col(value) - F.col("threshold"))
    return d.groupBy(cell, F.year("date").alias("year"), F.month("date").alias("month"), "threshold").agg(F.sum(F.greatest(excess, F.lit(0.0))).alias("degree_days"))


def rolling_month(monthly: DataFrame, n: int, cell: str = "qid") -> DataFrame:
    """(cell, year, month, value) with the sum of the last n months in place of `value`; incomplete ones are left out."""
    return monthly.select(cell, "year", "month", rolled(F.col("value"), n, [cell], ["year", "month"]).alias("value")).filter("value is not null")


def spei_ecdf(balance: DataFrame, n: int = 3, cell: str = "qid") -> DataFrame:
    """(cell, year, month, value, spei) from plotting positions within a calendar month; ties go by year."""
    d = rolling_month(balance, n, cell)
    month = Window.partitionBy(cell, "month")
    size = F.count("*").over(month)
    a = F.when(size <= 10, F.lit(0.375)).otherwise(F.lit(0.5))
    d = d.withColumn("p", (F.row_number().over(month.orderBy("value", "year")) - a) / (size + 1 - 2 * a))
    return d.withColumn("spei", F.expr(normal.ppf_sql("p"))).select(cell, "year", "month", "value", "spei")


def l_moments(values: DataFrame, keys: list[str], value: str = "value", plotting: bool = False) -> DataFrame:
    """(keys, n, l1..l4, t2, t3, t4) by probability-weighted moments, unbiased or from plotting positions.

    t2 is the ratio of l2 to itself, as in the reference definition of the ratios by order.
    """
    w = Window.partitionBy(*keys)
    d = values.filter(F.col(value).isNotNull())
    d = d.withColumn("_j", F.row_number().over(w.orderBy(value)).cast("double")).withColumn("_n", F.count("*").over(w).cast("double"))
    weight = []
    for r in range(4):
        x = F.col(value)
        if plotting:
            for _ in range(r):
                x = x * (1 - (F.col("_j") - 0.35) / F.col("_n"))
            weight.append(F.sum(x / F.col("_n")).alias(f"a{r}"))
        else:
            bottom = F.col("_n")
            for k in range(r):
                x, bottom = x * (F.col("_n") - F.col("_j") - k), bottom * (F.col("_n") - k - 1)
            weight.append(F.sum(F.try_divide(x, bottom)).alias(f"a{r}"))
    a = d.groupBy(*keys).agg(F.count("*").alias("n"), *weight)
    a = a.select(
        *keys, "n", F.col("a0").alias("l1"), F.expr("a0 - 2 * a1").alias("l2"), F.expr("a0 - 6 * a1 + 6 * a2").alias("l3"),
        F.expr("a0 - 12 * a1 + 30 * a2 - 20 * a3").alias("l4"),
    )
    return a.withColumns({"t2": F.try_divide("l2", "l2"), "t3": F.try_divide("l3", "l2"), "t4": F.try_divide("l4", "l2")})


def genlogistic_params(moments: DataFrame) -> DataFrame:
    """`moments` with k, alpha, xi of the generalised logistic; null where a shape of zero leaves them open."""
    k = -F.col("t3")
    kpi = k * math.pi
    alpha = F.try_divide(F.col("l2") * F.sin(kpi), kpi)
    xi = F.col("l1") - alpha * (F.try_divide(F.lit(1.0), k) - F.try_divide(F.lit(math.pi), F.sin(kpi)))
    return moments.withColumns({"k": k, "alpha": alpha, "xi": xi})


def genlogistic_y(x: Column, k: Column, alpha: Column, xi: Column) -> Column:
    inner = 1 - k * F.try_divide(x - xi, alpha)
    return F.when(inner > 0, -F.try_divide(F.ln(F.when(inner > 0, inner)), k))


def genlogistic_cdf(x: Column, k: Column, alpha: Column, xi: Column) -> Column:
    return 1 / (1 + F.exp(-genlogistic_y(x, k, alpha, xi)))


def genlogistic_pdf(x: Column, k: Column, alpha: Column, xi: Column) -> Column:
    y = genlogistic_y(x, k, alpha, xi)
    return F.exp(-(1 - k) * y) / alpha / F.pow(1 + F.exp(-y), F.lit(2))


def spei_lmoment(balance: DataFrame, n: int = 3, plotting: bool = False, cell: str = "qid") -> DataFrame:
    """(cell, year, month, value, spei) through the generalised logistic fitted by L-moments."""
    d = rolling_month(balance, n, cell)
    params = genlogistic_params(l_moments(d, [cell, "month"], plotting=plotting)).select(cell, "month", "k", "alpha", "xi")
    d = d.join(params, [cell, "month"]).withColumn("p", genlogistic_cdf(F.col("value"), F.col("k"), F.col("alpha"), F.col("xi")))
    return d.withColumn("spei", F.expr(normal.ppf_sql("p"))).select(cell, "year", "month", "value", "spei")
