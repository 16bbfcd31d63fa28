"""The normal distribution as SQL expression text, and its numpy twins.

The text runs in Spark SQL and in other ANSI engines alike, so a query and its
check share one definition. Rational approximations: the cdf is good to 1e-14,
the quantile to 1e-9 relative.
"""

from __future__ import annotations

import numpy as np

# Coefficients of the rational approximations.
CDF_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
LOW = 0.02425


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    out = f"{coefficients[0]:.17g}e0" if "e" not in f"{coefficients[0]:.17g}" else f"{coefficients[0]:.17g}"
    for c in coefficients[1:]:
        number = f"{c:.17g}"
        out = f"({out} * {x} + {number if 'e' in number else number + 'e0'})"
    return out


def cdf_sql(x: str) -> str:
    """The standard normal cdf of a double column or expression; null stays null."""
    z = f"abs({x})"
    upper = f"exp(-({x}) * ({x}) / 2e0) * {_horner(CDF_TOP, z)} / {_horner(CDF_BOTTOM, z)}"
    return f"(CASE WHEN {z} > 37e0 THEN CASE WHEN {x} > 0e0 THEN 1e0 ELSE 0e0 END WHEN {x} > 0e0 THEN 1e0 - {upper} ELSE {upper} END)"


def ppf_sql(p: str) -> str:
    """The standard normal quantile of a probability strictly between 0 and 1; others give null."""
    q = f"sqrt(-2e0 * ln(CASE WHEN {p} < 0.5e0 THEN {p} ELSE 1e0 - {p} END))"
    tail = f"{_horner(PPF_C, q)} / {_horner(PPF_D, q)}"
    c = f"({p} - 0.5e0)"
    r = f"({c} * {c})"
    middle = f"{_horner(PPF_A, r)} * {c} / {_horner(PPF_B, r)}"
    return f"(CASE WHEN {p} <= 0e0 OR {p} >= 1e0 THEN NULL WHEN {p} < {LOW}e0 THEN {tail} WHEN {p} > 1e0 - {LOW}e0 THEN -({tail}) ELSE {middle} END)"


def cdf(x: np.ndarray) -> np.ndarray:
    z = np.abs(x)
    upper = np.exp(-x * x / 2) * np.polyval(CDF_TOP, z) / np.polyval(CDF_BOTTOM, z)
    return np.where(z > 37, x > 0, np.where(x > 0, 1 - upper, upper))


def ppf(p: np.ndarray) -> np.ndarray:
    p = np.asarray(p, dtype=float)
    with np.errstate(all="ignore"):
        q = np.sqrt(-2 * np.log(np.minimum(p, 1 - p)))
        tail = np.polyval(PPF_C, q) / np.polyval(PPF_D, q)
        c = p - 0.5
        middle = np.polyval(PPF_A, c * c) * c / np.polyval(PPF_B, c * c)
        out = np.where(p < LOW, tail, np.where(p > 1 - LOW, -tail, middle))
    return np.where((p > 0) & (p < 1), out, np.nan)


def hashed_normal_sql(key: str) -> str:
    """A standard normal that depends only on a string key: two uniforms from its MD5, by Box-Muller."""
    u = lambda at: f"((CAST(conv(substr(md5({key}), {at}, 13), 16, 10) AS DOUBLE) + 0.5e0) / 4503599627370496e0)"
    return f"(sqrt(-2e0 * ln({u(1)})) * cos(6.283185307179586e0 * {u(14)}))"
