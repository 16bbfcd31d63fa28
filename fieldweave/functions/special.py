"""Special functions in numpy, vectorised; SciPy is not needed."""

from __future__ import annotations

import math

import numpy as np

lgamma = np.vectorize(math.lgamma, otypes=[float])


def log_gamma_ratio(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """ln gamma(x) - ln gamma(x + c) for positive x and x + c, without the loss that a difference of large numbers has."""
    out, y = np.zeros(np.broadcast(x, c).shape), x
    for _ in range(8):  # up to where the asymptotic series is exact
        out = out + np.log1p(c / y)
        y = y + 1

    def rest(v):
        f = 1 / (v * v)
        return (1 / 12 - f * (1 / 360 - f * (1 / 1260 - f * (1 / 1680 - f / 1188)))) / v

    return out - (y - 0.5) * np.log1p(c / y) - c * np.log(y + c) + c + rest(y) - rest(y + c)


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, dtype=float)
    out = np.zeros_like(x)
    for _ in range(8):  # up to where the asymptotic series is exact
        low = x < 8
        out = np.where(low, out - 1 / x, out)
        x = np.where(low, x + 1, x)
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def gamma_cdf(x: np.ndarray, shape: np.ndarray | float) -> np.ndarray:
    """The regularised lower incomplete gamma function, by its series or continued fraction."""
    x, a = np.broadcast_arrays(np.maximum(np.asarray(x, float), 0.0), np.asarray(shape, float))
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(x) - x - lgamma(a))
        term = 1 / a
        total = term.copy()
        for n in range(1, 400):
            term = term * x / (a + n)
            total = total + term
            if np.all(np.abs(term) <= 1e-16 * np.abs(total)):
                break
        series = front * total
        b = x + 1 - a
        c, d = np.full_like(x, 1e300), 1 / b
        h = d.copy()
        for n in range(1, 400):
            an = -n * (n - a)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + an / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            h = h * d * c
        tail = 1 - front * h
    return np.clip(np.where(x <= 0, 0.0, np.where(x < a + 1, series, tail)), 0.0, 1.0)


def gamma_ppf(p: np.ndarray, shape: float) -> np.ndarray:
    """By bisection on a bracket that is doubled until it holds the quantile."""
    p = np.asarray(p, float)
    low, high = np.zeros_like(p), np.full_like(p, max(shape, 1.0))
    for _ in range(200):
        short = gamma_cdf(high, shape) < np.minimum(p, 1 - 1e-12)
        if not short.any():
            break
        high = np.where(short, high * 2, high)
    for _ in range(80):
        mid = (low + high) / 2
        under = gamma_cdf(mid, shape) < p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


def gamma_fit(x: np.ndarray) -> tuple[float, float]:
    """(shape, scale) by maximum likelihood from positive values; NaN where they do not vary."""
    x = np.asarray(x, float)
    s = math.log(x.mean()) - np.log(x).mean() if len(x) else 0.0
    if s <= 1e-12:
        return math.nan, math.nan
    k = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(30):
        step = float(math.log(k) - digamma(np.array(k)) - s)
        slope = 1 / k - float(digamma(np.array(k + 1e-5)) - digamma(np.array(k - 1e-5))) / 2e-5
        k = max(k - step / slope, k / 4)
    return k, float(x.mean() / k)


def kolmogorov_p(d: float, n: float) -> float:
    """The asymptotic two-sided p-value with Stephens' small-sample correction."""
    t = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    return float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))))) if t > 0.2 else 1.0


def smirnov_p(d: float, n: int) -> float:
    """The exact p-value of the one-sided distance d of n values, summed in logarithms."""
    j = np.arange(int(math.floor(n * (1 - d))) + 1, dtype=float)
    left = 1 - d - j / n
    j, left = j[left > 0], left[left > 0]
    if not len(j):
        return d**n if d < 1 else 0.0
    logs = math.lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + (j - 1) * np.log(d + j / n) + (n - j) * np.log(left)
    return float(min(1.0, d * np.exp(logs).sum()))


def kolmogorov_exact_p(d: float, n: int, most: int = 10_000) -> float:
    """The exact two-sided p-value of the one-sample distance d of n values; asymptotic above `most` values.

    The distribution is an entry of the n-th power of a matrix of about 2nd rows,
    whose powers of two are scaled as they grow. Where the two sides exclude each
    other, or p is too small to be a difference from one, it is twice the one-sided p.
    """
    if not 0 < d < 1 or n < 1:
        return 1.0 if d <= 0 else 0.0
    if n > most:
        return kolmogorov_p(d, n)
    if 2 * n * d <= 1:
        return 1.0
    if d >= 0.5 or n * d * d > 18:
        return min(1.0, 2 * smirnov_p(d, n))
    k = int(n * d) + 1
    m, h = 2 * k - 1, k - n * d
    i = np.arange(m)
    # Entries 1/(i-j+1)! on and under the first upper diagonal; the first column and last row lose powers of h.
    x = i[:, None] - i[None, :] + 1
    x = np.where(x >= 0, np.exp(-lgamma(np.maximum(x, 0) + 1.0)), 0.0)
    lost = h ** (i + 1.0) * np.exp(-lgamma(i + 2.0))
    x[:, 0] -= lost
    x[-1, :] -= lost[::-1]
    if 2 * h > 1:
        x[-1, 0] += (2 * h - 1) ** m * math.exp(-math.lgamma(m + 1))
    out, scale, x_scale, e = np.eye(m), 0, 0, n
    while e:
        if e & 1:
            out, scale = out @ x, scale + x_scale
            if out[k - 1, k - 1] > 1e140:
                out, scale = out * 1e-140, scale + 140
        e >>= 1
        if e:
            x, x_scale = x @ x, 2 * x_scale
            if x[k - 1, k - 1] > 1e140:
                x, x_scale = x * 1e-140, x_scale + 140
    # Times n!/n^n.
    inside = out[k - 1, k - 1]
    if inside <= 0:
        return 1.0
    return float(min(1.0, max(0.0, -math.expm1(math.log(inside) + scale * math.log(10) + math.lgamma(n + 1) - n * math.log(n)))))


def two_sample_p(d: float, n: int, m: int, most: int = 10_000) -> float:
    """The exact two-sided p-value of the two-sample distance d of n and m values without ties between samples; asymptotic where one has more than `most`.

    Of all lattice paths from (0, 0) to (n, m), the share that reaches a distance
    of d: a point's share is the mean of its two predecessors' by the number of
    paths through them, so nothing overflows and small shares keep their digits.
    """
    if n < 1 or m < 1:
        return math.nan
    if max(n, m) > most:
        return kolmogorov_p(d, n * m / (n + m))
    n, m = max(n, m), min(n, m)
    reach = round(d * math.lcm(n, m))
    if reach <= 0:
        return 1.0
    a, b = math.lcm(n, m) // n, math.lcm(n, m) // m
    j = np.arange(m + 1)
    share = np.zeros(m + 1)  # of the points (s - j, j) on one antidiagonal s
    for s in range(1, n + m + 1):
        low, high = max(0, s - n), min(s, m)
        at = j[low : high + 1]
        i = s - at
        left = share[low : high + 1] * i  # from (i - 1, j); no such point has i = 0
        below = np.where(at > 0, share[at - 1], 0.0) * at
        new = (left + below) / s
        share = np.zeros(m + 1)
        share[low : high + 1] = np.where(np.abs(i * a - at * b) >= reach, 1.0, new)
    return float(min(1.0, share[m]))


def student_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p-values, by the continued fraction of the incomplete beta function; NaN without a degree of freedom."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    df, known = np.where(df > 0, df, 1.0), df > 0
    x, a, b = df / (df + t * t), df / 2, np.full_like(df, 0.5)

    def fraction(x, a, b):
        c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        h = d.copy()
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < 1e-300, 1e-300, c)
                h = h * d * c
        return h

    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(x) + b * np.log1p(-x) - (lgamma(a) + lgamma(b) - lgamma(a + b)))
        p = np.where(x >= 1, 1.0, np.where(x < (a + 1) / (a + b + 2), front * fraction(x, a, b) / a, 1 - front * fraction(1 - x, b, a) / b))
    return np.where(known, np.clip(p, 0, 1), np.nan)
