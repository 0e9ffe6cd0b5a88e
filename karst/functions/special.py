"""Special functions that Spark lacks.

The chi-square tail with one degree of freedom is erfc(sqrt(x / 2)); it is a column expression, whole
Arrow batches at a time in numpy. The other functions take and give plain numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lgamma(x: float) -> float:
    return math.lgamma(x)


def erfc(x: float) -> float:
    return math.erfc(x)


def gamma_p(s: float, z: float) -> float:
    """Regularised lower incomplete gamma function."""
    if z <= 0:
        return 0.0
    return _series(s, z) if z < s + 1 else 1 - _fraction(s, z)


def gamma_q(s: float, z: float) -> float:
    """Regularised upper incomplete gamma function."""
    if z <= 0:
        return 1.0
    return 1 - _series(s, z) if z < s + 1 else _fraction(s, z)


def _series(s: float, z: float) -> float:
    term = total = 1.0 / s
    n = s
    while abs(term) > abs(total) * 1e-16:
        n += 1
        term *= z / n
        total += term
    return total * math.exp(s * math.log(z) - z - math.lgamma(s))


def _fraction(s: float, z: float) -> float:
    """Continued fraction of the upper tail, evaluated forwards (Lentz)."""
    tiny = 1e-300
    b = z + 1 - s
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        a = -i * (i - s)
        b += 2
        d = 1 / (a * d + b or tiny)
        c = b + a / c or tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-16:
            break
    return h * math.exp(s * math.log(z) - z - math.lgamma(s))


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(10_000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * (f - 1) / a


def fisher_exact(n11: int, n12: int, n21: int, n22: int) -> tuple[float, float, float, float]:
    """Probability of a 2 x 2 table, and the left, right and two-sided tails."""
    r1, c1, n = n11 + n12, n11 + n21, n11 + n12 + n21 + n22
    lo, hi = max(0, r1 + c1 - n), min(r1, c1)
    choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    p = [math.exp(choose(r1, k) + choose(n - r1, c1 - k) - choose(n, c1)) for k in range(lo, hi + 1)]
    own = p[n11 - lo]
    two = min(1.0, sum(x for x in p if x <= own * (1 + 1e-7)))
    return own, min(1.0, sum(p[: n11 - lo + 1])), min(1.0, sum(p[n11 - lo :])), two


def erfc_array(z: np.ndarray) -> np.ndarray:
    """erfc of non-negative numbers: a series of positive terms below 2.5, a continued fraction above."""
    z = np.asarray(z, float)
    out = np.empty(z.shape)
    low = z < 2.5
    x = z[low]
    term = x * 2 / math.sqrt(math.pi) * np.exp(-x * x)
    total = term.copy()
    for n in range(1, 60):
        term = term * (2 * x * x / (2 * n + 1))
        total += term
    out[low] = 1 - total
    x = z[~low]
    with np.errstate(all="ignore"):
        f = np.zeros(x.shape)
        for n in range(80, 0, -1):
            f = (n / 2) / (x + f)
        out[~low] = np.exp(-x * x) / math.sqrt(math.pi) / (x + f)
    return out


@F.pandas_udf(DoubleType())
def chi_square_tail(x: pd.Series) -> pd.Series:
    """P(X > x) of chi-square with one degree of freedom; nan and null give 1, and so does x below 0."""
    v = x.to_numpy(float, na_value=np.nan)
    ok = v >= 0
    return pd.Series(np.where(ok, erfc_array(np.sqrt(np.where(ok, v, 0.0) / 2)), 1.0))
