"""Distribution functions: for the driver, as Arrow UDFs, and as Column expressions where they need no iteration."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def ln_gamma(z: float) -> float:
    """Logarithm of the gamma function's absolute value; infinite at its poles."""
    if math.isnan(z):
        return NAN
    if z <= 0 and z == math.floor(z):
        return INF
    return math.lgamma(z)


def inc_beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction; NaN outside its domain."""
    if not (0 <= x <= 1) or not a > 0 or not b > 0:
        return NAN
    if x in (0.0, 1.0):
        return x
    if x > (a + 1) / (a + b + 2):
        return 1 - inc_beta(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 1000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            c = 1 + step / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return min(1.0, max(0.0, front * total))


def inc_gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function; NaN outside its domain."""
    if not a > 0 or not x >= 0:
        return NAN
    if x == 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # series of the lower function
        term = total = 1 / a
        for n in range(1, 10_000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return min(1.0, max(0.0, 1 - front * total))
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    total = d
    for n in range(1, 10_000):
        step = -n * (n - a)
        b += 2
        d = 1 / ((v if abs(v := step * d + b) > tiny else tiny))
        c = v if abs(v := b + step / c) > tiny else tiny
        total *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return min(1.0, max(0.0, front * total))


def student_t_cdf(t: float, df: float) -> float:
    if not math.isfinite(t) or not df > 0:
        return NAN
    tail = inc_beta(df / (df + t * t), df / 2, 0.5) / 2
    return 1 - tail if t > 0 else tail


def fisher_snedecor_cdf(f: float, d1: float, d2: float) -> float:
    if math.isnan(f) or not d1 > 0 or not d2 > 0:
        return NAN
    return 0.0 if f <= 0 else 1.0 if math.isinf(f) else inc_beta(d1 * f / (d1 * f + d2), d1 / 2, d2 / 2)


def f_survival(f: float, d1: float, d2: float) -> float:
    """1 - cdf without the loss of small tails."""
    if math.isnan(f) or not d1 > 0 or not d2 > 0:
        return NAN
    return 1.0 if f <= 0 else 0.0 if math.isinf(f) else inc_beta(d2 / (d1 * f + d2), d2 / 2, d1 / 2)


def chi_squared_survival(x: float, k: float) -> float:
    return NAN if math.isnan(x) or not k > 0 else 1.0 if x <= 0 else inc_gamma_upper(k / 2, x / 2)


#: Abramowitz and Stegun 7.1.26. Fixed values.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(z: float) -> float:
    """Abramowitz and Stegun's five-term formula, to about 1e-7."""
    if math.isnan(z):
        return NAN
    x = abs(z) / math.sqrt(2)
    t = 1 / (1 + ERF_P * x)
    poly = 0.0
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    tail = 0.5 * poly * math.exp(-x * x)
    return 1 - tail if z >= 0 else tail


def erf(x: float) -> float:
    return NAN if math.isnan(x) else math.erf(x)


def erfc(x: float) -> float:
    return NAN if math.isnan(x) else math.erfc(x)


def erfce(x: float) -> float:
    """exp(x*x) * erfc(x); by the continued fraction where erfc underflows."""
    if math.isnan(x):
        return NAN
    if x < 20:
        return math.exp(min(x * x, 709.0)) * math.erfc(x)
    total = 0.0
    for n in range(60, 0, -1):
        total = n / 2 / (x + total)
    return 1 / math.sqrt(math.pi) / (x + total)


def normal_cdf_exact(z: float) -> float:
    return NAN if math.isnan(z) else 0.5 * math.erfc(-z / math.sqrt(2))


def normal_sf_exact(z: float) -> float:
    return normal_cdf_exact(-z)


#: Acklam's rational approximation of the normal quantile: centre and tails. Fixed values.
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
ACKLAM_TAIL = 0.02425


def _horner(coefficients, x):
    out = coefficients[0]
    for c in coefficients[1:]:
        out = out * x + c
    return out


def acklam(p: float) -> float:
    """The approximation before refinement, relative error 1e-9."""
    if p < ACKLAM_TAIL:
        q = math.sqrt(-2 * math.log(p))
        return _horner(ACKLAM_C, q) / _horner(ACKLAM_D, q)
    if p > 1 - ACKLAM_TAIL:
        return -acklam(1 - p)
    q = p - 0.5
    return q * _horner(ACKLAM_A, q * q) / _horner(ACKLAM_B, q * q)


def normal_inverse_cdf(p: float) -> float:
    """Acklam's approximation and one step of Newton's method; infinite at 0 and 1, NaN outside."""
    if not 0 <= p <= 1:
        return NAN
    if p in (0.0, 1.0):
        return INF if p else -INF
    x = acklam(p)
    return x - (normal_cdf_exact(x) - p) * math.sqrt(2 * math.pi) * math.exp(x * x / 2)


def student_t_inverse_cdf(p: float, df: float) -> float:
    """Quantile by bisection of a bracket that grows as needed. The reference clamps at 20; this does not."""
    if not 0 < p < 1 or not df > 0:
        return NAN if not 0 <= p <= 1 or not df > 0 else INF if p else -INF
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -student_t_inverse_cdf(1 - p, df)
    low, high = 0.0, 2.0
    while student_t_cdf(high, df) < p and high < 1e300:
        low, high = high, high * 2
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if student_t_cdf(middle, df) < p:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def t_critical_quantile(df: float, alpha: float) -> float:
    """Two-sided."""
    return student_t_inverse_cdf(1 - alpha / 2, df)


def two_tailed_p_value(t: float, df: float) -> float:
    """0 beyond 100 in size."""
    if math.isnan(t):
        return NAN
    return 0.0 if abs(t) > 100 else inc_beta(df / (df + t * t), df / 2, 0.5)


def f_p_value(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else f_survival(f, d1, d2)


# ---- Column expressions


def normal_cdf_col(z: Column) -> Column:
    x = F.abs(z) / F.lit(math.sqrt(2))
    t = 1 / (1 + ERF_P * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    tail = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def acklam_col(p: Column) -> Column:
    def tail(v: Column) -> Column:
        q = F.sqrt(-2 * F.log(v))
        return _horner(tuple(map(F.lit, ACKLAM_C)), q) / _horner(tuple(map(F.lit, ACKLAM_D)), q)

    q = p - 0.5
    centre = q * _horner(tuple(map(F.lit, ACKLAM_A)), q * q) / _horner(tuple(map(F.lit, ACKLAM_B)), q * q)
    return F.when(p < ACKLAM_TAIL, tail(p)).when(p > 1 - ACKLAM_TAIL, -tail(1 - p)).otherwise(centre)


def chi_squared_survival_even_col(x: Column, k: int) -> Column:
    """Closed form for even degrees of freedom."""
    term = total = F.lit(1.0)
    for i in range(1, k // 2):
        term = term * (x / 2) / i
        total = total + term
    return F.when(x <= 0, 1.0).otherwise(F.exp(-x / 2) * total)


# ---- Arrow UDFs


def arrow(f: Callable[..., float]) -> Callable[..., Column]:
    """The function of doubles as an Arrow UDF; null in, null out."""

    def body(*columns: pd.Series) -> pd.Series:
        ok = np.logical_and.reduce([c.notna().to_numpy() for c in columns])
        out = np.full(len(columns[0]), np.nan, object)
        out[~ok] = None
        rows = zip(*(c.to_numpy()[ok] for c in columns), strict=True)
        out[ok] = [f(*map(float, r)) for r in rows]
        return pd.Series(out, dtype=object)

    args = {1: lambda a: body(a), 2: lambda a, b: body(a, b), 3: lambda a, b, c: body(a, b, c)}
    import inspect

    n = len(inspect.signature(f).parameters)
    one = args[n]
    one.__annotations__ = {**{k: pd.Series for k in inspect.signature(one).parameters}, "return": pd.Series}
    return F.pandas_udf(one, "double")


SQL_FUNCTIONS = {
    "ln_gamma": ln_gamma, "inc_beta": inc_beta, "inc_gamma_upper": inc_gamma_upper, "student_t_cdf": student_t_cdf, "fisher_snedecor_cdf": fisher_snedecor_cdf, "chi_squared_survival": chi_squared_survival,
    "normal_cdf": normal_cdf, "normal_cdf_exact": normal_cdf_exact, "normal_sf_exact": normal_sf_exact, "erf_value": erf, "erfc_value": erfc, "erfce_value": erfce, "normal_inverse_cdf": normal_inverse_cdf,
    "student_t_inverse_cdf": student_t_inverse_cdf, "t_critical_quantile": t_critical_quantile, "two_tailed_p_value": two_tailed_p_value, "f_p_value": f_p_value,
    "get_t_cdf": student_t_cdf, "get_normal_inverse": normal_inverse_cdf,
}


def get_t_critical(alpha: float, df: float) -> float:
    return t_critical_quantile(df, alpha)


def register(spark: SparkSession) -> list[str]:
    """Make the functions SQL functions of the session; returns their names."""
    names = {**SQL_FUNCTIONS, "get_t_critical": get_t_critical}
    for name, f in names.items():
        spark.udf.register(name, arrow(f))
    from statloom.sources.models import LIBRARY_VERSION

    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION get_version() RETURNS STRING RETURN '{LIBRARY_VERSION}'")
    return sorted([*names, "get_version"])
