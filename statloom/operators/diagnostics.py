"""The fourteen residual, influence and collinearity diagnostics.

Tests that need a row order take ``order_by``, a unique column, since a DataFrame has none of its own. Rows are numbered over
range partitions, so no task sees all of them.
Each test gives a dictionary (``frame`` makes it a row); influence measures give columns on the input.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.errors import ComputationFailed, InsufficientData, InvalidInput, SingularMatrix
from statloom.functions import special
from statloom.operators.linear import LinearFit, linear, ols
from statloom.plans import solve
from statloom.plans.moments import moments, need, number
from statloom.plans.ordered import names, number_rows

ALPHA = 0.05


def frame(df: DataFrame, result: dict) -> DataFrame:
    """The scalars of a result as one row."""
    flat = {k: v for k, v in result.items() if isinstance(v, (int, float, str, bool))}
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    return df.sparkSession.createDataFrame([tuple(flat.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in flat.items()))


#: What to do about a failed test, by the first word of its name.
GUIDANCE = {
    "Rainbow": "try transformed predictors, polynomial terms or a local fit", "Harvey-Collier": "try transformed predictors, polynomial terms or a local fit", "RESET": "add powers or products of predictors, or transform the response",
    "Breusch-Pagan": "use weighted least squares or robust standard errors, or transform the response", "White": "use weighted least squares or robust standard errors, or transform the response",
    "Jarque-Bera": "look for outliers or transform the response; in large samples intervals hold nonetheless", "Shapiro-Wilk": "look for outliers or transform the response; in large samples intervals hold nonetheless",
    "Anderson-Darling": "look for outliers or transform the response, above all in the tails", "Durbin-Watson": "add lagged terms, difference the series or model the errors", "Breusch-Godfrey": "add lagged terms, difference the series or model the errors",
}


def _result(name: str, statistic: float, p: float, sound: str, unsound: str, **more) -> dict:
    passed = p > ALPHA
    guidance = "no action is needed" if passed else GUIDANCE.get(name.split(" ")[0], "look at the residuals")
    return {"test_name": name, "statistic": float(statistic), "p_value": float(p), "passed": bool(passed), "interpretation": sound if passed else unsound, "guidance": guidance, **more}


def both(test, *args, **options) -> dict:
    """A test's two variants (rainbow, white): results named r and python; one that fails is None. It passes if those that there are do."""

    def one(method: str) -> dict | None:
        try:
            return test(*args, **options, method=method)
        except (ComputationFailed, InsufficientData, SingularMatrix):
            return None

    found = {"r": one("R"), "python": one("Python")}
    known = [v for v in found.values() if v]
    if not known:
        raise ComputationFailed("neither variant could be computed")
    return {"test_name": f"{known[0]['test_name'].split(' ')[0]} (both)", "passed": all(v["passed"] for v in known), **found}


def _columns(y: str, x: Sequence[str], columns: dict[str, Column] | None) -> dict[str, Column]:
    return {c: (columns or {}).get(c, number(c)) for c in [*x, y]}


def residuals(df: DataFrame, y: str, x: Sequence[str], columns: dict[str, Column] | None = None, keep: Sequence[str] = ()) -> tuple[DataFrame, dict]:
    """The kept columns, c0.. (predictors), y, yhat and e of a fit that falls back to a small ridge where predictors are collinear."""
    own = _columns(y, x, columns)
    m = moments(df, own)
    need(m.n, 2)
    if m.n <= len(x) + 1 or solve.near_singular(m, list(x)):
        b = solve.ridge_fallback(m, list(x), y)
        s = None
    else:
        s = solve.intercept_solution(m, list(x), y)
        b = s.b
    fitted = linear([own[c] for c in x], b)
    out = df.select(*keep, *(own[c].alias(f"c{i}") for i, c in enumerate(x)), own[y].alias("y"), fitted.alias("yhat"), (own[y] - fitted).alias("e"))
    return out, {"moments": m, "solution": s, "n": int(m.n), "p": len(x) + 1, "b": b}


def rss_of(df: DataFrame, target: Column, regressors: list[Column]) -> tuple[float, float, int]:
    """RSS, TSS and n of the target on an intercept and the regressors. Collinear regressors count once."""
    own = {f"x{i}": c for i, c in enumerate(regressors)} | {"t": target}
    m = moments(df, own)
    own_names = [f"x{i}" for i in range(len(regressors))]
    kept = [0]
    for i, c in enumerate(own_names):  # forward, leaving out what earlier regressors determine
        tried = [own_names[j - 1] for j in kept if j] + [c]
        if not solve.near_singular(m, tried):
            kept.append(i + 1)
    s = solve.intercept_solution(m, own_names, "t", kept)
    if s.exact_rss:
        return s.rss, s.tss, int(m.n)
    e = target - linear(regressors, s.b)
    return float(df.agg(F.sum(e * e)).first()[0]), s.tss, int(m.n)


# ---- linearity


def rainbow_block(n: int, fraction: float, method: str) -> tuple[int, int]:
    """First row (from 1) and number of rows of the central block."""
    if method == "R":
        return math.ceil((0.5 - fraction / 2) * (n - 1) + 1), math.floor(fraction * n)
    low = math.ceil(0.5 * (1 - fraction) * n)
    return low + 1, math.floor(low + fraction * n) - low


def rainbow(df: DataFrame, y: str, x: Sequence[str], order_by: str, fraction: float = 0.5, method: str = "R", columns: dict[str, Column] | None = None) -> dict:
    """Fit of the central block against that of all rows, in the original order. A fraction that is not between 0 and 1 counts as a half."""
    fraction = fraction if 0 < fraction < 1 else 0.5
    own = _columns(y, x, columns)
    rows = number_rows(df, order_by, own).rows
    rss, _, n = rss_of(rows, F.col(y), [F.col(c) for c in x])
    p = len(x) + 1
    need(n, p + 2)
    first, m = rainbow_block(n, fraction, method)
    if m <= p:
        raise InsufficientData(p + 1, m)
    inner, _, m = rss_of(rows.where((F.col("_t") >= first) & (F.col("_t") < first + m)), F.col(y), [F.col(c) for c in x])
    f = max(rss - inner, 0.0) / (n - m) / (inner / (m - p))
    return _result(f"Rainbow ({method})", f, special.f_p_value(f, n - m, m - p), "linear fit is adequate", "the relation is not linear")


def recursive_residuals(y: np.ndarray, x: np.ndarray, xtx: np.ndarray | None = None, xty: np.ndarray | None = None, before: int = 0) -> np.ndarray:
    """Standardised one-step prediction errors in order, by updates of the inverse, after ``before`` rows of the given products. NaN until the rows so far determine a fit."""
    n, p = x.shape
    a = np.zeros((p, p)) if xtx is None else xtx.copy()
    c = np.zeros(p) if xty is None else xty.copy()
    inverse = b = None
    out = np.full(n, np.nan)
    for i in range(n):
        if inverse is None and before + i >= p:
            d = np.sqrt(np.diag(a))
            if (d > 0).all() and np.linalg.eigvalsh(a / np.outer(d, d))[0] > 1e-12:
                inverse = np.linalg.inv(a / np.outer(d, d)) / np.outer(d, d)
                b = inverse @ c
        if inverse is None:
            a += np.outer(x[i], x[i])
            c += x[i] * y[i]
            continue
        g = inverse @ x[i]
        scale = 1 + x[i] @ g
        error = y[i] - x[i] @ b
        out[i] = error / math.sqrt(scale)
        b = b + g * (error / scale)
        inverse -= np.outer(g, g) / scale
    return out


def harvey_collier(df: DataFrame, y: str, x: Sequence[str], order_by: str, method: str = "R", columns: dict[str, Column] | None = None) -> dict:
    """t test of the recursive residuals' mean. ``Python`` leaves out the first residuals below three terms and keeps the sign.

    A residual needs only the products of the rows before it. With one predictor those are running sums; with more, each
    range partition starts from the products of the earlier ones and updates its own.
    """
    own = _columns(y, x, columns)
    k, p = len(x), len(x) + 1
    shift = df.agg(*(F.avg(own[c]) for c in x), F.avg(own[y])).first()
    about = {f"u{i}": own[c] - F.lit(float(v or 0.0)) for i, (c, v) in enumerate(zip([*x, y], shift, strict=True))}  # residuals keep their values
    rows = number_rows(df, order_by, about)
    need(rows.n, p + 2)
    if k == 1:
        u, v = F.col("u0"), F.col("u1")
        s = rows.running({"sx": u, "sy": v, "sxx": u * u, "sxy": u * v})
        m = (F.col("_t") - 1).cast("double")
        dx = F.col("sxx") - F.col("sx") * F.col("sx") / m
        mid = u - F.col("sx") / m
        s = s.where("_t > 2").where(dx > 1e-12)
        r = s.select("_t", ((v - F.col("sy") / m - (F.col("sxy") - F.col("sx") * F.col("sy") / m) / dx * mid) / F.sqrt(1 + 1 / m + mid * mid / dx)).alias("w"))
    else:
        terms = [F.lit(1.0), *(F.col(f"u{i}") for i in range(k))]
        sums = {f"a{i}_{j}": terms[i] * terms[j] for i in range(p) for j in range(i, p)} | {f"c{i}": terms[i] * F.col(f"u{k}") for i in range(p)}
        parts = {r["_p"]: r for r in rows.rows.groupBy("_p").agg(*(F.sum(c).alias(n) for n, c in sums.items())).collect()}
        a, c, starts = np.zeros((p, p)), np.zeros(p), {}
        for part in sorted(parts, key=lambda q: rows.starts[q]):
            starts[part] = (a.copy(), c.copy(), rows.starts[part])
            for i in range(p):
                c[i] += parts[part][f"c{i}"]
                for j in range(i, p):
                    a[i, j] += parts[part][f"a{i}_{j}"]
                    a[j, i] = a[i, j]

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("_t")
            design = np.column_stack([np.ones(len(frame)), frame[[f"u{i}" for i in range(k)]].to_numpy(float)])
            w = recursive_residuals(frame[f"u{k}"].to_numpy(float), design, *starts[int(frame["_p"].iloc[0])])
            return pd.DataFrame({"_t": frame["_t"], "w": w})[~np.isnan(w)]

        r = rows.rows.groupBy("_p").applyInPandas(run, "_t long, w double")
    if method != "R":
        r = r.where(F.col("_t") > p + max(0, 3 - p))
    row = r.agg(F.sum("w").alias("s"), F.stddev_samp("w").alias("sd"), F.count("*").alias("m")).first()
    if not row["sd"]:
        raise ComputationFailed("the recursive residuals have no variance")
    scaled = row["s"] / row["sd"] / math.sqrt(row["m"])
    statistic = abs(scaled) if method == "R" else scaled
    return _result(f"Harvey-Collier ({method})", statistic, special.two_tailed_p_value(statistic, rows.n - p - 1), "linear fit is adequate", "the relation is not linear")


def reset(df: DataFrame, y: str, x: Sequence[str], powers: Sequence[int] = (2, 3), kind: str = "fitted", columns: dict[str, Column] | None = None) -> dict:
    """F test of added powers of the fitted values, of each regressor, or of the regressors' first principal component (uncentred scores)."""
    if not powers or min(powers) < 2:
        raise InvalidInput("powers must be 2 or more")
    rows, fit = residuals(df, y, x, columns)
    base = [F.col(f"c{i}") for i in range(len(x))]
    if kind == "fitted":
        # a fit keeps its RSS when a regressor is shifted and scaled, and its powers stay comparable
        mid, spread = rows.agg(F.avg("yhat"), F.stddev_pop("yhat")).first()
        z = (F.col("yhat") - F.lit(float(mid))) / F.lit(float(spread) or 1.0)
        added = [functools.reduce(lambda a, b: a * b, [z] * d) for d in range(2, max(powers) + 1)] if list(powers) == list(range(2, max(powers) + 1)) else [F.pow("yhat", F.lit(d)) for d in powers]
    elif kind == "regressor":
        added = [F.pow(c, F.lit(d)) for c in base for d in powers]
    else:
        s = fit["moments"].pick(list(x)).s
        v = np.linalg.eigh(s)[1][:, -1]
        v = v * (1 if v.sum() >= 0 else -1)
        score = linear(base, [0.0, *v])
        added = [F.pow(score, F.lit(d)) for d in powers]
    rss0, _, n = rss_of(rows, F.col("y"), base)
    rss1, _, _ = rss_of(rows, F.col("y"), base + added)
    q = len(added)
    d2 = n - len(x) - 1 - q
    need(d2, 1)
    f = d2 / q * (rss0 - rss1) / rss1
    f = f if math.isfinite(f) and f > 0 else 0.0
    return _result("RESET", f, special.f_p_value(f, q, d2), "the form is adequate", "the form is misspecified", df1=q, df2=d2)


# ---- heteroscedasticity


def breusch_pagan(df: DataFrame, y: str, x: Sequence[str], columns: dict[str, Column] | None = None) -> dict:
    """Koenker's studentised form: n times R squared of the squared residuals on the predictors."""
    rows, _ = residuals(df, y, x, columns)
    rss, tss, n = rss_of(rows, F.col("e") * F.col("e"), [F.col(f"c{i}") for i in range(len(x))])
    r2 = min(1.0, max(0.0, 1 - rss / tss)) if tss > 0 else 0.0
    return _result("Breusch-Pagan", n * r2, special.chi_squared_survival(n * r2, len(x)), "the variance is constant", "the variance is not constant", df=len(x))


def white(df: DataFrame, y: str, x: Sequence[str], method: str = "R", columns: dict[str, Column] | None = None) -> dict:
    """n times R squared of the squared residuals on predictors and squares (R), and their products (Python)."""
    rows, _ = residuals(df, y, x, columns)
    k = len(x)
    base = [F.col(f"c{i}") for i in range(k)]
    mids = rows.agg(*(F.avg(c) for c in base)).first()
    shifted = [c - F.lit(float(v)) for c, v in zip(base, mids, strict=True)]  # the same space, better conditioned
    terms = [*base, *(c * c for c in shifted)]
    if method != "R":
        terms += [shifted[i] * shifted[j] for i in range(k) for j in range(i + 1, k)]
    rss, tss, n = rss_of(rows, F.col("e") * F.col("e"), terms)
    dof = 2 * k if method == "R" else min(k * (k + 3) // 2, n - 1)
    lm = n * (min(1.0, max(0.0, 1 - rss / tss)) if tss > 0 else 0.0)
    return _result(f"White ({method})", lm, special.chi_squared_survival(lm, dof), "the variance is constant", "the variance is not constant", df=dof)


# ---- normality


def jarque_bera(df: DataFrame, y: str, x: Sequence[str], columns: dict[str, Column] | None = None) -> dict:
    rows, fit = residuals(df, y, x, columns)
    row = rows.agg(F.skewness("e").alias("s"), F.kurtosis("e").alias("k")).first()
    if row["s"] is None:
        raise ComputationFailed("the residuals have no variance")
    jb = fit["n"] / 6 * (row["s"] ** 2 + row["k"] ** 2 / 4)
    return _result("Jarque-Bera", jb, math.exp(-jb / 2), "the residuals are normal", "the residuals are not normal", skewness=float(row["s"]), excess_kurtosis=float(row["k"]))


#: Royston's polynomials in n (AS R94). Fixed values.
SW_C1, SW_C2 = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056), (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SW_SMALL_MEAN, SW_SMALL_SD, SW_G = (0.544, -0.39978, 0.025054, -6.714e-4), (1.3822, -0.77857, 0.062767, -0.0020322), (-2.273, 0.459)
SW_MEAN, SW_SD = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)


def _poly(c: Sequence[float], x: float) -> float:
    return sum(v * x**i for i, v in enumerate(c))


def shapiro_weights(n: int) -> np.ndarray:
    """Royston's weights of the ordered sample."""
    if n == 3:
        return np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    m = np.array([special.normal_inverse_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    norm, u = float(m @ m), 1 / math.sqrt(n)
    a = m / math.sqrt(norm)
    last = a[-1] + _poly(SW_C1, u)
    if n > 5:
        second = a[-2] + _poly(SW_C2, u)
        phi = (norm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
        out = m / math.sqrt(phi)
        out[[-1, -2, 0, 1]] = last, second, -last, -second
    else:
        phi = (norm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
        out = m / math.sqrt(phi)
        out[[-1, 0]] = last, -last
    return out


def shapiro_wilk_sample(v: np.ndarray) -> tuple[float, float]:
    """W and p of 3 to 5000 values."""
    n = len(v)
    if not 3 <= n <= 5000:
        raise InvalidInput("Shapiro-Wilk takes 3 to 5000 values")
    v = np.sort(v)
    d = v - v.mean()
    if not d @ d > 0:
        raise ComputationFailed("the values have no variance")
    w = min(1.0, float((shapiro_weights(n) @ v) ** 2 / (d @ d)))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if n <= 11:
        gamma = _poly(SW_G, n)
        if math.log1p(-w) >= gamma:
            return w, 0.0
        z = (-math.log(gamma - math.log1p(-w)) - _poly(SW_SMALL_MEAN, n)) / math.exp(_poly(SW_SMALL_SD, n))
    else:
        ln = math.log(n)
        z = ((math.log1p(-w) if w < 1 else -math.inf) - _poly(SW_MEAN, ln)) / math.exp(_poly(SW_SD, ln))
    return w, special.normal_sf_exact(z)


def shapiro_wilk(df: DataFrame, y: str, x: Sequence[str], columns: dict[str, Column] | None = None) -> dict:
    """On residuals; at most 5000 rows, which bounds what is collected. Without predictors: on y itself."""
    rows = residuals(df, y, x, columns)[0] if x else df.select(_columns(y, x, columns)[y].alias("e"))
    v = np.array([r[0] for r in rows.select("e").limit(5001).collect()], float)
    w, p = shapiro_wilk_sample(v)
    return _result("Shapiro-Wilk", w, p, "the residuals are normal", "the residuals are not normal", n=len(v))


def anderson_darling_p(a: float, n: int) -> float:
    """D'Agostino and Stephens' pieces for the statistic adjusted for n."""
    z = a * (1 + 0.75 / n + 2.25 / n**2)
    if z < 0.2:
        return 1 - math.exp(-13.436 + 101.14 * z - 223.73 * z * z)
    if z < 0.34:
        return 1 - math.exp(-8.318 + 42.796 * z - 59.938 * z * z)
    if z < 0.6:
        return math.exp(0.9177 - 4.279 * z - 1.38 * z * z)
    if z < 10:
        return math.exp(1.2937 - 5.709 * z + 0.0186 * z * z)
    return 3.7e-24


def anderson_darling(df: DataFrame, y: str, x: Sequence[str], columns: dict[str, Column] | None = None) -> dict:
    """The raw statistic; its p-value from the adjusted one. Needs 8 values. Ranks in both directions come from one sort and the count; the order of equal values does not matter, so they are spread by a number of their own."""
    rows = residuals(df, y, x, columns)[0] if x else df.select(_columns(y, x, columns)[y].alias("e"))
    n, mid, sd = rows.agg(F.count("*"), F.avg("e"), F.stddev_samp("e")).first()
    need(n, 8)
    if not sd > 0:
        raise ComputationFailed("the values have no variance")
    z = (F.col("e") - F.lit(float(mid))) / F.lit(float(sd))
    # the i-th value's lower tail has weight 2i - 1, and its upper tail that of the mirrored place
    low, high = (F.log(F.greatest(special.normal_cdf_col(c), F.lit(1e-300))) for c in (F.col("z"), -F.col("z")))
    ranked = number_rows(rows, F.struct(z.alias("z"), F.monotonically_increasing_id().alias("i")), {"z": z}, unique=False).rows
    total = ranked.agg(F.sum((2 * F.col("_t") - 1) * low + (2 * (n - F.col("_t")) + 1) * high)).first()[0]
    a = -n - total / n
    return _result("Anderson-Darling", a, anderson_darling_p(a, n), "the residuals are normal", "the residuals are not normal", n=int(n))


# ---- autocorrelation


def durbin_watson(df: DataFrame, y: str, x: Sequence[str], order_by: str, columns: dict[str, Column] | None = None) -> dict:
    rows, _ = residuals(df, y, x, columns, keep=[order_by])
    e = number_rows(rows, order_by, {"e": F.col("e")}).lagged("e", 1)
    top, bottom = e.agg(F.sum(F.pow(F.col("e") - F.col("l1"), 2)), F.sum(F.col("e") * F.col("e"))).first()
    if bottom < 1e-10:
        raise ComputationFailed("the residuals are all 0")
    dw = top / bottom
    text = "positive autocorrelation" if dw < 1.5 else "negative autocorrelation" if dw > 2.5 else "no autocorrelation"
    return {"test_name": "Durbin-Watson", "statistic": float(dw), "autocorrelation": float(1 - dw / 2), "interpretation": text}


def breusch_godfrey(df: DataFrame, y: str, x: Sequence[str], order_by: str, order: int = 1, kind: str = "chisq", columns: dict[str, Column] | None = None) -> dict:
    """Residuals on predictors and their own lags, of which those before the first row are 0."""
    if order == 0:
        return _result("Breusch-Godfrey", 0.0, 1.0, "no autocorrelation", "", order=0)
    rows, fit = residuals(df, y, x, columns, keep=[order_by])
    k = len(x)
    e = number_rows(rows, order_by, names([f"c{i}" for i in range(k)] + ["e"])).lagged("e", order)
    e = e.fillna(0.0, [f"l{j}" for j in range(1, order + 1)])
    regressors = [F.col(f"c{i}") for i in range(k)] + [F.col(f"l{j}") for j in range(1, order + 1)]
    rss, tss, n = rss_of(e, F.col("e"), regressors)
    r2 = 1 - rss / tss
    if kind == "chisq":
        return _result("Breusch-Godfrey", n * r2, special.chi_squared_survival(n * r2, order), "no autocorrelation", "autocorrelation", order=order)
    d2 = n - k - 1 - order
    f = (tss - rss) / order / (rss / d2)
    return _result("Breusch-Godfrey", f, special.f_p_value(f, order, d2), "no autocorrelation", "autocorrelation", order=order, df2=d2)


# ---- collinearity and influence


def vif(df: DataFrame, x: Sequence[str], columns: dict[str, Column] | None = None) -> DataFrame:
    """A row for each predictor: vif, r_squared and the band it falls in. Needs two predictors."""
    if len(x) < 2:
        raise InvalidInput("two predictors are needed")
    own = {c: (columns or {}).get(c, number(c)) for c in x}
    values = solve.vif(moments(df, own), list(x))
    rows = [(c, float(v), 1 - 1 / v, "high" if v > 10 else "moderate" if v > 5 else "low") for c, v in zip(x, values, strict=True)]
    return df.sparkSession.createDataFrame(rows, "variable string, vif double, r_squared double, interpretation string")


def _strict(df: DataFrame, y: str, x: Sequence[str], columns: dict[str, Column] | None) -> LinearFit:
    fit = ols(df, y, x, columns)
    if fit.solution.rank < len(x) + 1:
        raise SingularMatrix("the predictors are collinear")
    return fit


def cooks_distance(df: DataFrame, y: str, x: Sequence[str], columns: dict[str, Column] | None = None) -> tuple[DataFrame, dict]:
    """The input with resid, leverage and cooks_d, and the thresholds 4/n, 4/df and 1. All 0 where the fit is exact."""
    fit = _strict(df, y, x, columns)
    p = len(x) + 1
    exact = fit.mse < 1e-20 or fit.mse < fit.tss / max(fit.n - 1, 1) * math.sqrt(2.220446049250313e-16)
    rows = fit.rows()
    h = F.col("leverage")
    d = F.lit(0.0) if exact else F.col("resid") * F.col("resid") * h / (p * fit.mse * (1 - h) * (1 - h))
    return rows.withColumn("cooks_d", d), {"test_name": "Cook's distance", "p": p, "mse": fit.mse, "threshold_4_over_n": 4 / fit.n, "threshold_4_over_df": 4 / fit.dof, "threshold_1": 1.0}


def _deleted(fit: LinearFit) -> Column:
    """Error deviation of the fit without the row."""
    return F.sqrt((F.lit(fit.rss) - F.col("resid") * F.col("resid") / (1 - F.col("leverage"))) / (fit.dof - 1))


def dffits(df: DataFrame, y: str, x: Sequence[str], columns: dict[str, Column] | None = None) -> tuple[DataFrame, dict]:
    """The input with resid, leverage and dffits, and the threshold 2 sqrt(p / n)."""
    fit = _strict(df, y, x, columns)
    h = F.col("leverage")
    rows = fit.rows().withColumn("dffits", F.col("resid") * F.sqrt(h) / (_deleted(fit) * (1 - h)))
    return rows, {"test_name": "DFFITS", "n": fit.n, "p": len(x) + 1, "threshold": 2 * math.sqrt((len(x) + 1) / fit.n)}


def dfbetas(df: DataFrame, y: str, x: Sequence[str], columns: dict[str, Column] | None = None) -> tuple[DataFrame, dict]:
    """The input with resid, leverage and an array dfbetas (the intercept first), and the threshold 2 / sqrt(n)."""
    fit = _strict(df, y, x, columns)
    design = [F.lit(1.0), *(fit.columns[c] for c in fit.x)]
    c = fit.solution.inverse
    scale = _deleted(fit) * (1 - F.col("leverage"))
    parts = []
    for j in range(len(design)):
        g = F.lit(0.0)
        for i, d in enumerate(design):
            g = g + F.lit(float(c[j, i])) * d
        parts.append(F.col("resid") * g / (scale * F.lit(math.sqrt(c[j, j]))))
    return fit.rows().withColumn("dfbetas", F.array(*parts)), {"test_name": "DFBETAS", "n": fit.n, "p": len(design), "threshold": 2 / math.sqrt(fit.n)}


def influential(rows: DataFrame, measure: Column, threshold: float, order_by: str) -> DataFrame:
    """The numbers (from 1, in order) of the rows whose measure exceeds the threshold in size, a row each."""
    own = number_rows(rows, order_by, {"m": measure}).rows
    return own.where(F.abs("m") > threshold).select(F.col("_t").alias("position"))


def influential_terms(rows: DataFrame, terms: Sequence[str], threshold: float, order_by: str) -> DataFrame:
    """term and position (from 1, in order): a row for each term and each row whose DFBETAS of it exceeds the threshold in size."""
    own = number_rows(rows, order_by, {"m": F.col("dfbetas")}).rows
    pairs = F.arrays_zip(F.array(*(F.lit(t) for t in terms)).alias("term"), F.col("m").alias("value"))
    return own.select("_t", F.inline(pairs)).where(F.abs("value") > threshold).select("term", F.col("_t").alias("position"))
