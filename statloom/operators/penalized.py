"""Ridge, lasso and elastic net, single fits and paths, from one aggregation of moments.

Scaling follows glmnet: predictors are centred and brought to unit norm, the response to unit norm; so the solver sees the
correlation matrix, correlations with the response, and lambda over the response's population deviation. Coordinate descent with
covariance updates takes the same steps as one over the rows. A predictor without variance gets 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.errors import InvalidInput
from statloom.operators.linear import INTERCEPT, interval_columns, linear, ols, polynomial, quadratic
from statloom.plans import solve
from statloom.plans.moments import Moments, moments, number, weighted_moments


def soft_threshold(z: float, gamma: float) -> float:
    if gamma < 0:
        raise InvalidInput("gamma must not be negative")
    return z - gamma if z > gamma else z + gamma if z < -gamma else 0.0


def soft_threshold_col(z: Column, gamma: float) -> Column:
    if gamma < 0:
        raise InvalidInput("gamma must not be negative")
    return F.when(z > gamma, z - gamma).when(z < -gamma, z + gamma).otherwise(0.0)


@dataclass
class Scaled:
    """Unit-scale problem: q = X'X, c = X'y, and how to undo it."""

    q: np.ndarray
    c: np.ndarray
    x_scale: np.ndarray
    y_scale: float
    x_mean: np.ndarray
    y_mean: float
    n: float
    tss: float


def scale(m: Moments, x: Sequence[str], y: str, standardize: bool = True, intercept: bool = True) -> Scaled:
    """Without an intercept nothing is centred, predictors are still scaled by their deviation, and the response by its root mean square."""
    p = m.pick([*x, y])
    k = len(x)
    cov = p.s / m.n
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    x_scale = np.where(sd[:k] > 0, sd[:k], 1.0) if standardize else np.ones(k)
    if not intercept:
        cov = cov + np.outer(p.mean, p.mean)
    y_scale = math.sqrt(max(float(cov[k, k]), 0.0)) or 1.0
    means = (p.mean[:k], float(p.mean[k])) if intercept else (np.zeros(k), 0.0)
    return Scaled(cov[:k, :k] / np.outer(x_scale, x_scale), cov[:k, k] / (x_scale * y_scale), x_scale, y_scale, *means, m.n, float(p.s[k, k]))


def coordinate_descent(q: np.ndarray, c: np.ndarray, lam: float, alpha: float, factor: np.ndarray | None = None, low: np.ndarray | None = None, high: np.ndarray | None = None, start: np.ndarray | None = None, max_iter: int = 100_000, tol: float = 1e-9) -> tuple[np.ndarray, int, bool]:
    """Cyclic descent over all coordinates, then over the active ones until they are still."""
    k = len(c)
    b = np.zeros(k) if start is None else start.copy()
    factor = np.ones(k) if factor is None else factor
    low, high = (np.full(k, -np.inf) if low is None else low), (np.full(k, np.inf) if high is None else high)
    usable = np.flatnonzero((np.diag(q) > 0) & np.isfinite(factor))
    b[np.setdiff1d(np.arange(k), usable)] = 0.0
    if math.isinf(lam):
        return np.where(factor == 0, b, 0.0), 0, True
    gradient = c - q @ b
    done = 0

    def sweep(over) -> float:
        nonlocal gradient
        most = 0.0
        for j in over:
            rho = gradient[j] + q[j, j] * b[j]
            v = soft_threshold(rho, lam * alpha * factor[j]) / (q[j, j] + lam * (1 - alpha) * factor[j])
            v = min(max(v, low[j]), high[j])
            if (d := v - b[j]) != 0:
                gradient = gradient - q[:, j] * d
                b[j] = v
                most = max(most, abs(d))
        return most

    while done < max_iter:
        done += 1
        if sweep(usable) < tol:
            return b, done, True
        active = [j for j in usable if b[j] != 0]
        while done < max_iter:
            done += 1
            if sweep(active) < tol:
                break
    return b, done, False


@dataclass
class PenalizedFit:
    df: DataFrame
    y: str
    x: list[str]
    columns: dict[str, Column]
    lam: float
    alpha: float
    intercept: float
    slopes: np.ndarray
    n: int
    tss: float
    rss: float
    mae: float
    iterations: int
    converged: bool
    moments: Moments
    kind: str

    @property
    def coefficients(self) -> list[float]:
        return [self.intercept, *map(float, self.slopes)]

    @property
    def nonzero(self) -> int:
        return int((self.slopes != 0).sum())

    def statistics(self) -> dict[str, float]:
        n, used = self.n, 1 + (len(self.x) if self.kind == "Ridge" else self.nonzero)
        mse = self.rss / max(n - used, 1)
        r2 = 1 - self.rss / self.tss if self.tss > 1e-10 else 1.0
        ll = solve.log_likelihood(n, self.rss)
        terms = len(self.x) + 1
        out = {"lambda": self.lam, "alpha": self.alpha, "n_nonzero": self.nonzero, "r_squared": r2, "adj_r_squared": 1 - (1 - r2) * (n - 1) / max(n - used, 1), "mse": mse, "rmse": math.sqrt(mse), "mae": self.mae, "log_likelihood": ll, "aic": solve.aic(ll, terms), "bic": solve.bic(ll, terms, n)}
        if self.kind == "Ridge":
            out |= {"df": (len(self.x) + 1) / (1 + self.lam)}
        return out

    def summary(self) -> DataFrame:
        s = self.statistics()
        return self.df.sparkSession.createDataFrame([tuple(float(v) for v in s.values())], ", ".join(f"`{k}` double" for k in s))

    def terms(self) -> DataFrame:
        return self.df.sparkSession.createDataFrame(list(zip([INTERCEPT, *self.x], self.coefficients, strict=True)), "term string, coefficient double")

    def fitted(self) -> Column:
        return linear([self.columns[c] for c in self.x], self.coefficients)

    def rows(self) -> DataFrame:
        return self.df.withColumn("yhat", self.fitted()).withColumn("resid", self.columns[self.y] - F.col("yhat"))

    def predict(self, new: DataFrame, columns: dict[str, Column] | None = None) -> DataFrame:
        return new.withColumn("yhat", linear([(columns or {}).get(c, number(c)) for c in self.x], self.coefficients))

    def intervals(self, new: DataFrame, alpha: float = 0.05, columns: dict[str, Column] | None = None) -> DataFrame:
        """Leverage of least squares, error variance of this fit; degrees of freedom n - 1 - df for ridge, else n - 1 - the number of slopes that are not 0."""
        dof = self.n - 1 - (self.statistics()["df"] if self.kind == "Ridge" else self.nonzero)
        if dof <= 0:
            raise InvalidInput("no degrees of freedom are left")
        plain = ols(self.df, self.y, self.x, self.columns)
        own = [(columns or {}).get(c, number(c)) for c in self.x]
        h = F.lit(1.0 / plain.n) + quadratic(own, plain.moments.pick(self.x).mean, plain.solution.inverse[1:, 1:])
        return interval_columns(new, linear(own, self.coefficients), h, self.rss / dof, dof, alpha)


def _finish(df: DataFrame, y: str, x: list[str], own: dict[str, Column], m: Moments, s: Scaled, b: np.ndarray, lam: float, alpha: float, iterations: int, converged: bool, kind: str, rows: bool = True) -> PenalizedFit:
    slopes = b * s.y_scale / s.x_scale
    intercept = s.y_mean - float(slopes @ s.x_mean)
    rss = s.tss * (1 - 2 * b @ s.c + b @ s.q @ b)
    mae = math.nan
    if rows:  # moments can't give absolute errors
        e = own[y] - linear([own[c] for c in x], [intercept, *map(float, slopes)])
        mae, exact = df.agg(F.avg(F.abs(e)), F.sum(e * e)).first()
        rss = float(exact)
    return PenalizedFit(df, y, x, own, lam, alpha, intercept, slopes, int(m.rows), s.tss, float(rss), float(mae), iterations, converged, m, kind)


def elastic_net(df: DataFrame, y: str, x: Sequence[str], lam: float = 1.0, alpha: float = 1.0, standardize: bool = True, penalty_factor: dict[str, float] | None = None, bounds: dict[str, tuple[float, float]] | None = None, columns: dict[str, Column] | None = None, max_iter: int = 100_000, tol: float = 1e-9, kind: str = "ElasticNet", m: Moments | None = None, weight: str | None = None, intercept: bool = True) -> PenalizedFit:
    """Minimises RSS / 2n + lambda (alpha L1 + (1 - alpha) L2 / 2) in glmnet's scaling. Penalty factors and bounds go by predictor name; weights count relative to their sum."""
    if lam < 0 or not 0 <= alpha <= 1:
        raise InvalidInput("lambda must not be negative and alpha must be from 0 to 1")
    x = list(x)
    own = {c: (columns or {}).get(c, number(c)) for c in [*x, y]}
    if m is None:
        m = moments(df, own) if weight is None else weighted_moments(df, own, (columns or {}).get(weight, number(weight)))
    s = scale(m, x, y, standardize, intercept)
    factor = np.array([(penalty_factor or {}).get(c, 1.0) for c in x])
    low = np.array([(bounds or {}).get(c, (-np.inf, np.inf))[0] for c in x]) * s.x_scale / s.y_scale
    high = np.array([(bounds or {}).get(c, (-np.inf, np.inf))[1] for c in x]) * s.x_scale / s.y_scale
    if (low > high).any():
        raise InvalidInput("a lower bound exceeds its upper bound")
    b, iterations, converged = coordinate_descent(s.q, s.c, lam / s.y_scale, alpha, factor, low, high, None, max_iter, tol)
    return _finish(df, y, x, own, m, s, b, lam, alpha, iterations, converged, kind)


def lasso(df: DataFrame, y: str, x: Sequence[str], lam: float = 1.0, **options) -> PenalizedFit:
    return elastic_net(df, y, x, lam, 1.0, kind="Lasso", **options)


def ridge(df: DataFrame, y: str, x: Sequence[str], lam: float = 1.0, standardize: bool = True, columns: dict[str, Column] | None = None, m: Moments | None = None) -> PenalizedFit:
    """The closed form of the same problem at alpha 0."""
    if lam < 0:
        raise InvalidInput("lambda must not be negative")
    x = list(x)
    own = {c: (columns or {}).get(c, number(c)) for c in [*x, y]}
    m = moments(df, own) if m is None else m
    s = scale(m, x, y, standardize)
    usable = np.diag(s.q) > 0
    b = np.zeros(len(x))
    q = s.q[np.ix_(usable, usable)] + lam / s.y_scale * np.eye(int(usable.sum()))
    b[usable] = np.linalg.lstsq(q, s.c[usable], rcond=None)[0]
    return _finish(df, y, x, own, m, s, b, lam, 0.0, 1, True, "Ridge")


def lambda_max(c: np.ndarray, alpha: float, factor: np.ndarray | None = None) -> float:
    factor = np.ones(len(c)) if factor is None else factor
    return max((float(abs(v) / f) for v, f in zip(c, factor, strict=True) if f > 0), default=0.0) / max(alpha, 1e-3)


def lambda_path(top: float, n: int, p: int, count: int = 100, ratio: float | None = None) -> list[float]:
    """Infinity first, then a geometric descent from just below the maximum."""
    ratio = ratio if ratio is not None else 1e-4 if n >= p else 1e-2
    step = max(ratio, 1e-6) ** (1 / max(count - 1, 1))
    return [math.inf, *(top * step**i for i in range(1, count))][:count]


def make_lambda_path(df: DataFrame, y: str, x: Sequence[str], count: int = 100, ratio: float | None = None, alpha: float = 1.0, columns: dict[str, Column] | None = None) -> list[float]:
    """The path of the binding: predictors by their n - 1 deviation, the response only centred, sums not means."""
    x = list(x)
    own = {c: (columns or {}).get(c, number(c)) for c in [*x, y]}
    m = moments(df, own)
    p = m.pick([*x, y])
    k = len(x)
    sd = np.sqrt(np.diag(p.s)[:k] / max(m.n - 1, 1))
    c = np.where(sd > 0, p.s[:k, k] / np.where(sd > 0, sd, 1), 0.0)
    return lambda_path(lambda_max(c, alpha), int(m.n), k + 1, count, ratio)


def elastic_net_path(df: DataFrame, y: str, x: Sequence[str], alpha: float = 1.0, lambdas: Sequence[float] | None = None, count: int = 100, ratio: float | None = None, standardize: bool = True, columns: dict[str, Column] | None = None) -> DataFrame:
    """A row for each lambda and term: step, lambda, term, coefficient, n_nonzero, r_squared. One aggregation; each fit starts from the one before."""
    x = list(x)
    own = {c: (columns or {}).get(c, number(c)) for c in [*x, y]}
    m = moments(df, own)
    s = scale(m, x, y, standardize)
    if lambdas is None:
        lambdas = [v * s.y_scale for v in lambda_path(lambda_max(s.c, alpha), int(m.n), len(x) + 1, count, ratio)]
    start, rows = None, []
    for i, lam in enumerate(lambdas):
        start, iterations, ok = coordinate_descent(s.q, s.c, lam / s.y_scale, alpha, start=start)
        f = _finish(df, y, x, own, m, s, start, lam, alpha, iterations, ok, "ElasticNet", rows=False)
        r2 = 1 - f.rss / f.tss if f.tss > 1e-10 else 1.0
        rows += [(i, float(lam), t, float(v), f.nonzero, float(r2)) for t, v in zip([INTERCEPT, *x], f.coefficients, strict=True)]
    return df.sparkSession.createDataFrame(rows, "step int, lambda double, term string, coefficient double, n_nonzero int, r_squared double")


def polynomial_penalized(df: DataFrame, y: str, x: str, degree: int, lam: float, alpha: float, center: bool = False, standardize: bool = False) -> PenalizedFit:
    """Ridge (alpha 0), lasso (1) or elastic net on the powers of x."""
    base = polynomial(df, y, x, degree, center, standardize)
    own = base.fit.columns
    return ridge(df, y, base.fit.x, lam, columns=own) if alpha == 0 else elastic_net(df, y, base.fit.x, lam, alpha, columns=own)
