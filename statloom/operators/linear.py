"""Ordinary and weighted least squares, polynomial fits, grouped fits and prediction intervals."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.errors import InvalidInput, SingularMatrix
from statloom.functions import special
from statloom.plans import solve
from statloom.plans.moments import Moments, grouped_moments, moments, need, number, triangle, weighted_moments

INTERCEPT = "intercept"
#: With more predictors the moments' p squared aggregates would leave generated code, so R comes from QR instead.
WIDE = 40


def quadratic(columns: Sequence[Column], about: Sequence[float], matrix: np.ndarray) -> Column:
    """(x - about)' matrix (x - about) as an expression."""
    d = [c - F.lit(float(a)) for c, a in zip(columns, about, strict=True)]
    total = F.lit(0.0)
    for i in range(len(d)):
        for j in range(i, len(d)):
            total = total + F.lit(float(matrix[i, j] * (1 if i == j else 2))) * d[i] * d[j]
    return total


def linear(columns: Sequence[Column], b: Sequence[float]) -> Column:
    """b[0] + b[1] x1 + ...; a dropped (NaN) coefficient counts as 0."""
    total = F.lit(float(b[0]) if not math.isnan(b[0]) else 0.0)
    for c, v in zip(columns, b[1:], strict=True):
        if not math.isnan(v):
            total = total + F.lit(float(v)) * c
    return total


@dataclass
class LinearFit:
    """A fit by least squares. ``terms``, ``summary`` and ``rows`` are its relations."""

    df: DataFrame
    y: str
    x: list[str]
    moments: Moments
    solution: solve.Solution
    columns: dict[str, Column]
    kind: str = "OLS"
    weight: str | None = None
    extra: dict = field(default_factory=dict)

    @property
    def n(self) -> int:
        return int(self.moments.rows)

    @property
    def coefficients(self) -> list[float]:
        return [float(v) for v in self.solution.b]

    @property
    def dof(self) -> int:
        return self.n - self.solution.rank

    def fitted(self) -> Column:
        return linear([self.columns[c] for c in self.x], self.coefficients)

    def residual(self) -> Column:
        return self.columns[self.y] - self.fitted()

    @functools.cached_property
    def errors(self) -> dict[str, float]:
        """Residual sums that moments can't give: one pass over the rows."""
        e = self.residual()
        y = self.columns[self.y]
        row = self.df.agg(F.sum(e * e).alias("rss"), F.avg(F.abs(e)).alias("mae"), (F.var_pop(y) * F.count("*")).alias("tss")).first()
        return {"rss": float(row["rss"]), "mae": float(row["mae"]), "tss": float(row["tss"])}

    @functools.cached_property
    def rss(self) -> float:
        return self.solution.rss if self.solution.exact_rss and self.weight is None else self.errors["rss"]

    @property
    def tss(self) -> float:
        return self.solution.tss if self.weight is None else self.errors["tss"]

    @property
    def mse(self) -> float:
        return self.rss / self.dof

    @property
    def r_squared(self) -> float:
        return 1 - self.rss / self.tss if self.tss > 0 else math.nan

    def leverage(self) -> Column:
        kept = [i for i in self.solution.kept if i]
        inner = self.solution.inverse[1:, 1:]
        names = [self.x[i - 1] for i in kept]
        means = self.moments.pick(names).mean
        return F.lit(1.0 / self.n) + quadratic([self.columns[c] for c in names], means, inner)

    def inference(self) -> list[dict]:
        """One dictionary for each term; a dropped term has NaN throughout."""
        out = []
        at = {i: k for k, i in enumerate(self.solution.kept)}
        critical = special.t_critical_quantile(self.dof, 0.05)
        for i, name in enumerate([INTERCEPT, *self.x]):
            b = self.coefficients[i]
            if i not in at:
                out.append({"term": name, "coefficient": math.nan, "std_error": math.nan, "t_stat": math.nan, "p_value": math.nan, "conf_low": math.nan, "conf_high": math.nan})
                continue
            se = math.sqrt(self.mse * self.solution.inverse[at[i], at[i]])
            t = b / se if se > 0 else math.inf if b else math.nan
            out.append({"term": name, "coefficient": b, "std_error": se, "t_stat": t, "p_value": special.two_tailed_p_value(t, self.dof), "conf_low": b - critical * se, "conf_high": b + critical * se})
        return out

    def terms(self) -> DataFrame:
        spark = self.df.sparkSession
        return spark.createDataFrame([tuple(r.values()) for r in self.inference()], "term string, coefficient double, std_error double, t_stat double, p_value double, conf_low double, conf_high double")

    def statistics(self) -> dict[str, float]:
        n, rank = self.n, self.solution.rank
        r2 = self.r_squared
        k = rank - 1
        f = (self.tss - self.rss) / k / self.mse if k and self.mse > 0 else math.nan
        ll = solve.log_likelihood(n, self.rss)
        return {
            "n": n, "k": len(self.x), "df": self.dof, "r_squared": r2, "adj_r_squared": 1 - (1 - r2) * (n - 1) / self.dof, "f_statistic": f, "f_p_value": special.f_p_value(f, k, self.dof) if k else math.nan,
            "mse": self.mse, "std_error": math.sqrt(self.mse), "rmse": math.sqrt(self.mse), "mae": self.errors["mae"], "log_likelihood": ll, "aic": solve.aic(ll, rank), "bic": solve.bic(ll, rank, n),
            "aic_plain": solve.aic(ll, rank, False), "bic_plain": solve.bic(ll, rank, n, False),
        }

    def summary(self) -> DataFrame:
        s = self.statistics()
        return self.df.sparkSession.createDataFrame([tuple(float(v) for v in s.values())], ", ".join(f"{k} double" for k in s))

    def vif(self) -> DataFrame:
        values = solve.vif(self.moments, self.x)
        return self.df.sparkSession.createDataFrame([(c, v, 1 - 1 / v) for c, v in zip(self.x, values, strict=bool(values))], "variable string, vif double, r_squared double")

    def rows(self) -> DataFrame:
        """The input with yhat, resid, leverage and std_resid."""
        out = self.df.withColumn("yhat", self.fitted()).withColumn("resid", self.columns[self.y] - F.col("yhat")).withColumn("leverage", self.leverage())
        scale = F.sqrt(F.lit(self.mse) * F.greatest(1 - F.col("leverage"), F.lit(1e-10)))
        return out.withColumn("std_resid", F.when(scale > 1e-10, F.col("resid") / scale).otherwise(0.0))

    def predict(self, new: DataFrame, columns: dict[str, Column] | None = None) -> DataFrame:
        return new.withColumn("yhat", linear([(columns or {}).get(c, number(c)) for c in self.x], self.coefficients))

    def intervals(self, new: DataFrame, alpha: float = 0.05, columns: dict[str, Column] | None = None) -> DataFrame:
        """``new`` with predicted, lower_bound, upper_bound, se_pred and leverage."""
        if not 0 < alpha < 1:
            raise InvalidInput("alpha must be between 0 and 1")
        if self.solution.rank < len(self.x) + 1:
            raise SingularMatrix("the predictors are collinear")
        own = [(columns or {}).get(c, number(c)) for c in self.x]
        h = F.lit(1.0 / self.n) + quadratic(own, self.moments.pick(self.x).mean, self.solution.inverse[1:, 1:])
        return interval_columns(new, linear(own, self.coefficients), h, self.mse, self.dof, alpha)


def interval_columns(new: DataFrame, predicted: Column, leverage: Column, mse: float, dof: float, alpha: float) -> DataFrame:
    if dof <= 0:
        raise InvalidInput("no degrees of freedom are left")
    t = special.t_critical_quantile(dof, alpha)
    out = new.withColumn("predicted", predicted).withColumn("leverage", leverage).withColumn("se_pred", F.sqrt(F.lit(mse) * (1 + F.col("leverage"))))
    return out.withColumn("lower_bound", F.col("predicted") - t * F.col("se_pred")).withColumn("upper_bound", F.col("predicted") + t * F.col("se_pred"))


def ols(df: DataFrame, y: str, x: Sequence[str], columns: dict[str, Column] | None = None) -> LinearFit:
    """Least squares of y on an intercept and x. ``columns`` may give expressions for names that are no columns.

    One aggregation; where it cannot tell the rank, or for many predictors, one tree of QR factorisations. A column that
    earlier ones determine gets NaN. Null, NaN and infinite values are an error.
    """
    x = list(x)
    own = {c: (columns or {}).get(c, number(c)) for c in [*x, y]}
    m = wide_moments(df, own) if len(x) > WIDE else moments(df, own)
    need(m.n, len(x) + 2)
    kept = None
    if x and solve.near_singular(m, x):
        r = triangle(df, {"1": F.lit(1.0)} | {c: own[c] for c in x})
        kept = solve.kept_columns(r)
    return LinearFit(df, y, x, m, solve.intercept_solution(m, x, y, kept), own)


def wide_moments(df: DataFrame, columns: dict[str, Column]) -> Moments:
    """The same moments from R of [1, columns]: its first row has the means, the rest the centred factor."""
    bad = df.agg(F.count("*").alias("n"), *(F.count_if(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias(f"b{i}") for i, c in enumerate(columns.values()))).first()
    if sum(bad[1:]):
        raise InvalidInput("a value is null, NaN or infinite")
    need(bad["n"], len(columns) + 1)
    r = triangle(df, {"1": F.lit(1.0)} | columns)
    means, centred = r[0, 1:] / r[0, 0], r[1:, 1:]
    return Moments(list(columns), float(bad["n"]), means, centred.T @ centred, bad["n"])


def wls(df: DataFrame, y: str, x: Sequence[str], weight: str, columns: dict[str, Column] | None = None, rss: str = "unweighted") -> LinearFit:
    """Weighted least squares. Residual sums, R squared and F are of unweighted residuals as in the engine this one answers for; ``rss="weighted"`` takes weighted ones.

    Collinear predictors get the solution of least norm (of unit-length terms); residual sums are unweighted then, and every term counts in the degrees of freedom.
    """
    x = list(x)
    own = {c: (columns or {}).get(c, number(c)) for c in [*x, y]}
    w = (columns or {}).get(weight, number(weight))
    m = weighted_moments(df, own, w)
    need(m.rows, len(x) + 2)
    if solve.near_singular(m, x):
        return LinearFit(df, y, x, m, solve.least_norm(m, x, y), own, "WLS", weight)
    s = solve.intercept_solution(m, x, y)
    s.inverse[0, 0] = 1 / m.n + m.pick(x).mean @ s.inverse[1:, 1:] @ m.pick(x).mean
    fit = LinearFit(df, y, x, m, s, own, "WLS", weight if rss == "unweighted" else None)
    if rss == "weighted":
        fit.extra["weight"] = weight
    return fit


# ---- polynomials


@dataclass
class PolynomialFit:
    fit: LinearFit
    degree: int
    centre: float
    means: list[float]
    stds: list[float]
    standardized: bool

    def predict(self, new: DataFrame, x: str) -> DataFrame:
        """Powers about the training mean, standardised as in training."""
        own = features(number(x), self.degree, self.centre, list(zip(self.means, self.stds, strict=True)) if self.standardized else None)
        return new.withColumn("yhat", linear(own, self.fit.coefficients))


def feature_names(degree: int, centered: bool = False) -> list[str]:
    base = "x_centered" if centered else "x"
    return [base if d == 1 else f"{base}^{d}" for d in range(1, degree + 1)]


def features(x: Column, degree: int, centre: float = 0.0, scale: list[tuple[float, float]] | None = None) -> list[Column]:
    """x, x squared and so on, about the centre, by repeated products."""
    base = x - F.lit(float(centre)) if centre else x
    out = [base]
    for _ in range(degree - 1):
        out.append(out[-1] * base)
    return out if scale is None else [(c - F.lit(m)) / F.lit(s) for c, (m, s) in zip(out, scale, strict=True)]


def polynomial(df: DataFrame, y: str, x: str, degree: int = 2, center: bool = False, standardize: bool = False) -> PolynomialFit:
    if degree < 1:
        raise InvalidInput("the degree must be 1 or more")
    centre = float(df.agg(F.avg(number(x))).first()[0] or 0.0) if center else 0.0
    names = feature_names(degree, center)
    plain = features(number(x), degree, centre)
    row = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(plain)), *(F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(plain))).first()
    means, stds = [float(row[f"m{i}"] or 0.0) for i in range(degree)], [float(row[f"s{i}"] or 0.0) or 1.0 for i in range(degree)]
    own = features(number(x), degree, centre, list(zip(means, stds, strict=True)) if standardize else None)
    return PolynomialFit(ols(df, y, names, dict(zip(names, own, strict=True))), degree, centre, means, stds, standardize)


# ---- grouped fits


def grouped_ols(df: DataFrame, by: Sequence[str], y: str, x: Sequence[str], columns: dict[str, Column] | None = None) -> DataFrame:
    """A row for each group and term: coefficient, std_error and the group's r_squared and n. One aggregation; the solves run on its rows, in parallel. Groups too small or collinear have NaN."""
    x = list(x)
    own = {c: (columns or {}).get(c, number(c)) for c in [*x, y]}
    grouped = grouped_moments(df, by, own)
    names = [*x, y]

    def fits(frames):
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                k, n = len(names), row["n"]
                m = Moments(names, float(n), np.array([row[f"m{i}"] for i in range(k)]), np.zeros((k, k)), int(n))
                for i in range(k):
                    for j in range(i, k):
                        m.s[i, j] = m.s[j, i] = row[f"s{i}_{j}"] * n
                keys = [row[c] for c in by]
                if n < len(x) + 2 or row["bad"] or solve.near_singular(m, x):
                    out += [(*keys, t, math.nan, math.nan, math.nan, n) for t in (INTERCEPT, *x)]
                    continue
                s = solve.intercept_solution(m, x, y)
                mse = s.rss / (n - len(x) - 1)
                r2 = 1 - s.rss / s.tss if s.tss > 0 else math.nan
                out += [(*keys, t, s.b[i], math.sqrt(mse * s.inverse[i, i]), r2, n) for i, t in enumerate((INTERCEPT, *x))]
            yield pd.DataFrame(out, columns=[*by, "term", "coefficient", "std_error", "r_squared", "n"])

    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grouped.select(*by).schema)
    return grouped.mapInPandas(fits, f"{keys}, term string, coefficient double, std_error double, r_squared double, n long")


def to_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame(rows))
