"""Feature importance: standardised coefficients, linear SHAP values, permutation importance and the VIF ranking."""

from __future__ import annotations

import math
from array import array
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statloom.errors import InsufficientData, InvalidInput
from statloom.functions.special import normal_inverse_cdf
from statloom.operators.linear import LinearFit, PolynomialFit
from statloom.operators.loess import LoessFit, fit_points, neighborhood_size, normalize
from statloom.operators.penalized import PenalizedFit
from statloom.plans import solve
from statloom.plans.moments import Moments, moments, number
from statloom.plans.ordered import Ordered, generated, number_rows


def standardized_coefficients(df: DataFrame, coefficients: Sequence[float], x: Sequence[str], y_std: float = 1.0, columns: dict[str, Column] | None = None) -> DataFrame:
    """variable, coefficient, standardized and rank (by size). ``coefficients`` may begin with an intercept. Without ``y_std`` the response's deviation counts as 1."""
    if not y_std > 0:
        raise InvalidInput("the response's deviation must be above 0")
    slopes = list(coefficients)[len(coefficients) - len(x) :]
    own = [(columns or {}).get(c, number(c)) for c in x]
    sd = df.agg(*(F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"s{i}") for i, c in enumerate(own)))
    rows = F.array(*(F.struct(F.lit(c).alias("variable"), F.lit(float(b)).alias("coefficient"), (F.lit(float(b)) * F.col(f"s{i}") / y_std).alias("standardized")) for i, (c, b) in enumerate(zip(x, slopes, strict=True))))
    return sd.select(F.inline(rows)).withColumn("rank", F.row_number().over(Window.orderBy(F.abs("standardized").desc(), "variable")))


def _named(fit: LinearFit | PenalizedFit) -> list[tuple[str, float, Column]]:
    return [(c, 0.0 if math.isnan(b) else b, fit.columns[c]) for c, b in zip(fit.x, fit.coefficients[1:], strict=True)]


def shap_values(fit: LinearFit | PenalizedFit, df: DataFrame | None = None) -> DataFrame:
    """The rows with ``shap_<variable>`` columns: coefficient times distance from the training mean. ``base_value`` is the intercept and ``expected_value`` the mean prediction, to which the values add up."""
    df = fit.df if df is None else df
    means = fit.moments.pick(fit.x).mean
    intercept = fit.coefficients[0]
    expected = intercept + sum(b * m for (_, b, _), m in zip(_named(fit), means, strict=True))
    values = [(F.lit(b) * (c - F.lit(float(m)))).alias(f"shap_{name}") for (name, b, c), m in zip(_named(fit), means, strict=True)]
    return df.select("*", *values, F.lit(float(intercept)).alias("base_value"), F.lit(float(expected)).alias("expected_value"))


def mean_abs_shap(fit: LinearFit | PenalizedFit) -> DataFrame:
    """variable, mean_abs_shap and rank.

    A distance from the mean is cut at a power of two into a part whose sums are exact and a small rest, so the mean does not depend on the rows' order or partitions beyond its last digits.
    No sum of the distances is above the root of n times that of their squares, from which the cut follows.
    """
    m = fit.moments.pick(fit.x)
    sums = []
    for i, ((_, _, c), mean) in enumerate(zip(_named(fit), m.mean, strict=True)):
        most = math.sqrt(m.rows * m.s[i, i])
        away, cut = F.abs(c - F.lit(float(mean))), math.ldexp(1.0, max(math.frexp(most)[1] - 51, -1000)) if 0 < most < math.inf else 1.0
        head = F.rint(away / F.lit(cut)) * F.lit(cut)
        sums += [F.sum(head).alias(f"h{i}"), F.sum(away - head).alias(f"l{i}")]
    s = fit.df.agg(F.count("*").alias("n"), *sums)
    rows = F.array(*(F.struct(F.lit(name).alias("variable"), ((F.col(f"h{i}") + F.col(f"l{i}")) / F.col("n") * F.lit(abs(b))).alias("mean_abs_shap")) for i, (name, b, _) in enumerate(_named(fit))))
    return s.select(F.inline(rows)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_abs_shap"), "variable")))


def shap_polynomial(fit: PolynomialFit) -> DataFrame:
    return shap_values(fit.fit)


class Lcg:
    """64-bit linear congruential generator; the top 53 bits make a double."""

    def __init__(self, seed: int):
        self.state = (seed + 1) & 0xFFFFFFFFFFFFFFFF

    def next(self) -> float:
        self.state = (self.state * 1664525 + 1013904223) & 0xFFFFFFFFFFFFFFFF
        return (self.state >> 11) / (1 << 53)

    def skip(self, draws: int) -> Lcg:
        """As after so many numbers."""
        a, c = 1664525, 1013904223
        while draws:
            if draws & 1:
                self.state = (self.state * a + c) & 0xFFFFFFFFFFFFFFFF
            a, c, draws = a * a & 0xFFFFFFFFFFFFFFFF, c * (a + 1) & 0xFFFFFFFFFFFFFFFF, draws >> 1
        return self

    def shuffle(self, n: int) -> array:
        out = array("q", range(n))
        for i in range(n - 1, 0, -1):
            j = int(self.next() * (i + 1))
            out[i], out[j] = out[j], out[i]
        return out


#: Rows up to which the driver shuffles.
FEW = 5000
#: Bytes of rows up to which they are broadcast to the orders; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def _shuffled_products(table: np.ndarray, permutations: int, rng: Lcg) -> list[np.ndarray]:
    """For each predictor and permutation, the central products of the shuffled column with all columns; one stream of numbers over all predictors."""
    d = table - table.mean(axis=0)
    return [np.stack([d[rng.shuffle(len(d)), j] @ d for _ in range(permutations)]) for j in range(d.shape[1] - 1)]


def _drawn_products(numbered: Ordered, names: list[str], permutations: int, seed: int) -> list[np.ndarray]:
    """The same products of the same shuffles, of however many rows: each order is made in a task, from the stream's state at its start, and joined with the rows on either number."""
    rows, n, k = numbered.rows, numbered.n, len(names) - 1
    orders = generated(numbered.spark, n, k * permutations, lambda r: Lcg(seed).skip(r * (n - 1)).shuffle(n))
    own = rows.select(F.col("_t").alias("_from"), F.array(*(F.col(v).cast("double") for v in names[:-1])).alias("_own"))
    put = F.broadcast if 8 * n * (k + 2) <= BROADCAST_BYTES else lambda df: df.hint("merge")
    moved = orders.join(put(own), "_from").select("_r", "_t", F.get("_own", F.floor(F.col("_r") / permutations).cast("int")).alias("_moved"))
    sums = moved.join(put(rows.select("_t", *names)), "_t").groupBy("_r").agg(*(F.covar_pop("_moved", w).alias(w) for w in names)).collect()  # a row for each permutation
    by = {s["_r"]: [s[w] * n for w in names] for s in sums}
    return [np.array([by[j * permutations + r] for r in range(permutations)]) for j in range(k)]


def _moved_products(numbered: Ordered, names: list[str], permutations: int, rng: Lcg) -> list[np.ndarray]:
    """The same where row t gets the values of row a t + b modulo n, a random a without common factors with n: one join on the number for all permutations, and one aggregate."""
    rows, n = numbered.rows, numbered.n
    maps = []
    for r in range(permutations):
        while math.gcd(a := 1 + int(rng.next() * (n - 1)), n) > 1:
            pass
        maps.append((r, a, int(rng.next() * n)))
    table = numbered.spark.createDataFrame(maps, "r int, a long, b long")
    moved = rows.select("_t", *(F.col(v).alias(f"_{v}") for v in names[:-1])).join(F.broadcast(table))
    kind = "long" if n < 1 << 31 else "decimal(38,0)"  # products of longs would overflow
    moved = moved.withColumn("_t", (((F.col("_t") - 1).cast(kind) * F.col("a").cast(kind) + F.col("b").cast(kind)) % F.lit(n).cast(kind) + 1).cast("long")).drop("a", "b")
    sums = rows.join(moved, "_t").groupBy("r").agg(*(F.covar_pop(f"_{v}", w).alias(f"{v}_{w}") for v in names[:-1] for w in names)).collect()
    by = {s["r"]: s for s in sums}
    return [np.array([[by[r][f"{v}_{w}"] * n for w in names] for r in range(permutations)]) for v in names[:-1]]


def permutation_importance(fit: LinearFit | PenalizedFit, order_by: str, permutations: int = 50, seed: int = 42, refit: bool | None = None, alpha: float = 0.05, sequential: int | None = None) -> DataFrame:
    """variable, importance (mean loss of R squared), std_error, the normal interval and rank (by importance).

    A permuted column changes only its products with the others, so each permutation needs sums alone. The sequential generator shuffles, few rows on the driver and more in a task for each permutation;
    with ``sequential``, only up to so many rows, and more are moved by random affine maps of their number, which no task holds, all permutations in one join. Least squares is refitted, penalised fits predict.
    """
    refit = isinstance(fit, LinearFit) if refit is None else refit
    x, k = fit.x, len(fit.x)
    names = [f"v{i}" for i in range(k + 1)]
    numbered = number_rows(fit.df, order_by, {n: fit.columns[c] for c, n in zip([*x, fit.y], names, strict=True)})
    rng = Lcg(seed)
    if sequential is not None and numbered.n > sequential:
        products = _moved_products(numbered, names, permutations, rng)
    elif numbered.n <= FEW:
        products = _shuffled_products(np.array([list(r)[1:] for r in numbered.rows.select("_t", *names).orderBy("_t").collect()], float), permutations, rng)
    else:
        products = _drawn_products(numbered, names, permutations, seed)
    p = fit.moments.pick([*x, fit.y])
    base = Moments(names, float(numbered.n), p.mean, p.s, numbered.n)
    coefficients = np.array([0.0 if math.isnan(b) else b for b in fit.coefficients[1:]])
    baseline = 1 - fit.rss / fit.tss
    z = normal_inverse_cdf(1 - alpha / 2)
    out = []
    for j, name in enumerate(x):
        losses = []
        for product in products[j]:
            m = base.pick(names)
            m.s = m.s.copy()
            own = np.arange(k + 1) != j
            m.s[own, j] = m.s[j, own] = product[own]
            if refit:
                if solve.near_singular(m, names[:k]):
                    losses.append(0.0)  # a fit that fails loses nothing but counts
                    continue
                s = solve.intercept_solution(m, names[:k], names[k])
                r2 = 1 - s.rss / s.tss
            else:
                rss = m.s[k, k] - 2 * coefficients @ m.s[:k, k] + coefficients @ m.s[:k, :k] @ coefficients
                r2 = 1 - rss / m.s[k, k]
            losses.append(baseline - float(r2))
        mean = float(np.mean(losses))
        se = float(np.std(losses, ddof=1) / math.sqrt(len(losses))) if len(losses) > 1 else 0.0
        out.append((name, mean, se, mean - z * se, mean + z * se))
    ranks = {r[0]: i + 1 for i, r in enumerate(sorted(out, key=lambda r: (-r[1], r[0])))}
    return fit.df.sparkSession.createDataFrame([(*r, ranks[r[0]]) for r in out], "variable string, importance double, std_error double, low double, high double, rank int")


def observation_contribution(fit: LinearFit | PenalizedFit, order_by: str, key) -> DataFrame:
    """variable and shap of the row whose ``order_by`` equals the key; no row if there is none."""
    one = shap_values(fit, fit.df.where(F.col(order_by) == F.lit(key)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(f"`shap_{c}`").alias("shap")) for c in fit.x))))


def permutation_importance_loess(spark: SparkSession, fit: LoessFit, names: Sequence[str], permutations: int = 50, seed: int = 42) -> DataFrame:
    """variable, importance and std_error of a local fit, refitted for each permutation of the sequential generator; a fit that fails loses all of R squared. The permutations are spread over the tasks, each with the bounded training points."""
    x, y, span, degree = fit.train_x, fit.train_y, fit.span, fit.degree
    k = neighborhood_size(span, len(y), degree)
    tss = float(((y - y.mean()) ** 2).sum())
    baseline = 1 - float(((y - fit.fitted) ** 2).sum()) / tss

    rng = Lcg(seed)
    orders = [[np.array(rng.shuffle(len(y))) for _ in range(permutations)] for _ in range(x.shape[1])]

    def losses(frames):
        for frame in frames:
            out = []
            for j, r in zip(frame["j"], frame["r"], strict=True):
                own = x.copy()
                own[:, j] = own[orders[j][r], j]
                own = own if own.shape[1] == 1 else normalize(own)[0]
                try:
                    loss = baseline - (1 - float(((y - fit_points(own, own, y, k, degree)) ** 2).sum()) / tss)
                except (InsufficientData, np.linalg.LinAlgError):
                    loss = baseline
                out.append(loss)
            yield frame.assign(loss=out)

    tasks = spark.createDataFrame([(j, r) for j in range(x.shape[1]) for r in range(permutations)], "j int, r int").repartition(min(64, x.shape[1] * permutations))
    found = tasks.mapInPandas(losses, "j int, r int, loss double").groupBy("j").agg(F.avg("loss").alias("importance"), (F.coalesce(F.stddev_samp("loss"), F.lit(0.0)) / F.sqrt(F.count("*"))).alias("std_error"))
    variable = F.element_at(F.array(*(F.lit(c) for c in names)), F.col("j") + 1)
    return found.select(variable.alias("variable"), "importance", "std_error")


def vif_ranking(df: DataFrame, x: Sequence[str], columns: dict[str, Column] | None = None) -> DataFrame:
    """variable, vif and score (1 / vif, 0 for an infinite one), the least collinear first."""
    own = {c: (columns or {}).get(c, number(c)) for c in x}
    return vif_ranking_from_values(df.sparkSession, list(x), solve.vif(moments(df, own), list(x)))


def vif_ranking_from_values(spark: SparkSession, names: Sequence[str], values: Sequence[float]) -> DataFrame:
    rows = [(c, float(v), 0.0 if math.isinf(v) else 1 / v) for c, v in zip(names, values, strict=True)]
    return spark.createDataFrame(rows, "variable string, vif double, score double").withColumn("rank", F.row_number().over(Window.orderBy("vif", "variable")))


def all_importance(fit: LinearFit, order_by: str, permutations: int = 5) -> DataFrame:
    """variable, standardized, mean_abs_shap, importance and vif of a least-squares fit, joined by variable."""
    m = fit.moments
    sd = math.sqrt(m.pick([fit.y]).s[0, 0] / (m.n - 1))
    a = standardized_coefficients(fit.df, fit.coefficients, fit.x, sd, fit.columns).select("variable", "standardized")
    b = mean_abs_shap(fit).select("variable", "mean_abs_shap")
    c = permutation_importance(fit, order_by, permutations).select("variable", "importance")
    d = vif_ranking(fit.df, fit.x, fit.columns).select("variable", "vif")
    return a.join(b, "variable").join(c, "variable").join(d, "variable")
