"""K-fold cross-validation. The moments of all folds come from one grouped aggregation; a training set's moments are those of the other folds, merged."""

from __future__ import annotations

import math
from array import array
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.errors import InsufficientData, InvalidInput
from statloom.operators import penalized
from statloom.operators.linear import linear
from statloom.plans import solve
from statloom.plans.moments import Moments, from_row, moment_columns, number
from statloom.plans.ordered import blocks, generated, number_rows


def fisher_yates(n: int, seed: int = 42) -> array:
    """The permutation that a linear congruential generator of modulus 2**32 drives, low bits rejected until below the bound."""
    state, mask = (seed + 1) & 0xFFFFFFFFFFFFFFFF, 0xFFFFFFFF
    out = array("q", range(n))
    for i in range(n - 1, 0, -1):
        bound = i + 1
        limit = mask // bound * bound
        while True:
            state = (state * 1103515245 + 12345) & mask
            if state < limit:
                break
        j = state % bound
        out[i], out[j] = out[j], out[i]
    return out


#: Rows up to which a generated order is broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def with_folds(df: DataFrame, order_by: str, folds: int, shuffle: bool = False, seed: int = 42, sequential: int | None = None) -> DataFrame:
    """A column ``fold`` from 1: contiguous blocks in order, the first ones a row longer. Shuffled: blocks of the sequential generator's order, which one task makes; with ``sequential``, only up to so many rows, and beyond it of the order of a seeded hash, which no task holds."""
    if folds < 2:
        raise InvalidInput("two folds are needed")
    drawn = shuffle and (sequential is None or df.limit(sequential + 1).count() <= sequential)
    key = F.struct(F.md5(F.concat(F.lit(f"{seed}:"), F.col(order_by).cast("string"))), F.col(order_by)) if shuffle and not drawn else order_by
    numbered = number_rows(df, key, {c: F.col(f"`{c}`") for c in df.columns})
    if numbered.n < folds:
        raise InsufficientData(folds, numbered.n)
    if drawn:
        n = numbered.n
        order = generated(numbered.spark, n, 1, lambda r: fisher_yates(n, seed)).select(F.col("_from").alias("_t"), F.col("_t").alias("_place"))
        rows = numbered.rows.join(F.broadcast(order) if n <= BROADCAST_ROWS else order.hint("merge"), "_t")
        return rows.select(*(F.col(f"`{c}`") for c in df.columns), blocks(F.col("_place"), numbered.n, folds).alias("fold"))
    return numbered.rows.select(*(F.col(f"`{c}`") for c in df.columns), blocks(F.col("_t"), numbered.n, folds).alias("fold"))


def metrics(actual: Column, predicted: Column) -> dict[str, Column]:
    """mse, rmse, mae (0 of nothing) and r_squared (0 of one row; without variance 1 if exact, else 0)."""
    e = actual - predicted
    rss, tss = F.sum(e * e), F.var_pop(actual) * F.count("*")
    mse = F.coalesce(F.avg(e * e), F.lit(0.0))
    r2 = F.when(F.count("*") <= 1, 0.0).when(tss == 0, F.when(rss == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(rss, tss))
    return {"mse": mse, "rmse": F.sqrt(mse), "mae": F.coalesce(F.avg(F.abs(e)), F.lit(0.0)), "r_squared": r2}


def cross_validate(df: DataFrame, y: str, x: Sequence[str], order_by: str, folds: int = 5, kind: str = "ols", lam: float = 1.0, alpha: float = 0.5, standardize: bool = True, shuffle: bool = False, seed: int = 42, columns: dict[str, Column] | None = None, sequential: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A row for each fold (fold, train_size, test_size, mse, rmse, mae, r_squared, train_r_squared), and a row for each fold and term (coefficient).

    Two passes: the folds' moments, then all folds' errors at once with each row's own fold's coefficients.
    """
    x = list(x)
    own = {c: (columns or {}).get(c, number(c)) for c in [*x, y]}
    rows = df.select(F.col(order_by), *(own[c].alias(f"v{i}") for i, c in enumerate([*x, y])))
    rows = with_folds(rows, order_by, folds, shuffle, seed, sequential)
    named = {c: F.col(f"v{i}") for i, c in enumerate([*x, y])}
    found = rows.groupBy("fold").agg(*moment_columns(named)).collect()  # one row for each fold
    parts = {r["fold"]: from_row(list(named), r) for r in found}
    if len(parts) < folds:
        raise InsufficientData(folds, sum(int(m.n) for m in parts.values()))
    coefficients: dict[int, list[float]] = {}
    sizes, train_r2 = {}, {}
    for f in sorted(parts):
        train = Moments([*x, y], 0.0, np.zeros(len(x) + 1), np.zeros((len(x) + 1, len(x) + 1)))
        for g in sorted(parts):
            if g != f:
                train = train.merge(parts[g])
        if kind == "ols":
            kept = [0]
            for i, c in enumerate(x):
                if not solve.near_singular(train, [x[j - 1] for j in kept if j] + [c]):
                    kept.append(i + 1)
            b = [0.0 if math.isnan(v) else float(v) for v in solve.intercept_solution(train, x, y, kept).b]
        else:
            s = penalized.scale(train, x, y, standardize)
            a = {"ridge": 0.0, "lasso": 1.0}.get(kind, alpha)
            unit = np.linalg.solve(s.q + lam / s.y_scale * np.eye(len(x)), s.c) if kind == "ridge" else penalized.coordinate_descent(s.q, s.c, lam / s.y_scale, a)[0]
            slopes = unit * s.y_scale / s.x_scale
            b = [s.y_mean - float(slopes @ s.x_mean), *map(float, slopes)]
        coefficients[f] = b
        sizes[f] = (int(train.n), int(parts[f].n))
        p = train.pick([*x, y])
        k, w = len(x), np.array(b[1:])
        offset = p.mean[k] - b[0] - w @ p.mean[:k]
        rss = p.s[k, k] - 2 * w @ p.s[:k, k] + w @ p.s[:k, :k] @ w + train.n * offset**2
        train_r2[f] = float(1 - rss / p.s[k, k]) if p.s[k, k] > 0 else 0.0
    predicted = None
    for f, b in coefficients.items():
        value = linear([named[c] for c in x], b)
        predicted = F.when(F.col("fold") == f, value) if predicted is None else predicted.when(F.col("fold") == f, value)
    scores = rows.withColumn("_p", predicted).groupBy("fold").agg(*(c.alias(k) for k, c in metrics(named[y], F.col("_p")).items()))
    spark = df.sparkSession
    info = spark.createDataFrame([(f, *sizes[f], train_r2[f]) for f in sorted(parts)], "fold int, train_size long, test_size long, train_r_squared double")
    per_fold = scores.join(F.broadcast(info), "fold").select("fold", "train_size", "test_size", "mse", "rmse", "mae", "r_squared", "train_r_squared")
    terms = spark.createDataFrame([(f, t, v) for f, b in coefficients.items() for t, v in zip(["intercept", *x], b, strict=True)], "fold int, term string, coefficient double")
    return per_fold, terms


def summarize(per_fold: DataFrame) -> DataFrame:
    """One row: means and n - 1 deviations over the folds (0 of one fold)."""
    out = [F.count("*").alias("n_folds"), F.sum("test_size").alias("n_samples")]
    for k in ("mse", "rmse", "mae", "r_squared"):
        out += [F.avg(k).alias(f"mean_{k}"), F.coalesce(F.stddev_samp(k), F.lit(0.0)).alias(f"std_{k}")]
    return per_fold.agg(*out, F.avg("train_r_squared").alias("mean_train_r_squared"))


def most_stable(terms: DataFrame) -> DataFrame:
    """The term of the smallest population deviation over the folds; the first by name on ties."""
    return terms.groupBy("term").agg(F.stddev_pop("coefficient").alias("std"), F.avg("coefficient").alias("mean")).orderBy("std", "term").limit(1)
