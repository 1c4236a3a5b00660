"""Local regression. The training points are a parameter of bounded size, as every fit reads all of them; query points are spread over the tasks.

With one predictor, degrees 0 and 1 use the points in sorted order, where neighbourhoods are contiguous and found by bisection, a block of queries at a time.
Otherwise the distances to all training points are taken for each query, on predictors brought to 0 to 1. A neighbourhood is a share of all points, so a fit reads a number
of values that grows with the square of the points, which is why they are bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.errors import InsufficientData, InvalidInput
from statloom.plans.moments import number

#: Training points that are collected and sent to the tasks at most.
MOST_POINTS = 200_000


@dataclass
class LoessFit:
    train_x: np.ndarray
    train_y: np.ndarray
    span: float
    degree: int
    robust_iterations: int
    surface: str
    fitted: np.ndarray
    order: list


def neighborhood_size(span: float, n: int, degree: int) -> int:
    return min(n, max(math.floor(span * n + 1e-7), 3 if degree == 2 else 2))


def tricube(u: np.ndarray) -> np.ndarray:
    return np.where(np.abs(u) < 1, (1 - np.abs(u) ** 3) ** 3, 0.0)


def tricube_bounded(d: np.ndarray, h: float) -> np.ndarray:
    """0 beyond .999 of the bandwidth, 1 within .001 of it; 1 where there is none."""
    if h <= 0:
        return np.ones_like(d)
    return np.where(d > 0.999 * h, 0.0, np.where(d <= 0.001 * h, 1.0, (1 - (d / h) ** 3) ** 3))


def biweights(e: np.ndarray) -> np.ndarray | None:
    """Robustness weights from six median absolute residuals; None where they are nearly 0."""
    cut = 6 * float(np.median(np.abs(e)))
    if cut < 1e-7 * float(np.abs(e).mean()):
        return None
    r = np.abs(e) / cut if cut else np.zeros_like(e)
    return np.where(r <= 0.001, 1.0, np.where(r > 0.999, 0.0, (1 - r**2) ** 2))


def normalize(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """To 0 to 1 by column; one half where a column is constant."""
    low, high = x.min(axis=0), x.max(axis=0)
    wide = np.where(high > low, high - low, 1.0)
    return np.where(high > low, (x - low) / wide, 0.5), low, np.where(high > low, wide, np.inf)


def _design(d: np.ndarray, degree: int) -> np.ndarray:
    columns = [np.ones(len(d))]
    if degree >= 1:
        columns += list(d.T)
    if degree == 2:
        k = d.shape[1]
        columns += [d[:, i] * d[:, j] for i in range(k) for j in range(i, k)]
    return np.column_stack(columns)


#: Values of neighbourhoods that are held at a time.
HELD = 2_000_000


def _fit_sorted(queries: np.ndarray, x: np.ndarray, y: np.ndarray, k: int, degree: int, robust: np.ndarray | None) -> np.ndarray:
    """Degrees 0 and 1 of one predictor; NaN where weights don't decide (no bandwidth or no weight)."""
    order = np.argsort(x, kind="stable")
    xs, ys, spread = x[order], y[order], float(x.max() - x.min())
    rs = None if robust is None else robust[order]
    middle = (xs[: len(xs) - k] + xs[k:]) / 2  # beyond it the next window is nearer
    first = np.searchsorted(middle, queries, side="left")
    out = np.empty(len(queries))
    block = max(1, HELD // k)
    for s in range(0, len(queries), block):
        q, at = queries[s : s + block, None], first[s : s + block, None] + np.arange(k)
        u, v = xs[at], ys[at]
        d = np.abs(u - q)
        h = d.max(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            w = np.where(d > 0.999 * h, 0.0, np.where(d <= 0.001 * h, 1.0, (1 - (d / h) ** 3) ** 3))
            if rs is not None:
                w = w * rs[at]
            total = w.sum(axis=1)
            level = (w * v).sum(axis=1) / total
            if degree == 1:
                mean = (w * u).sum(axis=1) / total
                away = u - mean[:, None]
                var = (w * away**2).sum(axis=1) / total
                level = np.where(np.sqrt(var) <= 0.001 * spread, level, level + (q[:, 0] - mean) * (w * away * v).sum(axis=1) / (total * var))
        out[s : s + block] = np.where((h[:, 0] > 0) & (total > 0), level, np.nan)
    return out


def fit_points(queries: np.ndarray, x: np.ndarray, y: np.ndarray, k: int, degree: int, robust: np.ndarray | None = None) -> np.ndarray:
    """The local fit at each query; ties in distance go to the earlier training row."""
    if x.shape[1] == 1 and degree < 2 and len(queries):
        out = _fit_sorted(queries[:, 0], x[:, 0], y, k, degree, robust)
        left = np.flatnonzero(np.isnan(out))
        if len(left):
            out[left] = _fit_each(queries[left], x, y, k, degree, robust)
        return out
    return _fit_each(queries, x, y, k, degree, robust)


def _fit_each(queries: np.ndarray, x: np.ndarray, y: np.ndarray, k: int, degree: int, robust: np.ndarray | None) -> np.ndarray:
    out = np.empty(len(queries))
    spread = float(x[:, 0].max() - x[:, 0].min())
    for q, point in enumerate(queries):
        d = np.sqrt(((x - point) ** 2).sum(axis=1))
        near = np.argpartition(d, k - 1)[:k] if k < len(d) else np.arange(len(d))
        h = float(d[near].max())
        if k < len(d):
            inside = np.flatnonzero(d < h)
            at = np.flatnonzero(d == h)[: k - len(inside)]
            near = np.sort(np.concatenate([inside, at]))
        w = tricube_bounded(d[near], h)
        if robust is not None:
            w = w * robust[near]
        own, v = x[near], y[near]
        total = w.sum()
        if not total > 0:
            out[q] = v[int(np.argmin(d[near]))]
            continue
        if degree == 0:
            out[q] = (w @ v) / total
        elif degree == 1 and x.shape[1] == 1:
            u = own[:, 0]
            mean = (w @ u) / total
            var = (w @ (u - mean) ** 2) / total
            level = (w @ v) / total
            out[q] = level if math.sqrt(var) <= 0.001 * spread else level + (point[0] - mean) * (w @ ((u - mean) * v)) / (total * var)
        else:
            design = _design(own - point, degree)
            if len(near) < design.shape[1]:
                raise InsufficientData(design.shape[1], len(near))
            root = np.sqrt(w)[:, None]
            out[q] = np.linalg.lstsq(design * root, v * root[:, 0], rcond=None)[0][0]
    return out


def _spread(df: DataFrame, columns: list[Column], keep: list[str], x: np.ndarray, y: np.ndarray, k: int, degree: int, robust: np.ndarray | None, low: np.ndarray, wide: np.ndarray, tasks: int) -> DataFrame:
    """``keep`` and yhat for every row, fitted where the rows are."""
    own = df.select(*keep, *(c.alias(f"q{i}") for i, c in enumerate(columns)))
    own = own.repartition(tasks) if tasks > 1 else own
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.select(*keep).schema)

    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = np.column_stack([b.column(f"q{i}").to_numpy(zero_copy_only=False) for i in range(width)]).astype(float)
            q = (q - low) / wide if len(low) else q
            yhat = fit_points(q, x, y, k, degree, robust)
            yield pa.record_batch([*(b.column(c) for c in keep), pa.array(yhat)], names=[*keep, "yhat"])

    return own.mapInArrow(run, f"{kinds}, yhat double")


def loess(df: DataFrame, y: str, x: Sequence[str], order_by: str, span: float = 0.75, degree: int = 1, robust_iterations: int = 0, surface: str = "direct", columns: dict[str, Column] | None = None, tasks: int | None = None) -> tuple[DataFrame, LoessFit]:
    """(order_by, yhat) for every training row, and the fit, which ``predict`` takes. ``surface`` is recorded; values are always computed directly."""
    if not 0 < span <= 1 or degree not in (0, 1, 2):
        raise InvalidInput("the span must be above 0 and at most 1, the degree 0, 1 or 2")
    own = {c: (columns or {}).get(c, number(c)) for c in [*x, y]}
    data = df.select(F.col(order_by).alias("_o"), *(own[c].alias(f"v{i}") for i, c in enumerate([*x, y])))
    if data.limit(MOST_POINTS + 1).count() > MOST_POINTS:
        raise InvalidInput(f"more than {MOST_POINTS} training points; fit a sample and predict the rest")
    rows = data.orderBy("_o").collect()
    if len(rows) < 2:
        raise InsufficientData(2, len(rows))
    order = [r[0] for r in rows]
    table = np.array([list(r)[1:] for r in rows], float)
    if not np.isfinite(table).all():
        raise InvalidInput("a value is null, NaN or infinite")
    tx, ty = table[:, :-1], table[:, -1]
    plain = len(x) == 1  # one predictor stays as it is
    nx, low, wide = (tx, np.zeros(0), np.zeros(0)) if plain else normalize(tx)
    k = neighborhood_size(span, len(rows), degree)
    tasks = tasks or max(1, min(df.sparkSession.sparkContext.defaultParallelism, len(rows) // 50))
    robust = None
    spark = df.sparkSession
    points = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(tx)], ", ".join(["i long", *(f"q{j} double" for j in range(tx.shape[1]))]))
    for step in range(robust_iterations + 1):
        found = _spread(points, [F.col(f"q{j}") for j in range(tx.shape[1])], ["i"], nx, ty, k, degree, robust, low, wide, tasks)
        fitted = np.array([r["yhat"] for r in sorted(found.collect(), key=lambda r: r["i"])])
        if step < robust_iterations and (new := biweights(ty - fitted)) is not None:
            robust = new
        elif step < robust_iterations:
            break
    fit = LoessFit(tx, ty, span, degree, robust_iterations, surface, fitted, order)
    kind = df.select(order_by).schema[0].dataType.simpleString()
    return spark.createDataFrame(list(zip(order, map(float, fitted), strict=True)), f"`{order_by}` {kind}, yhat double"), fit


def predict(fit: LoessFit, new: DataFrame, x: Sequence[str], keep: Sequence[str], columns: dict[str, Column] | None = None, tasks: int = 1) -> DataFrame:
    """``keep`` and yhat for each new row; without robustness weights."""
    plain = fit.train_x.shape[1] == 1
    nx, low, wide = (fit.train_x, np.zeros(0), np.zeros(0)) if plain else normalize(fit.train_x)
    k = neighborhood_size(fit.span, len(nx), fit.degree)
    return _spread(new, [(columns or {}).get(c, number(c)) for c in x], list(keep), nx, fit.train_y, k, fit.degree, None, low, wide, tasks)
