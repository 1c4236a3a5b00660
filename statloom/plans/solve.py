"""Small dense solves on the driver. What they see has one row and column for each term."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from statloom.errors import SingularMatrix
from statloom.plans.moments import Moments

#: A column whose norm falls below this share of its own length, once earlier columns are taken out, is dropped.
RANK_TOLERANCE = 1e-7


@dataclass
class Solution:
    """Coefficients with the intercept first (NaN where a column is dropped), the inverse of X'X over the kept terms, and their numbers."""

    b: np.ndarray
    inverse: np.ndarray
    kept: list[int]
    rss: float
    tss: float
    exact_rss: bool

    @property
    def rank(self) -> int:
        return len(self.kept)


def kept_columns(r: np.ndarray) -> list[int]:
    """Columns of a triangular factor that are not combinations of earlier kept ones."""
    basis: list[np.ndarray] = []
    kept = []
    for j in range(r.shape[1]):
        v = r[:, j].copy()
        norm = np.linalg.norm(v)
        for _ in range(2):
            for q in basis:
                v -= q * (q @ v)
        if norm > 0 and np.linalg.norm(v) >= RANK_TOLERANCE * norm:
            basis.append(v / np.linalg.norm(v))
            kept.append(j)
    return kept


def near_singular(m: Moments, x: list[str]) -> bool:
    s = m.pick(x).s
    d = np.diag(s)
    if (d <= 0).any():
        return True
    scaled = s / np.sqrt(np.outer(d, d))
    return bool(np.linalg.eigvalsh(scaled)[0] < 1e-10) if len(x) else False


def intercept_solution(m: Moments, x: list[str], y: str, kept: list[int] | None = None) -> Solution:
    """Least squares of y on an intercept and x from central moments; ``kept`` numbers the terms (0: intercept) that stay."""
    kept = list(range(len(x) + 1)) if kept is None else kept
    own = [x[i - 1] for i in kept if i]
    p = m.pick([*own, y])
    k = len(own)
    sxx, sxy, tss = p.s[:k, :k], p.s[:k, k], float(p.s[k, k])
    scale = np.sqrt(np.maximum(np.diag(sxx), 1e-300))
    try:
        inner = np.linalg.inv(sxx / np.outer(scale, scale)) / np.outer(scale, scale) if k else np.zeros((0, 0))
    except np.linalg.LinAlgError as e:
        raise SingularMatrix("the predictors are collinear") from e
    slopes = inner @ sxy
    b = np.full(len(x) + 1, np.nan)
    means = p.mean[:k]
    b[0] = p.mean[k] - slopes @ means
    for i, v in zip([i for i in kept if i], slopes, strict=True):
        b[i] = v
    inverse = np.zeros((k + 1, k + 1))
    inverse[1:, 1:] = inner
    inverse[0, 1:] = inverse[1:, 0] = -inner @ means
    inverse[0, 0] = 1 / m.n + means @ inner @ means
    rss = tss - float(slopes @ sxy)
    return Solution(b, inverse, kept, max(rss, 0.0), tss, rss > 1e-8 * tss)


def least_norm(m: Moments, x: list[str], y: str) -> Solution:
    """Collinear least squares: of all solutions the one of least norm once terms are scaled to unit length, and the pseudo-inverse, undone likewise."""
    p = m.pick([*x, y])
    k = len(x)
    means = np.r_[1.0, p.mean[:k]]
    gram = m.n * np.outer(means, means)
    gram[1:, 1:] += p.s[:k, :k]
    target = m.n * means * p.mean[k]
    target[1:] += p.s[:k, k]
    scales = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    inverse = np.linalg.pinv(gram / np.outer(scales, scales), rcond=1e-11, hermitian=True) / np.outer(scales, scales)
    b = inverse @ target
    return Solution(b, inverse, list(range(k + 1)), max(float(p.s[k, k] - b[1:] @ p.s[:k, k]), 0.0), float(p.s[k, k]), False)


def ridge_fallback(m: Moments, x: list[str], y: str, penalty: float = 1e-4) -> np.ndarray:
    """Coefficients with the penalty on every term of X'X, the intercept too."""
    p = m.pick([*x, y])
    k = len(x)
    full = np.zeros((k + 2, k + 2))
    raw = p.s + m.n * np.outer(p.mean, p.mean)
    full[0, 0] = m.n
    full[0, 1:] = full[1:, 0] = m.n * p.mean
    full[1:, 1:] = raw
    return np.linalg.solve(full[: k + 1, : k + 1] + penalty * np.eye(k + 1), full[: k + 1, k + 1])


def vif(m: Moments, x: list[str]) -> list[float]:
    """Diagonal of the inverse correlation matrix, at least 1; all infinite if it has none."""
    s = m.pick(x).s
    d = np.diag(s)
    if len(x) <= 1:
        return []
    if (d <= 0).any():
        return [math.inf] * len(x)
    c = s / np.sqrt(np.outer(d, d))
    if np.linalg.eigvalsh(c)[0] < 1e-12:
        return [math.inf] * len(x)
    return [max(1.0, float(v)) for v in np.diag(np.linalg.inv(c))]


def log_likelihood(n: float, rss: float) -> float:
    return -n / 2 * math.log(2 * math.pi * rss / n) - n / 2 if rss > 0 else math.inf


def aic(ll: float, terms: int, variance: bool = True) -> float:
    """Counts the error variance as a parameter, as R does; without it as statsmodels does."""
    return 2 * (terms + variance) - 2 * ll


def bic(ll: float, terms: int, n: float, variance: bool = True) -> float:
    return (terms + variance) * math.log(n) - 2 * ll
