"""First and second moments of columns: one mergeable aggregate from which every linear fit follows.

Catalyst computes counts, means and central co-moments in partial and final hash aggregates, so a fit shuffles one row from each
partition. Moments of disjoint rows merge; grouped moments are one aggregation for all groups.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from statloom.errors import InsufficientData, InvalidInput


@dataclass
class Moments:
    """n, means and central sums of products S[i, j] = sum (x_i - mean_i)(x_j - mean_j), weighted where weights are given."""

    names: list[str]
    n: float
    mean: np.ndarray
    s: np.ndarray
    rows: int = 0

    def merge(self, other: Moments) -> Moments:
        """Of the union of both row sets."""
        if not self.n:
            return other
        if not other.n:
            return self
        n, d = self.n + other.n, other.mean - self.mean
        return Moments(self.names, n, self.mean + d * (other.n / n), self.s + other.s + np.outer(d, d) * (self.n * other.n / n), self.rows + other.rows)

    def pick(self, names: Sequence[str]) -> Moments:
        at = [self.names.index(c) for c in names]
        return Moments(list(names), self.n, self.mean[at], self.s[np.ix_(at, at)], self.rows)


def number(c: str | Column) -> Column:
    return (F.col(f"`{c}`") if isinstance(c, str) else c).cast("double")


def unfit(c: Column) -> Column:
    """Null, NaN or infinite."""
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def moment_columns(columns: dict[str, Column]) -> list[Column]:
    """The aggregate expressions, named by position."""
    cs = list(columns.values())
    bad = unfit(cs[0])
    for c in cs[1:]:
        bad = bad | unfit(c)
    out = [F.count("*").alias("n"), F.count_if(bad).alias("bad")]
    out += [F.avg(c).alias(f"m{i}") for i, c in enumerate(cs)]
    for i, a in enumerate(cs):
        for j in range(i, len(cs)):
            out.append((F.var_pop(a) if i == j else F.covar_pop(a, cs[j])).alias(f"s{i}_{j}"))
    return out


def from_row(names: Sequence[str], row: Row) -> Moments:
    if row["bad"]:
        raise InvalidInput(f"{row['bad']} rows have a null, NaN or infinite value in {', '.join(names)}")
    k, n = len(names), row["n"]
    s = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            s[i, j] = s[j, i] = (row[f"s{i}_{j}"] or 0.0) * n
    return Moments(list(names), float(n), np.array([row[f"m{i}"] or 0.0 for i in range(k)]), s, n)


def moments(df: DataFrame, columns: dict[str, Column]) -> Moments:
    return from_row(list(columns), df.agg(*moment_columns(columns)).first())


def grouped_moments(df: DataFrame, by: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """A row for each group; ``from_row`` reads it."""
    return df.groupBy(*by).agg(*moment_columns(columns))


def weighted_moments(df: DataFrame, columns: dict[str, Column], weight: Column) -> Moments:
    """Weights must be finite, not negative and not all 0. The products are taken about the unweighted means, so large offsets do not cancel."""
    cs = list(columns.values())
    bad = unfit(weight)
    for c in cs:
        bad = bad | unfit(c)
    first = df.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.count_if(weight < 0).alias("negative"), F.sum(weight).alias("total"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(cs))).first()
    if first["bad"]:
        raise InvalidInput(f"{first['bad']} rows have a null, NaN or infinite value")
    if first["negative"]:
        raise InvalidInput("a weight is negative")
    if not first["n"] or not first["total"] > 0:
        raise InvalidInput("the weights' sum must be above 0")
    about = [c - F.lit(float(first[f"m{i}"])) for i, c in enumerate(cs)]
    sums = [F.sum(weight * a).alias(f"m{i}") for i, a in enumerate(about)]
    sums += [F.sum(weight * about[i] * about[j]).alias(f"s{i}_{j}") for i in range(len(cs)) for j in range(i, len(cs))]
    row, total = df.agg(*sums).first(), float(first["total"])
    shift = np.array([row[f"m{i}"] / total for i in range(len(cs))])
    s = np.zeros((len(cs), len(cs)))
    for i in range(len(cs)):
        for j in range(i, len(cs)):
            s[i, j] = s[j, i] = row[f"s{i}_{j}"] - total * shift[i] * shift[j]
    return Moments(list(columns), total, np.array([first[f"m{i}"] for i in range(len(cs))]) + shift, s, first["n"])


def _r(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The triangular factor of all rows of a partition."""
    held, names = None, None
    for b in batches:
        names = b.schema.names
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(float)
        held = np.linalg.qr(x if held is None else np.vstack([held, x]), mode="r")
    if held is not None:
        yield pa.record_batch([pa.array(held[:, i]) for i in range(held.shape[1])], names=names)


def triangle(df: DataFrame, columns: dict[str, Column]) -> np.ndarray:
    """R of the tall matrix of the columns by a tree of QR factorisations: each partition keeps its R alone, and a hundred of them become one until few are left."""
    rows = df.select(*(c.alias(f"c{i}") for i, c in enumerate(columns.values())))
    schema = ", ".join(f"c{i} double" for i in range(len(columns)))
    tasks = rows.rdd.getNumPartitions()  # of the plan; no row is read
    parts = rows.mapInArrow(_r, schema)
    while tasks > 100:
        tasks = -(-tasks // 100)
        parts = parts.coalesce(tasks).mapInArrow(_r, schema)
    stack = np.array([list(r) for r in parts.collect()], float).reshape(-1, len(columns))
    return np.linalg.qr(stack, mode="r") if len(stack) else stack


def need(n: float, required: int) -> None:
    if n < required:
        raise InsufficientData(required, int(n))
