"""Descriptive statistics as plain aggregates. Empty input gives NaN (a sum: 0), as do fewer than two rows where n - 1 divides.

``median``, ``quantile`` and ``five_numbers`` are aggregate expressions, for groups: their buffer holds a group's distinct values. What summarises a whole table selects ranks instead (``order_statistics``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that a rank is looked for in on the driver, at most, unless they are all equal.
SELECT = 20_000
ACCURACY = 10_000

def _nan(c: Column) -> Column:
    return F.coalesce(c, F.lit(float("nan")))


def _number(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def mean(c) -> Column:
    return _nan(F.avg(_number(c)))


def variance(c) -> Column:
    return _nan(F.var_samp(_number(c)))


def stddev(c) -> Column:
    return _nan(F.stddev_samp(_number(c)))


def variance_population(c) -> Column:
    return _nan(F.var_pop(_number(c)))


def stddev_population(c) -> Column:
    return _nan(F.stddev_pop(_number(c)))


def median(c) -> Column:
    return quantile(c, 0.5)


def quantile(c, q: float) -> Column:
    """Linear interpolation at (n - 1) q; NaN for q outside 0 to 1."""
    if not 0 <= q <= 1:
        return F.max(F.lit(float("nan")))
    return _nan(F.percentile(_number(c), F.lit(q)))


def total(c) -> Column:
    return F.coalesce(F.sum(_number(c)), F.lit(0.0))


def _plain(c) -> Column:
    x = _number(c)
    return F.when(~F.isnan(x), x)


def minimum(c) -> Column:
    """NaN is passed over; Spark alone would rank it largest."""
    return _nan(F.min(_plain(c)))


def maximum(c) -> Column:
    return _nan(F.max(_plain(c)))


def value_range(c) -> Column:
    return _nan(F.max(_plain(c)) - F.min(_plain(c)))


def correlation(x, y) -> Column:
    """NaN where either has no variance."""
    return _nan(F.corr(_number(x), _number(y)))


def five_numbers(c) -> dict[str, Column]:
    p = F.percentile(_number(c), F.array(*(F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0))))
    return {k: _nan(F.get(p, F.lit(i))) for i, k in enumerate(("min", "q1", "median", "q3", "max"))}


def order_statistics(df: DataFrame, c: str | Column, ranks: Sequence[int]) -> list[float]:
    """The values of the given ranks (from 0) among the column's values that are not null; NaN ranks last.

    Approximate quantiles bracket every rank, one aggregate counts what is below and inside the brackets, and so on inside, until few values are left to be
    counted one by one. A round cuts the rows in question by about a thousandth, and nothing but sketches and counts is shuffled.
    """
    v = F.col("v")
    rows = df.select(_number(c).alias("v")).where("v is not null")
    n = None
    inside: dict[int, tuple[float, float, int]] = {}  # by rank: the bracket and how many values are below it
    out: dict[int, float] = {}
    todo = sorted(set(ranks))

    def within(bracket: tuple[float, float, int]) -> Column:
        return (v >= F.lit(bracket[0])) & (v <= F.lit(bracket[1]))

    while todo:
        if n is None:
            n = rows.count()
            of = {r: (rows, n, 0) for r in todo}
        brackets = {}
        for r in todo:
            held, many, below = of[r]
            place = (r - below) / max(1, many - 1)
            margin = 2.0 / ACCURACY
            brackets[r] = held, (max(0.0, place - margin), min(1.0, place + margin))
        # ranks of one set of rows are bracketed by one sketch
        for held in {id(h): h for h, _ in brackets.values()}.values():
            own = [r for r in todo if brackets[r][0] is held]
            found = held.agg(F.percentile_approx("v", F.array(*(F.lit(q) for r in own for q in brackets[r][1])), ACCURACY).alias("q")).first()["q"]
            for i, r in enumerate(own):
                low, high = found[2 * i], found[2 * i + 1]
                inside[r] = low, high, of[r][2]
        counts = rows.agg(*(F.count_if(v < F.lit(inside[r][0])).alias(f"b{r}") for r in todo), *(F.count_if(within(inside[r])).alias(f"i{r}") for r in todo)).first()
        few, rest = [], []
        for r in todo:
            low, high, _ = inside[r]
            below, many = counts[f"b{r}"], counts[f"i{r}"]
            if r < below or r >= below + many:  # the sketch missed it: one side of the bracket is open
                inside[r] = (-math.inf, low, 0) if r < below else (high, math.nan, below)
                low, high, _ = inside[r]
                below, many = rows.agg(F.count_if(v < F.lit(low)), F.count_if(within(inside[r]))).first()
            if low == high or (math.isnan(low) and math.isnan(high)):
                out[r] = low
            elif many <= SELECT:
                few.append((r, low, high, below))
            else:
                rest.append(r)
                of[r] = rows.where(within(inside[r])), many, below
        if few:
            test = within(few[0][1:3])
            for r, low, high, _ in few[1:]:
                test = test | within((low, high, 0))
            held = sorted(((math.inf if math.isnan(x["v"]) else x["v"], math.isnan(x["v"])), x["v"], x["n"]) for x in rows.where(test).groupBy("v").agg(F.count("*").alias("n")).collect())
            for r, low, high, below in few:
                at = below
                for _, value, many in held:
                    if (value >= low or math.isnan(value)) and (math.isnan(high) or value <= high):
                        at += many
                        if r < at:
                            out[r] = value
                            break
        todo = rest
    return [out[r] for r in ranks]


def quantiles(df: DataFrame, c: str | Column, qs: Sequence[float]) -> list[float]:
    """Linear interpolation at (n - 1) q, exact for tables of any size; NaN for q outside 0 to 1 or without values."""
    n = df.select(_number(c).alias("v")).where("v is not null").count()
    places = [(n - 1) * q if n and 0 <= q <= 1 else None for q in qs]
    ranks = sorted({r for p in places if p is not None for r in (math.floor(p), math.ceil(p))})
    value = dict(zip(ranks, order_statistics(df, c, ranks), strict=True)) if ranks else {}

    def at(p: float | None) -> float:
        if p is None:
            return math.nan
        low, high, part = value[math.floor(p)], value[math.ceil(p)], p - math.floor(p)
        return low if part == 0 else (1 - part) * low + part * high

    return [at(p) for p in places]


def five_number_summary(df: DataFrame, c: str) -> DataFrame:
    """One row: min, q1, median, q3, max and iqr."""
    low, q1, mid, q3, high = quantiles(df, c, (0.0, 0.25, 0.5, 0.75, 1.0))
    return df.sparkSession.createDataFrame([(low, q1, mid, q3, high, q3 - q1)], "min double, q1 double, median double, q3 double, max double, iqr double")


def outliers(df: DataFrame, c: str) -> DataFrame:
    """Rows beyond one and a half interquartile ranges outside the quartiles, by literal fences."""
    q1, q3 = quantiles(df, c, (0.25, 0.75))
    return df.where((F.col(c) < q1 - 1.5 * (q3 - q1)) | (F.col(c) > q3 + 1.5 * (q3 - q1)))


def modes(df: DataFrame, c: str) -> DataFrame:
    """A row for each value of the greatest count: mode, frequency and unique_count. NaN and null are dropped. Values are counted by a shuffle; nothing is gathered, however many tie."""
    counts = df.select(_number(c).alias("v")).where("v is not null and not isnan(v)").groupBy("v").agg(F.count("*").alias("n"))
    top = counts.agg(F.max("n").alias("frequency"), F.count("*").alias("unique_count"))
    return counts.join(F.broadcast(top), F.col("n") == F.col("frequency")).select(F.col("v").alias("mode"), "frequency", "unique_count")


def mode(df: DataFrame, c: str) -> DataFrame:
    """One row: modes (all values of the greatest count, ascending), frequency and unique_count. The tied values meet in one array; where those may be many, ``modes`` has a row for each."""
    return modes(df, c).groupBy("frequency", "unique_count").agg(F.sort_array(F.collect_list("mode")).alias("modes")).select("modes", "frequency", "unique_count")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column with all scalar statistics, from one aggregation; the medians are selected."""
    stats = {"mean": mean, "variance": variance, "stddev": stddev, "variance_population": variance_population, "stddev_population": stddev_population, "median": None, "sum": total, "min": minimum, "max": maximum, "range": value_range}
    wide = df.agg(*(f(F.col(c)).alias(f"{k}__{i}") for i, c in enumerate(columns) for k, f in stats.items() if f))
    wide = wide.select("*", *(F.lit(quantiles(df, c, (0.5,))[0]).alias(f"median__{i}") for i, c in enumerate(columns)))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"{k}__{i}").alias(k) for k in stats)) for i, c in enumerate(columns)))
    return wide.select(F.inline(rows))
