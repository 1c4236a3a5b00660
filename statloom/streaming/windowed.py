"""Least squares over event-time windows of a stream: moments merge, so each window's state is a few sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.plans.moments import number


def windowed_line(events: DataFrame, time: str, y: str, x: str, window: str, late: str, slide: str | None = None, columns: dict[str, Column] | None = None) -> DataFrame:
    """window_start, n, slope, intercept and r_squared of y on x in each window; works on streams and tables. Rows later than ``late`` behind the newest are dropped by a stream's watermark."""
    a, b = ((columns or {}).get(c, number(c)) for c in (x, y))
    if events.isStreaming:  # watermarks take times with a zone only
        events = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    grouped = events.groupBy(F.window(time, window, slide))
    m = grouped.agg(F.count("*").alias("n"), F.avg(a).alias("mx"), F.avg(b).alias("my"), F.var_pop(a).alias("sxx"), F.var_pop(b).alias("syy"), F.covar_pop(a, b).alias("sxy"))
    slope = F.try_divide("sxy", "sxx")
    return m.select(F.col("window.start").alias("window_start"), "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx") * F.col("syy")).alias("r_squared"))
