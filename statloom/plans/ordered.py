"""Row numbers, lags and running sums in a global order, without one task that sees every row.

Rows are range-partitioned by the order and sorted within partitions; what one partition needs of the others (how many rows came
before, their last values, their sums) is a row for each partition.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statloom.errors import InvalidInput


def checkpoint(df: DataFrame) -> DataFrame:
    """Written to the shared folder of ``spark.checkpoint.dir``; a temporary one only on one machine without that setting."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.gettempdir() + "/statloom-checkpoints")
    return df.checkpoint()


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.gettempdir() + "/statloom-scratch"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def delete() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone by then
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    atexit.register(delete)
    return path


@dataclass
class Ordered:
    """``rows``: the columns, _t (from 1) and _p, the partition; n rows in all. ``starts``: rows before each partition."""

    rows: DataFrame
    n: int
    starts: dict[int, int]

    @property
    def within(self):
        return Window.partitionBy("_p").orderBy("_t")

    @property
    def spark(self) -> SparkSession:
        return self.rows.sparkSession

    def lagged(self, column: str, most: int) -> DataFrame:
        """Columns l1 to l<most>: the column that many rows before, null where there is none."""
        ends = self.rows.withColumn("_back", F.row_number().over(Window.partitionBy("_p").orderBy(F.desc("_t")))).where(F.col("_back") <= most).select("_p", "_t", column).collect()  # most rows of each partition
        values = {r["_t"]: r[column] for r in ends}
        before = [(p, s, [values.get(s - j) for j in range(most)]) for p, s in self.starts.items()]
        table = self.spark.createDataFrame(before, "_p long, _start long, _before array<double>")
        joined = self.rows.join(F.broadcast(table), "_p")
        place = F.col("_t") - F.col("_start")  # from 1 within the partition
        lags = [F.when(place > j, F.lag(column, j).over(self.within)).otherwise(F.get("_before", (F.lit(j) - place).cast("int"))).alias(f"l{j}") for j in range(1, most + 1)]
        return joined.select(*self.rows.columns, *lags)

    def running(self, sums: dict[str, Column]) -> DataFrame:
        """Sums over all rows before each row, null for the first."""
        parts = {r["_p"]: r for r in self.rows.groupBy("_p").agg(*(F.sum(c).alias(k) for k, c in sums.items())).collect()}
        total, table = [0.0] * len(sums), []
        for p in sorted(parts, key=lambda p: self.starts[p]):
            table.append((p, *total))
            total = [a + (parts[p][k] or 0.0) for a, k in zip(total, sums, strict=True)]
        earlier = self.spark.createDataFrame(table, ", ".join(["_p long", *(f"_b_{k} double" for k in sums)]))
        w = self.within.rowsBetween(Window.unboundedPreceding, -1)
        out = [F.when(F.col("_t") > 1, F.coalesce(F.sum(c).over(w), F.lit(0.0)) + F.col(f"_b_{k}")).alias(k) for k, c in sums.items()]
        return self.rows.join(F.broadcast(earlier), "_p").select(*self.rows.columns, *out)


def number_rows(df: DataFrame, order_by: str | Column, columns: dict[str, Column], unique: bool = True) -> Ordered:
    """Number the rows in order. Where the order must be unique and isn't, that is an error."""
    key = F.col(order_by) if isinstance(order_by, str) else order_by
    own = df.select(key.alias("_o"), *(c.alias(k) for k, c in columns.items()))
    saved = checkpoint(own.repartitionByRange("_o").sortWithinPartitions("_o").withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    # equal keys share a partition, so counting them shuffles nothing; the partitions' sums follow from the same job
    keys = saved.groupBy("_o").agg(F.count("*").alias("n"), F.min(part).alias("p")) if unique else saved.select(F.lit(1).alias("n"), part.alias("p"))
    found = keys.groupBy("p").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()
    if any(r["most"] > 1 for r in found):
        raise InvalidInput(f"{order_by} does not order the rows uniquely")
    counts = {r["p"]: r["n"] for r in found}
    starts, total = {}, 0
    for p in sorted(counts):
        starts[p], total = total, total + counts[p]
    if not counts:
        return Ordered(saved.select(*columns, F.lit(1).cast("long").alias("_t"), F.lit(0).cast("long").alias("_p")), 0, {})
    table = df.sparkSession.createDataFrame(list(starts.items()), "_p long, _start long")
    rows = saved.withColumn("_p", part).join(F.broadcast(table), "_p")
    place = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return Ordered(rows.select(*columns, (F.col("_start") + place + 1).alias("_t"), "_p"), total, starts)


def generated(spark: SparkSession, n: int, orders: int, order: Callable[[int], Sequence[int]]) -> DataFrame:
    """A row (_r, _t, _from) for each entry of ``order(r)``, r from 0: a permutation of 0 to n - 1, here from 1. A task makes each; only its worker holds it, with 8 bytes a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.column(0).to_pylist()):
            made = order(r)
            for s in range(0, n, 1 << 16):
                own = np.array(made[s : s + (1 << 16)], np.int64) + 1
                yield pa.record_batch({"_r": pa.array(np.full(len(own), r)), "_t": pa.array(np.arange(s + 1, s + 1 + len(own))), "_from": pa.array(own)})

    return spark.range(0, orders, 1, orders).mapInArrow(run, "_r long, _t long, _from long")


def blocks(t: Column, n: int, folds: int) -> Column:
    """The fold (from 1) of row t when n rows fall into contiguous blocks, the first ones a row longer."""
    size, longer = divmod(n, folds)
    head = longer * (size + 1)
    return F.when(t <= head, F.ceil(t / (size + 1))).otherwise(longer + F.ceil((t - head) / max(size, 1))).cast("int")


def names(columns: Sequence[str]) -> dict[str, Column]:
    return {c: F.col(c) for c in columns}
