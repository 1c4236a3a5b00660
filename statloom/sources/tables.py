"""Reading CSV text and files, and finding their numeric columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.errors import ParseError
from statloom.plans.ordered import number_rows


@dataclass
class CsvTable:
    """Trimmed cells as strings, the header and the sorted names of columns with at least one finite number."""

    data: DataFrame
    headers: list[str]
    numeric_columns: list[str]

    @property
    def n_rows(self) -> int:
        return self.data.count()

    @property
    def n_cols(self) -> int:
        return len(self.headers)

    def numbers(self) -> DataFrame:
        """Numeric columns as doubles; what is no finite number is null."""
        return self.data.select(*(finite(c).alias(c) if c in self.numeric_columns else F.col(f"`{c}`") for c in self.headers))


def finite(c: str):
    v = F.col(f"`{c}`").try_cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v)


def numeric_columns(df: DataFrame, headers: list[str]) -> list[str]:
    """One aggregation over all columns."""
    row = df.agg(*(F.count_if(finite(c).isNotNull()).alias(f"c{i}") for i, c in enumerate(headers))).first()
    return sorted(c for i, c in enumerate(headers) if row[f"c{i}"])


def _table(rows: DataFrame, names: list[str]) -> CsvTable:
    data = rows.select(*(F.trim(F.get("cells", F.lit(i))).alias(c) for i, c in enumerate(names)))
    return CsvTable(data, names, numeric_columns(data, names))


def read_csv(spark: SparkSession, path: str, multiline: bool = False) -> CsvTable:
    """A file or folder of CSV files with a header each. Cells are trimmed; rows with another number of fields than the header are left out, as are empty lines.

    Files are split among tasks. Cells with line ends in quotes need ``multiline``, which makes a file one task's.
    """
    head = spark.read.text(path).where(F.length(F.trim("value")) > 0).first()
    if head is None:
        raise ParseError("there is no header")
    names = [c.strip() for c in _cells(spark, head[0])]
    wide = spark.read.csv(path, header=True, schema=", ".join(f"c{i} string" for i in range(len(names) + 1)) + ", _bad string", columnNameOfCorruptRecord="_bad", mode="PERMISSIVE", enforceSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, multiLine=multiline, escape='"', nullValue="\u0000", emptyValue="")
    n = len(names)
    # a field too many has a value in the extra column, one too few leaves the last one null
    kept = wide.where(F.col(f"c{n}").isNull() & F.col(f"c{n - 1}").isNotNull())
    return _table(kept.select(F.array(*(f"c{i}" for i in range(n))).alias("cells")), names)


def _cells(spark: SparkSession, line: str) -> list[str]:
    import csv

    return next(csv.reader([line]))


def parse_csv(spark: SparkSession, content: str) -> CsvTable:
    """CSV text held by the driver."""
    import csv
    import io

    rows = [r for r in csv.reader(io.StringIO(content)) if r]
    if not rows:
        raise ParseError("there is no header")
    names = [c.strip() for c in rows[0]]
    data = [r for r in rows[1:] if len(r) == len(names)]
    return _table(spark.createDataFrame([(r,) for r in data], "cells array<string>"), names)


def read_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def category_codes(df: DataFrame, column: str, start: int = 1) -> DataFrame:
    """The column replaced by the rank of its value among the sorted values, from ``start``. The values are numbered over range partitions."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    numbered = number_rows(values, column, {column: F.col(f"`{column}`")})
    coded = numbered.rows.select(F.col(f"`{column}`"), (F.col("_t") + (start - 1)).cast("double").alias("_code"))
    return df.join(F.broadcast(coded) if numbered.n <= 10_000 else coded, column, "left").withColumn(column, F.col("_code")).drop("_code")
