"""Reading the tables of a store: rows by conditions, and counts.

A table is a folder below the store's; one that isn't there has no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The names of conditions.
CONDITIONS = {
    "eq": lambda c, v: c == v,
    "neq": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "like": lambda c, v: c.like(v),
    "ilike": lambda c, v: c.ilike(v),
    "in": lambda c, v: c.isin(*v),
    "is": lambda c, v: c.isNull() if v is None else c == v,
}


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def condition(where: dict[str, tuple[str, object]]) -> Column:
    """All of column -> (name of a condition, value) hold."""
    if unknown := {op for op, _ in where.values()} - set(CONDITIONS):
        raise ValueError(f"no such condition: {', '.join(sorted(unknown))}")
    return reduce(lambda a, b: a & b, (CONDITIONS[op](F.col(c), v) for c, (op, v) in where.items()), F.lit(True))


def select(spark: SparkSession, store: str, table: str, where: dict[str, tuple[str, object]] | None = None, columns: list[str] | None = None, order: list[str] | None = None, descending: bool = False, limit: int | None = None) -> DataFrame:
    """Rows of a table that fulfil ``where``: conditions and columns reach the scan."""
    if not exists(spark, path := f"{store.rstrip('/')}/{table}"):
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns or ["id"]))
    rows = spark.read.parquet(path).where(condition(where or {}))
    if order:
        rows = rows.orderBy(*order, ascending=not descending)
    rows = rows.select(*columns) if columns else rows
    return rows.limit(limit) if limit is not None else rows


def counts(spark: SparkSession, store: str, tables: list[str]) -> DataFrame:
    """name, n: the rows of each table; 0 where there is none."""
    one = lambda t: spark.read.parquet(f"{store.rstrip('/')}/{t}").agg(F.count("*").alias("n")) if exists(spark, f"{store.rstrip('/')}/{t}") else spark.createDataFrame([(0,)], "n long")
    return reduce(DataFrame.unionByName, (one(t).select(F.lit(t).alias("name"), "n") for t in tables))
