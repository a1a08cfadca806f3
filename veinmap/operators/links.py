"""Cutting of lineage, and connected components of links."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Shared paths of this process that ``clean`` has not removed yet.
_made: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``.

    Where that is unset a session whose executors are threads of the driver (tests) takes a folder of
    its warehouse; on a cluster that is an error, for the warehouse may be one machine's.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    _made.append(path := f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return path


def clean(spark: SparkSession) -> None:
    """Removes what this process wrote to shared paths; DataFrames that read them end with it."""
    for path in list(_made):
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes one shared path."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)
    if path in _made:
        _made.remove(path)


def cut_to(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``cut``, with the path, for what a later step removes."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


#: Removes a query's shuffle files at its end; by default they stay until the driver collects its garbage.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_free(df: DataFrame, name: str = "cut") -> tuple[DataFrame, str]:
    """As ``cut_to``; the shuffle files of the writing go with its end, for only the table is read again."""
    conf = df.sparkSession.conf
    before = conf.get(_FREE, None)
    conf.set(_FREE, "true")
    try:
        return cut_to(df, name)
    finally:
        conf.unset(_FREE) if before is None else conf.set(_FREE, before)


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written to the shared folder of ``spark.checkpoint.dir`` and read again.

    Lost executors then cost no recomputation, and Python stages before it run once.
    """
    return cut_to(df, "cut")[0]


def ranked(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` with ``name``: a row's number from 0 in the order of the column ``order``.

    Rows are dealt by ranges and numbered inside them; a window adds up one row for each range.
    """
    rows = cut(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__m", F.monotonically_increasing_id()))
    rows = rows.withColumn("__part", F.shiftright("__m", 33))
    parts = rows.groupBy("__part").agg(F.min("__m").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = parts.select("__part", (before - F.col("__first")).alias("__base"))
    return rows.join(F.broadcast(base), "__part").withColumn(name, F.col("__m") + F.col("__base")).drop("__m", "__part", "__base")


def components(links: DataFrame) -> DataFrame:
    """``a``, ``b`` (links between longs) -> node, component (the smallest node reachable).

    Each round hooks every node to its smallest neighbour, follows the hooks to their ends and
    contracts the links, so rounds grow with the logarithm of the nodes.  Rows are small and stay
    distributed; each round is written, which cuts lineage.
    """
    edges = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = cut(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("component")))
    while not edges.isEmpty():
        up = cut(edges.groupBy(F.col("b").alias("x")).agg(F.min("a").alias("up")))  # a hook leads to a smaller node: no cycles
        while True:
            over = up.select(F.col("x").alias("up"), F.col("up").alias("over"))
            step = cut(up.join(over, "up", "left").select("x", F.coalesce("over", "up").alias("up"), F.col("over").isNotNull().alias("moved")))
            up = step.select("x", "up")
            if step.where("moved").isEmpty():
                break
        end = lambda c: up.select(F.col("x").alias(c), F.col("up").alias(f"{c}_up"))
        nodes = cut(nodes.join(end("component"), "component", "left").select("node", F.coalesce("component_up", "component").alias("component")))
        moved = edges.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("a_up", "a").alias("a"), F.coalesce("b_up", "b").alias("b"))
        edges = cut(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return nodes
