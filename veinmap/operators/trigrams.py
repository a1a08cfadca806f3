"""Substring search by an index of trigrams.

Postings (gram, pos) are written in folders by a hash of the gram and sorted by it, so a search reads
the folders of its own grams, and in them the row groups that may hold these.  Items whose text has
all grams of the term are then tested.  New items append their postings; a batch is a folder of its
own, named by the caller, so one that is written again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veinmap.functions.text import lowered_contains

#: Folders of postings.
BUCKETS = 64


def grams(text: Column) -> Column:
    """The distinct runs of three characters of a lower-cased text."""
    low = F.lower(text)
    every = F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))
    return F.when(F.length(low) >= 3, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def add(items: DataFrame, folder: str, batch: str, text_col: str = "name", id_col: str = "pos") -> None:
    """Writes the postings of ``items`` as one batch; a null text has none.

    A gram of very many items is dealt over the tasks that write its folder.
    """
    rows = items.where(F.col(text_col).isNotNull()).select(F.explode(grams(F.col(text_col))).alias("gram"), F.col(id_col).alias("id"))
    rows = rows.withColumn("bucket", _bucket(F.col("gram"))).repartitionByRange("bucket", "gram", "id").sortWithinPartitions("bucket", "gram", "id")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/batch={batch}")


def candidates(spark: SparkSession, folder: str, term: str) -> DataFrame | None:
    """id of items that have all grams of the term; None if it is too short to have one."""
    low = term.lower()
    own = sorted({low[k : k + 3] for k in range(len(low) - 2)})
    if not own:
        return None
    wanted = spark.createDataFrame([(g,) for g in own], "gram string").select("gram", _bucket(F.col("gram")).alias("bucket")).collect()  # the term's grams
    rows = spark.read.parquet(folder).where(F.col("bucket").isin(sorted({r.bucket for r in wanted})) & F.col("gram").isin(own))
    return rows.groupBy("id").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(own)).select("id")


def search(items: DataFrame, folder: str, term: str, text_col: str = "name", id_col: str = "pos") -> DataFrame:
    """The rows of ``items`` whose text contains the term, in any case: the same as a scan gives."""
    found = candidates(items.sparkSession, folder, term)
    rows = items if found is None else items.join(found.withColumnRenamed("id", id_col), id_col, "left_semi")
    return rows.where(lowered_contains(F.col(text_col), term))
