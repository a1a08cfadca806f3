"""Continuous update: each micro-batch of individuals rewrites the buckets of names that it touches.

The table is a folder of versions; a version holds some of ``BUCKETS`` parts, by a hash of the name,
and a part's newest version counts.  A version is named after the stream and the micro-batch that
made it, so a batch that is run again is seen and left out, and a stream with a new checkpoint goes
on from what is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinmap.operators.links import cut_to, remove
from veinmap.operators.update import add_individuals, changes, judged

COLUMNS = "pos long, name string, attrs map<string,string>"
BUCKETS = 64


def _bucket():
    return F.pmod(F.xxhash64(F.coalesce("name", F.lit(""))), F.lit(BUCKETS)).cast("int").alias("bucket")


def _listed(spark: SparkSession, folder: str) -> dict[str, list[int]]:
    """Complete versions (their names begin with their number), oldest first, and the buckets of each."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path(folder))]
    done = sorted((n for n in names if n.startswith("version=") and fs.exists(path(f"{folder}/{n}/_SUCCESS"))), key=_number)
    return {n: [int(s.getPath().getName()[7:]) for s in fs.listStatus(path(f"{folder}/{n}")) if s.getPath().getName().startswith("bucket=")] for n in done}


def _number(name: str) -> int:
    return int(name.split("=")[1].split("-")[0])


def current(spark: SparkSession, folder: str, buckets: set[int] | None = None) -> DataFrame:
    """The newest rows, of all buckets or of some."""
    newest = {b: name for name, own in _listed(spark, folder).items() for b in own if buckets is None or b in buckets}
    return spark.read.schema(COLUMNS).parquet(*(f"{folder}/{name}/bucket={b}" for b, name in newest.items())) if newest else spark.createDataFrame([], COLUMNS)


def _write(rows: DataFrame, path: str) -> None:
    rows.select("pos", "name", "attrs", _bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def start(existing: DataFrame, folder: str) -> None:
    """Writes the first version."""
    _write(existing, f"{folder}/version=0-start")


def follow(stream: DataFrame, folder: str, checkpoint: str):
    """Applies a stream (pos, name, attrs) batch by batch."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId')}-{number}"
        listed = _listed(spark, folder)
        if any(name.endswith(own) for name in listed):
            return
        touched = {r.bucket for r in batch.select(_bucket()).distinct().collect()}  # BUCKETS at most
        before, version = current(spark, folder, touched), 1 + max(map(_number, listed))
        actions, path = cut_to(judged(before, batch), "judged")  # once, for both outputs
        changes(before, batch, actions=actions).write.mode("overwrite").parquet(f"{folder}/changes={version}-{own}")
        _write(add_individuals(before, batch, actions=actions), f"{folder}/version={version}-{own}")
        remove(spark, path)  # a stream goes on for long: a batch leaves only its version

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(spark: SparkSession, folder: str) -> None:
    """Writes all buckets as one version; older ones are no longer read and may be removed."""
    _write(current(spark, folder), f"{folder}/version={1 + max(map(_number, _listed(spark, folder)))}-compact")


def vacuum(spark: SparkSession, folder: str) -> list[str]:
    """Removes the versions that no bucket reads any more, but for the last; gives their names.

    A reader that began before may still read them: call it when none does.
    """
    listed = _listed(spark, folder)
    used = {b: name for name, own in listed.items() for b in own}
    path = spark._jvm.org.apache.hadoop.fs.Path
    gone = sorted(set(listed) - set(used.values()) - {max(listed, key=_number)}) if listed else []
    for name in gone:
        path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(f"{folder}/{name}"), True)
    return gone
