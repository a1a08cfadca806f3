"""Helpers that several operators share: Arrow batch mapping and cutting of lineage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from veinmap.operators.links import components, cut, cut_free, cut_to, remove

#: Rows, and bytes of them, handled at a time inside a task, whatever the size of Arrow's batches.
ROWS_AT_ONCE, BYTES_AT_ONCE = 256, 8 << 20


def fresh(df: DataFrame, name: str) -> str:
    """A name like ``name`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ROWS_AT_ONCE rows and about BYTES_AT_ONCE bytes (one row at least)."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
            sizes += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        fits = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES_AT_ONCE, "right")) - at
        n = min(ROWS_AT_ONCE, max(1, fits))
        yield batch.slice(at, n)
        at += n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def parsed(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def map_rows(df: DataFrame, columns: list[str], ddl: str, start: Callable[[], Callable[..., list[list]]]) -> DataFrame:
    """Maps ``columns`` of ``df`` to rows of ``ddl``, Arrow batch by Arrow batch.

    ``start`` runs once in each task (it loads tables); what it returns gets lists of column
    values, a slice at a time, and gives back the output's columns as lists.
    """
    schema = to_arrow_schema(parsed(ddl), prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            for part in pieces(batch):
                out = step(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, schema.types, strict=True)], schema=schema)

    return df.select(*columns).mapInArrow(run, ddl)


def keep_rows(df: DataFrame, column: str, start: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows of ``df``, all columns untouched, for whose ``column`` the function that ``start`` gives says so."""

    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = start()
        for batch in batches:
            for part in pieces(batch):
                yield part.filter(pa.array(keep(part.column(names.index(column)).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def rewrite_rows(df: DataFrame, column: str, start: Callable[[], Callable[[list], list[tuple[bool, str | None]]]]) -> DataFrame:
    """The rows of ``df`` that the function that ``start`` gives keeps, with its new value of the string ``column``."""

    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = start()
        for batch in batches:
            for part in pieces(batch):
                found = change(part.column(at).to_pylist())
                columns = [pa.array([new for _, new in found], pa.string()) if i == at else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, part.schema.names).filter(pa.array([kept for kept, _ in found], pa.bool_()))

    return df.mapInArrow(run, df.schema)


#: A side with at most so many narrow rows (of up to some 100 bytes) is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000


def join_few(many: DataFrame, few: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Joins narrow rows ``few`` that are already written: broadcast if counted as few, else shuffled."""
    n = few.count()
    return many.join(F.broadcast(few) if n <= BROADCAST_ROWS else few, on, how)


def sorted_groups(df: DataFrame, key: str, order: list[str], columns: list[str], ddl: str, start: Callable[[], Callable[..., list[list]]]) -> DataFrame:
    """Maps the rows of each ``key`` (a bounded group) to rows of ``ddl``, groups streaming through a task.

    ``start`` gives a function of (key, one list per column).
    """
    schema = to_arrow_schema(parsed(ddl), prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, now, held = start(), None, [[] for _ in columns]

        def ended() -> Iterator[pa.RecordBatch]:
            if held[0]:
                out = step(now, *held)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, schema.types, strict=True)], schema=schema)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            at = 0
            while at < len(keys):
                if keys[at] != now:
                    yield from ended()
                    now, held = keys[at], [[] for _ in columns]
                to = at + 1
                while to < len(keys) and keys[to] == now:
                    to += 1
                for h, c in zip(held, batch.columns[1:], strict=True):
                    h += c.slice(at, to - at).to_pylist()
                at = to
        yield from ended()

    return df.repartition(F.col(key)).sortWithinPartitions(key, *order).select(key, *columns).mapInArrow(run, ddl)


__all__ = ["components", "cut", "cut_free", "cut_to", "fresh", "join_few", "keep_rows", "map_rows", "parsed", "pieces", "remove", "rewrite_rows", "sorted_groups", "table"]
