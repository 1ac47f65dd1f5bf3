"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows of a batch that are Python objects at a time.
SLICE = 128


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share; a fresh local one only where none is set."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir is None:
        set_dir = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", set_dir)
    return set_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """The frame with columns of these names (in any case) renamed, and how to name them back."""
    back = {f"own_{k}_{name}": name for k, name in enumerate(df.columns) if name.lower() in names}
    return df.withColumnsRenamed({name: new for new, name in back.items()}), back


def with_fields(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    """The frame's schema with further fields."""
    return T.StructType([*df.schema.fields, *(T.StructField(name, kind) for name, kind in fields)])


def utf8(column: str) -> Column:
    """Text as its bytes, null as no bytes: Python then gets the buffer undecoded."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, ...]]:
    """Rows of Arrow batches as tuples, few of them as Python objects at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, SLICE):
            part = batch.slice(low, SLICE)
            yield from zip(*(column.to_pylist() for column in part.columns))


def chunks(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[list[tuple[Any, ...]]]:
    """Rows in lists of about `size` bytes in the given column (a longer row stands alone)."""
    rows: list[tuple[Any, ...]] = []
    held = 0
    for row in records(batches):
        rows.append(row)
        held += len(row[column])
        if held >= size:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: int, most: int) -> Iterator[tuple[pa.Table, bool]]:
    """(table, hot) from rows sorted by their first `keys` columns.

    A table that isn't hot holds whole runs of equal keys, each of `most` rows or fewer; rows
    of longer runs come in tables marked hot, in pieces, so a run is never held whole.
    """
    held: pa.Table | None = None
    going: list[object] | None = None  # the key of a hot run that may go on
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if going is not None:
            same = np.ones(table.num_rows, bool)
            for k, value in enumerate(going):
                same &= table.column(k).to_numpy() == value
            more = int(same.sum())
            if more:
                yield table.slice(0, more), True
            table = table.slice(more)
        if not table.num_rows:
            continue
        going = None
        table = table if held is None else pa.concat_tables([held, table])
        new = np.ones(table.num_rows, bool)
        for k in range(keys):
            column = table.column(k).to_numpy()
            new[1:] &= column[1:] == column[:-1]
        starts = np.flatnonzero(~new | (np.arange(table.num_rows) == 0))
        sizes = np.diff(np.append(starts, table.num_rows))
        end = int(starts[-1])
        long = np.repeat(sizes > most, sizes)
        if long.any():
            yield table.filter(pa.array(long)), True
            if (rest := ~long[:end]).any():
                yield table.slice(0, end).filter(pa.array(rest)), False
        elif end:
            yield table.slice(0, end), False
        held = table.slice(end) if sizes[-1] <= most else None
        if held is None:
            going = [table.column(k)[table.num_rows - 1].as_py() for k in range(keys)]
    if held is not None:
        yield held, False


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1] or 0


def _local_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of each batch replaced by one star per tree: same components, fewer and flatter."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        found = [(x, root(x)) for x in list(parent)]
        found = [(x, r) for x, r in found if x != r]
        yield pa.RecordBatch.from_pydict(
            {"u": pa.array([x for x, _ in found], pa.int64()), "v": pa.array([r for _, r in found], pa.int64())}
        )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v): root is the smallest node it reaches.

    Alternating large-star and small-star rounds. Each round is two aggregates with map-side
    combine and two joins whose hot sides adaptive execution can split; a round's edges are
    written to the shared folder, so its lineage ends there. Roots themselves are included.
    Edges from a node to itself are ignored; no edges give no rows.
    """
    edges = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    edges = written(edges.mapInArrow(_local_forests, "u long, v long"), "edges")
    last: tuple[int, int] | None = None
    while (now := _state(edges)) != last:
        last = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        )
        edges = written(small.select("col.*").where("u <> v").distinct(), "small")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
