"""Appends that can be repeated: rows are staged first and made known by one small file last.

A batch of rows has an id. Its tables are written below `table/batch=<id>/attempt=<random>`; then
one row with the attempt is written below `_manifest/batch=<id>`, which a rename of one file
publishes. Readers take, of every batch, the rows of the attempt that was published first, so

- a write that is killed leaves files that nobody reads,
- a batch that is written again, by a retry or side by side, counts once.

Everything goes through Spark's readers and writers, so paths may be in any store.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ID = re.compile(r"[A-Za-z0-9_.-]{1,200}")
_MANIFEST = "attempt string, published timestamp"
#: Partition values get a letter in front, so that Spark reads none of them as a number.
_PLACE = ("batch", "attempt")


class Batch:
    """One attempt to write a batch: `place` names where its tables go, `publish` ends it."""

    def __init__(self, spark: SparkSession, path: str, batch_id: str | None = None) -> None:
        name = uuid.uuid4().hex if batch_id is None else batch_id
        if not _ID.fullmatch(name):
            raise ValueError(f"batch ids are letters, digits, dots, lines: {name!r}")
        self.spark, self.path = spark, path.rstrip("/")
        self.batch, self.attempt = f"b-{name}", f"a-{uuid.uuid4().hex}"

    def place(self, table: str = "") -> str:
        below = f"{self.path}/{table}" if table else self.path
        return f"{below}/batch={self.batch}/attempt={self.attempt}"

    def known(self) -> bool:
        """Whether an attempt at this batch has been published."""
        found = _manifest(self.spark, f"{self.path}/_manifest/batch={self.batch}")
        return found is not None and bool(found.head(1))

    def publish(self) -> None:
        row = self.spark.range(1).select(F.lit(self.attempt).alias("attempt"), F.current_timestamp().alias("published"))
        row.coalesce(1).write.mode("append").json(f"{self.path}/_manifest/batch={self.batch}")


def write_batch(spark: SparkSession, path: str, batch_id: str | None, write: Callable[[Batch], None]) -> bool:
    """Stage a batch by `write` and publish it; nothing is written where it is known already.

    Without an id every call is a batch of its own. Returns whether rows were written.
    """
    batch = Batch(spark, path, batch_id)
    if batch_id is not None and batch.known():
        return False
    write(batch)
    batch.publish()
    return True


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_MANIFEST).json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """(batch, attempt) that count: the first published attempt of every batch; null where no
    batch was ever published."""
    rows = _manifest(spark, f"{path.rstrip('/')}/_manifest")
    if rows is None:
        return None
    batch = F.regexp_extract(F.col("_metadata.file_path"), "/batch=([^/]+)/", 1)
    first = F.min_by("attempt", F.struct("published", "attempt"))
    return rows.groupBy(batch.alias("batch")).agg(first.alias("attempt"))


def read_published(
    spark: SparkSession, path: str, table: str = "", kind: str = "json", schema: str | None = None, **options: object
) -> DataFrame:
    """Rows of a table's published batches, with `batch`, the id they were written with.

    Files of attempts that do not count are left out by their folder. Without any published
    batch there are no rows, and a schema must be given.
    """
    reader = spark.read.format(kind).options(**options)
    if schema is not None:
        reader = reader.schema(f"{schema}, batch string, attempt string")
    known = published(spark, path)
    if known is None:
        if schema is None:
            raise ValueError(f"nothing is published at {path}, and no schema is given")
        return spark.createDataFrame([], f"{schema}, batch string")
    rows = reader.load(f"{path.rstrip('/')}/{table}" if table else path)
    counted = rows.join(known, list(_PLACE), "left_semi").drop("attempt")
    return counted.withColumn("batch", F.substring("batch", 3, 200))
