"""Writers. Rows stay distributed: each task writes its own files.

Batches of rows are written through `batches`, so a repeated or retried call with the same
`batch_id` adds nothing and a killed one leaves nothing that is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldeval.operators.runs import batch_summary
from fieldeval.sources.batches import Batch, read_published, write_batch

#: White space around values is part of them.
_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
_TOTALS = (
    "model string, total_images long, successful_extractions long, failed_extractions long, processing_time double, "
    "success_rate double"
)


def write_wide_csv(wide: DataFrame, path: str, mode: str = "errorifexists") -> None:
    wide.write.mode(mode).options(**_CSV).csv(path)


def csv_path(directory: str, stem: str, model: str | None) -> str:
    """Default output path; the model name must be known."""
    if not model:
        raise ValueError("model name is unknown; pass it explicitly")
    return f"{directory.rstrip('/')}/{stem}_{model}_dataframe.csv"


def write_json_lists(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON files that each hold a list of rows: the array layout of batch results."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"value": ["["]})
        first = True
        for batch in batches:
            texts = batch.column(0)
            if len(texts):
                if first:
                    yield pa.RecordBatch.from_arrays([texts.slice(0, 1)], ["value"])
                    texts, first = texts.slice(1), False
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(",", texts, "")], ["value"])
        yield pa.RecordBatch.from_pydict({"value": ["]"]})

    rows.select(F.to_json(F.struct(*rows.columns))).mapInArrow(lines, "value string").write.mode(mode).text(path)


def write_batch_results(results: DataFrame, path: str, batch_id: str | None = None) -> bool:
    """Rows as JSON by outcome (`results`, `failed_images`), and `totals` of them per model.

    The rows are written once, in one pass over the input, and not collected into one document,
    which would go through a single task; totals are taken from what was written, so they agree
    with it even where the input would come out otherwise a second time. A result not known to
    be successful is a failed one.
    """

    def write(batch: Batch) -> None:
        ok = F.coalesce("successful", F.lit(False))
        held = results.withColumn("successful", ok)
        outcome = F.when(ok, "results").otherwise("failed_images")
        held.withColumn("outcome", outcome).write.partitionBy("outcome").json(batch.place("rows"))
        wanted = "model string, successful boolean, processing_time double"
        written = held.sparkSession.read.schema(wanted).json(batch.place("rows"))
        batch_summary(written).write.json(batch.place("totals"))

    return write_batch(results.sparkSession, path, batch_id, write)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Successful rows of the published batches, by the schema of what was written."""
    rows = read_published(spark, path, "rows", schema=f"{schema}, outcome string")
    return rows.where(F.col("outcome") == "results").drop("outcome")


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """(model, image, error, batch) of rows that are not successful."""
    rows = read_published(spark, path, "rows", schema="model string, doc_id string, error string, outcome string")
    failed = rows.where(F.col("outcome") == "failed_images")
    return failed.select("model", F.col("doc_id").alias("image"), "error", "batch")


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """Totals per batch and model."""
    return read_published(spark, path, "totals", schema=_TOTALS)


def write_comparison_results(rows: DataFrame, path: str, batch_id: str | None = None) -> bool:
    """JSON rows partitioned by model, so one model's rows can be read alone."""

    def write(batch: Batch) -> None:
        rows.write.partitionBy("model").json(batch.place())

    return write_batch(rows.sparkSession, path, batch_id, write)


def append_truth(
    mapped: DataFrame, source: DataFrame, path: str, key: str = "doc_id", batch_id: str | None = None
) -> bool:
    """Append truth rows as CSV and a JSON record of source, truth and time per document.

    Both tables belong to one batch, so they are published together.
    """

    def write(batch: Batch) -> None:
        mapped.write.options(**_CSV).csv(batch.place("truth"))
        truth = mapped.select(key, F.struct(*mapped.columns).alias("ground_truth"))
        record = source.select(key, F.struct(*source.columns).alias("source")).join(truth, key)
        record.withColumn("generated_at", F.current_timestamp()).write.json(batch.place("records"))

    return write_batch(mapped.sparkSession, path, batch_id, write)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Truth rows of the published batches, as texts."""
    return read_published(spark, path, "truth", "csv", multiLine=True, **_CSV)
