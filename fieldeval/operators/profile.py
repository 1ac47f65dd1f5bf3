"""What the reports on extraction need of a run, from one aggregate.

A run's reports look at models (how often they succeed, how fast they are, how many fields they
find) and at fields (how often each is found). Both come from one aggregate with grouping sets,
so a report that shows both reads the results once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldeval.functions.base import count_if, ratio
from fieldeval.functions.values import has_value, quality_rating, speed_rating
from fieldeval.operators.shredded import Fields
from fieldeval.schema import Bands, FieldSpec, SpeedBands


def _of_result(results: DataFrame) -> list[Column]:
    """What a model's figures are summed up from, of each result."""
    held = Fields(results)
    return [
        F.col("model"),
        F.coalesce("successful", F.lit(False)).alias("ok"),
        F.coalesce("processing_time", F.lit(0.0)).alias("seconds"),
        F.coalesce(held.count(), F.lit(0)).alias("n_fields"),
        held.count_where(lambda v: has_value(v, "strict")).alias("filled"),
    ]


def run_models(results: DataFrame) -> DataFrame:
    """The rows of ``run_profile`` that have no field: for reports on models alone, no field is unrolled."""
    return results.select(*_of_result(results)).groupBy("model").agg(
        F.count(F.lit(1)).alias("documents"),
        count_if(F.col("ok")).alias("successful"),
        F.sum("seconds").alias("execution_time"),
        F.sum("n_fields").alias("n_fields"),
        F.avg("filled").alias("non_na_fields"),
        F.lit(1).alias("of_model"),
    )


def run_profile(results: DataFrame, spec: FieldSpec) -> DataFrame:
    """One row per model, with field and ordinal null, and one per model and field of the spec.

    What belongs to a document is counted once for it, on the row of its first field.
    """
    held = Fields(results)
    cells = [F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("field"), held.get(n).alias("v")) for i, n, _ in spec.items()]
    rows = results.select(*_of_result(results), F.inline(F.array(*cells)))
    first = F.col("ordinal") == 1
    documents = F.when(F.grouping("field") == 1, count_if(first)).otherwise(F.count(F.lit(1)))
    return rows.groupingSets([["model"], ["model", "ordinal", "field"]], "model", "ordinal", "field").agg(
        documents.alias("documents"),
        count_if(first & F.col("ok")).alias("successful"),
        F.coalesce(F.sum(F.when(first, F.col("seconds"))), F.lit(0.0)).alias("execution_time"),
        F.sum(F.when(first, F.col("n_fields"))).alias("n_fields"),
        F.avg(F.when(first, F.col("filled"))).alias("non_na_fields"),
        F.count("v").alias("present_docs"),
        count_if(has_value("v", "rates")).alias("value_docs"),
        F.grouping("field").alias("of_model"),
    )


def _models(profile: DataFrame) -> DataFrame:
    return profile.where(F.col("of_model") == 1)


def model_profile(profile: DataFrame, bands: Bands = Bands(), speed: SpeedBands = SpeedBands()) -> DataFrame:
    """Per model: documents, success, seconds, fields, and the ratings of the last two."""
    fields = ratio(F.col("n_fields"), F.col("documents"))
    seconds = ratio(F.col("execution_time"), F.col("documents"))
    named = _models(profile).select(
        "model",
        "documents",
        "successful",
        ratio(F.col("successful"), F.col("documents")).alias("success_rate"),
        "execution_time",
        seconds.alias("avg_seconds"),
        fields.alias("avg_fields_extracted"),
        "non_na_fields",
    )
    return named.withColumns({"quality": quality_rating("avg_fields_extracted", bands), "speed_rating": speed_rating("avg_seconds", speed)})


def normalise_profile(profile: DataFrame, spec: FieldSpec, total_images: Column | int) -> DataFrame:
    """Extraction statistics in the shape of an evaluation: value rates stand in for accuracies.

    As `rates.normalise_runs`, from the profile alone: its rows, one per model and field, are
    brought together by model.
    """
    images = F.lit(total_images) if isinstance(total_images, int) else total_images
    of_field = F.col("of_model") == 0
    acc = ratio(F.col("value_docs"), F.col("documents"))

    def model(name: str) -> Column:
        return F.max(F.when(~of_field, F.col(name)))

    per = profile.groupBy("model").agg(
        ratio(model("successful"), model("documents")).alias("success_rate"),
        model("execution_time").alias("total_processing_time"),
        (F.sum(F.when(of_field, acc)) / len(spec)).alias("avg_accuracy"),
        count_if(of_field & (acc > 0)).alias("fields_with_data"),
        ratio(model("n_fields"), model("documents")).alias("avg_fields_extracted"),
    )
    seconds = ratio(F.col("total_processing_time"), images).alias("avg_processing_time")
    return per.select(
        "model", "success_rate", "total_processing_time", seconds, "avg_accuracy", "fields_with_data", "avg_fields_extracted"
    )
