"""Extraction-only statistics: how often fields are found, speed, success, winners."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldeval.functions.base import count_if, ratio
from fieldeval.functions.values import has_value, quality_rating, speed_rating
from fieldeval.operators.fields import lookup
from fieldeval.operators.shredded import Fields
from fieldeval.schema import Bands, FieldSpec, SpeedBands

PLACES = 9


def field_rates(results: DataFrame, spec: FieldSpec) -> DataFrame:
    """Per model and field of the spec: share of documents with the key and with a value.

    Documents without any field count in the denominators. One pass: the spec is unrolled
    beside each row and counted on the map side before the only shuffle.
    """
    held = Fields(results)
    n_fields = F.coalesce(held.count(), F.lit(0)).alias("n_fields")
    if held.shredded:
        cells = [F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("field"), held.get(n).alias("v")) for i, n, _ in spec.items()]
        rows = results.select("model", n_fields, F.inline(F.array(*cells)))
    else:
        names = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("field")) for i, n, _ in spec.items()])
        rows = results.select("model", "extracted_fields", n_fields, F.inline(names)).select(
            "model", "ordinal", "field", "n_fields", lookup("extracted_fields", F.col("field")).alias("v")
        )
    docs = F.count(F.lit(1))
    present, valued = F.count("v"), count_if(has_value("v", "rates"))
    return rows.groupBy("model", "ordinal", "field").agg(
        docs.alias("total_docs"),
        ratio(F.sum("n_fields"), docs).alias("avg_fields_extracted"),
        present.alias("present_docs"),
        valued.alias("value_docs"),
        ratio(present, docs).alias("present_rate"),
        ratio(valued, docs).alias("value_rate"),
        ratio(valued, present).alias("value_completion"),
    )


def active_fields(rates: DataFrame) -> DataFrame:
    return (
        rates.groupBy("ordinal", "field")
        .agg(F.max("value_rate").alias("best_value_rate"))
        .where(F.col("best_value_rate") > 0)
        .orderBy("ordinal")
    )


def model_quality(results: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Average number of fields per model with its quality band."""
    n = F.coalesce(Fields(results).count(), F.lit(0))
    return (
        results.groupBy("model")
        .agg(F.count(F.lit(1)).alias("total_docs"), F.avg(n).alias("avg_fields_extracted"))
        .withColumn("quality", quality_rating("avg_fields_extracted", bands))
    )


def top_fields(rates: DataFrame, n: int = 5) -> DataFrame:
    """Fields with most values per model; the window sees one row per field of the spec."""
    order = Window.partitionBy("model").orderBy(F.col("value_docs").desc(), "ordinal")
    return rates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def speed_summary(rows: DataFrame, bands: SpeedBands = SpeedBands()) -> DataFrame:
    return (
        rows.groupBy("model")
        .agg(F.avg(F.coalesce("processing_time", F.lit(0.0))).alias("avg_seconds"))
        .withColumn("speed_rating", speed_rating("avg_seconds", bands))
    )


def _lowest(value: str) -> Column:
    return F.min_by("model", F.struct(F.round(value, PLACES), F.col("model")))


def _highest(value: str) -> Column:
    return F.min_by("model", F.struct(-F.round(value, PLACES), F.col("model")))


def speed_advantage(summary: DataFrame) -> DataFrame:
    """Percent by which the faster of exactly two models is faster."""
    slow, fast = F.max("avg_seconds"), F.min("avg_seconds")
    return (
        summary.agg(
            F.count(F.lit(1)).alias("models"),
            _lowest("avg_seconds").alias("faster"),
            slow.alias("slow"),
            fast.alias("fast"),
        )
        .where((F.col("models") == 2) & (F.col("slow") > 0))
        .select("faster", ((F.col("slow") - F.col("fast")) / F.col("slow") * 100).alias("percent_faster"))
    )


def winners(summary: DataFrame, tie_below: float = 1.0) -> DataFrame:
    """Field and speed winners from rows (model, avg_fields_extracted, avg_seconds)."""
    row = summary.agg(
        F.count(F.lit(1)).alias("models"),
        _highest("avg_fields_extracted").alias("top"),
        F.max("avg_fields_extracted").alias("most"),
        F.min("avg_fields_extracted").alias("least"),
        _lowest("avg_seconds").alias("quickest"),
        F.min("avg_seconds").alias("seconds"),
    ).where(F.col("models") > 0)
    tie = (F.col("most") - F.col("least")) < tie_below
    several = F.col("models") >= 2
    return row.select(
        tie.alias("tie"),
        F.when(~tie, F.col("top")).alias("field_winner"),
        F.when(~tie, ratio(F.col("most") - F.col("least"), F.col("least")) * 100).alias(
            "field_advantage"
        ),
        F.when(several, F.col("quickest")).alias("speed_winner"),
        F.when(several, F.col("seconds")).alias("speed_seconds"),
    )


def _success() -> list[Column]:
    n, ok = F.count(F.lit(1)), count_if(F.col("successful"))
    return [
        n.alias("documents"),
        ok.alias("successful"),
        ratio(ok, n).alias("success_rate"),
        F.sum(F.coalesce("processing_time", F.lit(0.0))).alias("execution_time"),
    ]


def model_success(rows: DataFrame) -> DataFrame:
    """Success rate and summed seconds per model; rows without a model are one of them."""
    return rows.groupBy("model").agg(*_success())


def success_metrics(rows: DataFrame, overall: str = "(overall)") -> DataFrame:
    """The same with one extra row over all rows."""
    both = rows.rollup("model").agg(F.grouping("model").alias("__all"), *_success())
    name = F.when(F.col("__all") == 1, overall).otherwise(F.col("model"))
    return both.withColumn("model", name).drop("__all")


def run_overview(rows: DataFrame, verified_images: Column | int) -> DataFrame:
    """Per model success, time per verified image and status; the overall rate is the mean
    of the models' rates. Sorted by total time."""
    images = F.lit(verified_images) if isinstance(verified_images, int) else verified_images
    per = model_success(rows)
    macro = per.agg(F.avg("success_rate")).scalar()
    rate = F.col("success_rate")
    return per.select(
        "model",
        rate,
        "execution_time",
        ratio(F.col("execution_time"), images).alias("time_per_image"),
        F.when(rate >= 0.9, "Excellent").when(rate >= 0.7, "Good").otherwise("Needs Work").alias(
            "status"
        ),
        macro.alias("overall_success_rate"),
    ).orderBy("execution_time", "model")


def field_rate_bands(rates: DataFrame, models: Iterable[str]) -> DataFrame:
    """Rate and band per field and model; null for a model without rows."""
    names = list(models)
    rate = F.coalesce("value_rate", "present_rate", F.lit(0.0))
    wide = rates.groupBy("ordinal", "field").pivot("model", names).agg(F.max(rate))

    def band(c: str) -> Column:
        v = F.col(c)
        return (
            F.when(v >= 0.9, "excellent")
            .when(v >= 0.7, "good")
            .when(v >= 0.5, "fair")
            .when(v.isNotNull(), "poor")
        )

    cells = [x for m in names for x in (F.col(m).alias(f"{m}_rate"), band(m).alias(f"{m}_band"))]
    return wide.select("ordinal", "field", *cells)


def method_distribution(results: DataFrame) -> DataFrame:
    """Count, share and success rate per extraction method."""
    n, ok = F.count(F.lit(1)), count_if(F.col("successful"))
    per = results.groupBy("extraction_method").agg(
        n.alias("documents"), ratio(ok, n).alias("success_rate")
    )
    # One row per method: a subquery for their sum would label all responses once more.
    total = F.sum("documents").over(Window.partitionBy(F.lit(1)))
    return per.withColumn("share", ratio(F.col("documents"), total))


def truth_verdict(validated: DataFrame, severe_above: float = 0.1) -> DataFrame:
    n, issues = F.count(F.lit(1)), count_if(F.col("status") != "valid")
    return validated.agg(
        n.alias("total_rows"),
        count_if(F.col("status") == "valid").alias("valid_rows"),
        count_if(F.col("status") == "invalid").alias("invalid_rows"),
        count_if(F.col("status") == "missing_image").alias("missing_images"),
        count_if(F.col("status") == "path_mismatch").alias("path_mismatches"),
        (issues == 0).alias("passed"),
        (issues > n * severe_above).alias("severe"),
    )


def dataset_summary(files: DataFrame) -> DataFrame:
    n, good = F.count(F.lit(1)), count_if(F.col("verified"))
    return files.agg(
        n.alias("expected"),
        good.alias("found"),
        (n - good).alias("missing"),
        ratio(good, n).alias("found_rate"),
    )


def normalise_runs(
    rates: DataFrame, success: DataFrame, spec: FieldSpec, total_images: Column | int
) -> DataFrame:
    """Extraction statistics in the shape of an evaluation: value rates stand in for
    accuracies, fields without a rate count as 0."""
    images = F.lit(total_images) if isinstance(total_images, int) else total_images
    acc = F.coalesce("value_rate", "present_rate", F.lit(0.0))
    per = rates.where(F.col("field").isin(*spec.names)).groupBy("model").agg(
        (F.sum(acc) / len(spec)).alias("avg_accuracy"),
        count_if(acc > 0).alias("fields_with_data"),
        F.max("avg_fields_extracted").alias("avg_fields_extracted"),
    )
    return success.join(per, "model", "left").select(
        "model",
        "success_rate",
        F.col("execution_time").alias("total_processing_time"),
        ratio(F.col("execution_time"), images).alias("avg_processing_time"),
        F.coalesce("avg_accuracy", F.lit(0.0)).alias("avg_accuracy"),
        F.coalesce("fields_with_data", F.lit(0)).alias("fields_with_data"),
        F.coalesce("avg_fields_extracted", F.lit(0.0)).alias("avg_fields_extracted"),
    )
