"""Tables behind charts: dashboards, categories, capacity and sizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldeval import schema as S
from fieldeval.functions.base import ratio
from fieldeval.functions.values import capacity_status
from fieldeval.operators.fields import weight_of
from fieldeval.schema import Bands, FieldSpec, SpeedBands


def dashboard_series(
    summary: DataFrame,
    spec: FieldSpec,
    bands: Bands = Bands(),
    speed: SpeedBands = SpeedBands(),
) -> DataFrame:
    """Percentages, throughput per minute and the reference lines per model."""

    def per_minute(seconds: float) -> Column:
        return F.lit(60.0 / seconds if seconds > 0 else 0.0)

    return summary.select(
        "model",
        (F.col("avg_accuracy") * 100).alias("accuracy_percent"),
        ratio(F.lit(60.0), F.greatest("avg_processing_time", F.lit(0.0))).alias("throughput"),
        (F.col("success_rate") * 100).alias("success_percent"),
        F.coalesce("fields_with_data", "avg_fields_extracted").cast("double").alias("fields"),
        F.lit(bands.excellent / len(spec) * 100).alias("excellent_line"),
        per_minute(speed.very_fast).alias("very_fast_line"),
        per_minute(speed.fast).alias("fast_line"),
        per_minute(speed.moderate).alias("moderate_line"),
    )


def weight_category(weight: Column) -> Column:
    """Everything that is neither above 1.1 nor exactly 1.0 is of lower priority."""
    return (
        F.when(weight > 1.1, "High Priority").when(weight == 1.0, "Standard").otherwise(
            "Lower Priority"
        )
    )


def category_accuracy(field_acc: DataFrame, spec: FieldSpec) -> DataFrame:
    """Mean percent per weight category and model; categories without fields have no row."""
    weight = F.coalesce(weight_of("field", spec), F.lit(1.0))
    return (
        field_acc.where(F.col("field").isin(*spec.names))
        .groupBy(weight_category(weight).alias("category"), "model")
        .agg((F.avg("accuracy") * 100).alias("percent"))
    )


def top_matrix(field_acc: DataFrame, n: int = 12) -> DataFrame:
    """Rows of the ``n`` fields with the highest mean over models."""
    top = (
        field_acc.groupBy("ordinal", "field")
        .agg(F.round(F.avg("accuracy"), 9).alias("mean"))
        .orderBy(F.col("mean").desc(), "ordinal")
        .limit(n)
    )
    return field_acc.join(top.select("field"), "field", "left_semi")


def capacity_report(
    usage: DataFrame, limit: float = S.GPU_LIMIT_GB, margin: float = S.GPU_SAFETY_MARGIN
) -> DataFrame:
    return usage.select(
        "model",
        "memory_gb",
        capacity_status("memory_gb", limit, margin).alias("status"),
        (F.col("memory_gb") / limit * 100).alias("utilisation"),
    )


def spread_peak(models: DataFrame, combined: DataFrame) -> DataFrame:
    """Without figures per model one GPU peak is split equally; none if it is not positive."""
    peak = combined.agg(F.max("peak_gpu_gb")).scalar()
    count = models.agg(F.count(F.lit(1))).scalar()
    return models.select("model", (peak / count).alias("memory_gb")).where(
        F.col("memory_gb") > 0
    )


def sizing_advice(usage: DataFrame, combined: DataFrame, limit: float = S.GPU_LIMIT_GB) -> DataFrame:
    """Requests and limits per model from the combined process memory figures."""
    avg = F.coalesce(combined.agg(F.max("avg_process_gb")).scalar(), F.lit(0.0))
    peak = F.coalesce(combined.agg(F.max("peak_process_gb")).scalar(), F.lit(0.0))
    rows = usage.withColumn("avg_gb", avg).withColumn("peak_gb", peak)

    def at_least(low: int | Column, value: Column) -> Column:
        floor = F.lit(low) if isinstance(low, int) else low
        return F.greatest(floor.cast("int"), value.cast("int"))

    fits = F.col("memory_gb") <= limit
    request = at_least(4, F.col("peak_gb") * 1.1)
    return rows.select(
        "model",
        at_least(2, F.col("avg_gb") * 1.2).alias("cpu_request"),
        at_least(4, F.col("peak_gb") * 1.5).alias("cpu_limit"),
        request.alias("memory_request_gb"),
        at_least(request + 1, F.col("peak_gb") * 1.3).alias("memory_limit_gb"),
        F.when(fits, "V100").otherwise("A100").alias("gpu_class"),
        F.when(fits, 2.50).otherwise(4.00).alias("dollars_per_hour"),
        F.when(F.col("memory_gb") <= limit * S.GPU_SAFETY_MARGIN, "fits")
        .when(fits, "tight")
        .otherwise("needs larger GPU")
        .alias("advice"),
    )
