"""Weighted extraction capability per model, ranking and comparison with the best."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldeval.functions.base import count_if, is_in, ratio
from fieldeval.operators.fields import weight_of
from fieldeval.operators.shredded import Fields
from fieldeval.schema import FieldSpec

CRITICAL_WEIGHT = 0.8
COMPONENTS = (
    "critical_field_coverage",
    "information_density",
    "weighted_extraction_score",
    "extraction_completeness",
)


def extraction_capability(rows: DataFrame, spec: FieldSpec) -> DataFrame:
    """Rows need model, successful, extraction_time, extracted_fields and optionally
    field_count and core_fields_found. Scores are taken inside each row, then averaged."""
    held = Fields(rows)
    critical = [n for n, w in zip(spec.names, spec.weights) if w >= CRITICAL_WEIGHT]
    names = F.transform(held.searched_keys(), F.upper)
    known = F.filter(names, lambda k: k.isin(*spec.names))
    # Fields with a column of their own are counted by it; only the others are searched.
    own = {n: held.get(n).isNotNull().cast("int") for n in held.names if n.upper() in spec.names}
    weights = dict(zip(spec.names, spec.weights))
    n_known = sum(own.values(), F.size(known))
    n_critical = sum((c for n, c in own.items() if n.upper() in critical), F.size(F.filter(known, lambda k: is_in(k, critical))))
    weight = F.aggregate(known, F.lit(0.0), lambda acc, k: acc + weight_of(k, spec))
    weight = sum((c * weights[n.upper()] for n, c in own.items()), weight)
    given = F.col("field_count") if "field_count" in rows.columns else F.lit(None).cast("int")
    count = F.coalesce(given, held.count())
    core = F.col("core_fields_found") if "core_fields_found" in rows.columns else F.lit(0)
    covered = n_critical / len(critical) if critical else F.lit(1.0)
    per_row = rows.select(
        "model",
        F.coalesce("successful", F.lit(False)).alias("ok"),
        F.coalesce("extraction_time", F.lit(0.0)).alias("seconds"),
        F.coalesce(count, F.lit(0)).alias("n_fields"),
        F.coalesce(core, F.lit(0)).alias("n_core"),
        (F.coalesce(weight, F.lit(0.0)) / sum(spec.weights)).alias("weighted"),
        F.coalesce(covered, F.lit(0.0)).alias("critical"),
        ratio(F.coalesce(n_known, F.lit(0)), F.coalesce(count, F.lit(0))).alias("density"),
        (F.coalesce(n_known, F.lit(0)) / len(spec)).alias("complete"),
    )
    n = F.count(F.lit(1))
    return per_row.groupBy("model").agg(
        n.alias("total_images"),
        count_if(F.col("ok")).alias("successful_extractions"),
        F.sum("n_fields").alias("total_fields_extracted"),
        F.sum("n_core").alias("total_core_fields_found"),
        ratio(count_if(F.col("ok")), n).alias("success_rate"),
        F.avg("n_fields").alias("avg_fields_per_image"),
        F.avg("n_core").alias("avg_core_fields_per_image"),
        (F.avg("n_fields") * ratio(count_if(F.col("ok")), n)).alias("capability"),
        F.avg("weighted").alias("weighted_extraction_score"),
        F.avg("critical").alias("critical_field_coverage"),
        F.avg("density").alias("information_density"),
        F.avg("complete").alias("extraction_completeness"),
        F.avg("seconds").alias("average_inference_time"),
    )


def capability_ranking(capability: DataFrame) -> DataFrame:
    return capability.select("model", "capability").orderBy(F.col("capability").desc(), "model")


def capability_breakdown(capability: DataFrame) -> DataFrame:
    """Each model beside the best one, which enters as a one-row scalar subquery.

    ``strengths`` is filled for the best model, the comparison columns for the others.
    """
    held = ("model", "capability", *COMPONENTS)
    best_row = capability.agg(
        F.min_by(
            F.struct(*held), F.struct(-F.round("capability", 9), F.col("model"))
        )
    ).scalar()
    rows = capability.withColumn("best", best_row)
    several = rows.agg(F.count(F.lit(1))).scalar() >= 2
    best = F.col("best")
    is_best = F.col("model") == best["model"]
    other = several & ~is_best
    gap = best["capability"] - F.col("capability")
    strengths = F.array_compact(
        F.array(
            F.when(F.col("critical_field_coverage") >= 0.8, F.lit("critical_field_coverage")),
            F.when(F.col("information_density") >= 0.7, F.lit("information_density")),
            F.when(F.col("weighted_extraction_score") >= 0.6, F.lit("weighted_extraction_score")),
        )
    )
    advantages = F.array_compact(
        F.array(*[F.when(F.round(best[c] - F.col(c), 9) >= 0.1, F.lit(c)) for c in COMPONENTS])
    )
    return rows.select(
        "model",
        "total_images",
        "capability",
        *COMPONENTS,
        is_best.alias("is_best"),
        F.when(several & is_best, F.array_join(strengths, ", ")).alias("strengths"),
        F.when(other, gap).alias("capability_gap"),
        F.when(other, ratio(gap, F.col("capability"), None) * 100).alias("percent_better"),
        F.when(other, F.array_join(advantages, ", ")).alias("best_model_advantages"),
    )
