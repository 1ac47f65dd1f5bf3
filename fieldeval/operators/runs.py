"""Reports over operational tables: batches, benchmarks, memory snapshots, validation runs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldeval.functions.base import count_if, ratio

MIN_SNAPSHOTS = 3


def _known(flag: str) -> Column:
    """The flag, false where it is null: totals count such rows as failed."""
    return F.coalesce(flag, F.lit(False))


def batch_summary(results: DataFrame) -> DataFrame:
    n, ok = F.count(F.lit(1)), count_if(F.col("successful"))
    return results.groupBy("model").agg(
        n.alias("total_images"),
        ok.alias("successful_extractions"),
        (n - ok).alias("failed_extractions"),
        F.coalesce(F.sum(F.when(F.col("successful"), F.col("processing_time"))), F.lit(0.0)).alias(
            "processing_time"
        ),
        ratio(ok, n).alias("success_rate"),
    )


def first_failures(results: DataFrame, n: int = 5) -> DataFrame:
    """The report shows the first ``n`` failures only."""
    failed = results.where(~_known("successful")).select("model", "doc_id", "error")
    return failed.orderBy("doc_id", "model").limit(n)


def benchmark_iterations(runs: DataFrame) -> DataFrame:
    """Per model and iteration; seconds count over successful calls, 0 where there are none."""
    n, ok = F.count(F.lit(1)), F.col("ok")
    seconds = F.when(ok, F.col("processing_time"))
    zero = F.lit(0.0)
    return runs.groupBy("model", "iteration").agg(
        F.sum("processing_time").alias("total_time"),
        count_if(ok).alias("successful_extractions"),
        (n - count_if(ok)).alias("failed_extractions"),
        ratio(count_if(ok), n).alias("success_rate"),
        F.coalesce(F.avg(seconds), zero).alias("avg_processing_time"),
        F.coalesce(F.min(seconds), zero).alias("min_processing_time"),
        F.coalesce(F.max(seconds), zero).alias("max_processing_time"),
    )


def benchmark_summary(iterations: DataFrame) -> DataFrame:
    return iterations.groupBy("model").agg(
        F.count(F.lit(1)).alias("iterations"),
        F.avg("total_time").alias("avg_iteration_time"),
        F.min("total_time").alias("min_iteration_time"),
        F.max("total_time").alias("max_iteration_time"),
        F.avg("success_rate").alias("avg_success_rate"),
        F.avg("avg_processing_time").alias("avg_processing_time_per_image"),
    )


def benchmark_best(summary: DataFrame) -> DataFrame:
    time, rate = F.col("avg_processing_time_per_image"), F.col("avg_success_rate")
    return summary.agg(
        F.min_by("model", F.struct(F.round(time, 9), F.col("model"))).alias("fastest_model"),
        F.min(time).alias("fastest_time"),
        F.min_by("model", F.struct(-F.round(rate, 9), F.col("model"))).alias("most_accurate_model"),
        F.max(rate).alias("best_success_rate"),
    )


def _gpu() -> Column:
    """GPU gigabytes; null and zero both mean not measured."""
    return F.nullif(F.col("gpu_used_gb"), F.lit(0.0))


def resource_summary(snapshots: DataFrame) -> DataFrame:
    first_total = F.coalesce(F.min_by("gpu_total_gb", "ts"), F.lit(0.0))
    return snapshots.groupBy("run_id").agg(
        F.max("process_gb").alias("peak_process_gb"),
        F.avg("process_gb").alias("avg_process_gb"),
        F.max("system_used_gb").alias("peak_system_gb"),
        F.count(F.lit(1)).alias("total_snapshots"),
        (F.max("ts") - F.min("ts")).alias("duration_s"),
        F.max(_gpu()).alias("peak_gpu_gb"),
        F.avg(_gpu()).alias("avg_gpu_gb"),
        F.when(F.count(_gpu()) > 0, first_total).alias("gpu_total_gb"),
    )


def resource_peaks(snapshots: DataFrame) -> DataFrame:
    """Peak value per run and resource, with label and percent of the earliest such snapshot."""
    resources = (
        ("system", "system_used_gb", "system_percent"),
        ("process", "process_gb", "process_percent"),
        ("gpu", "gpu_used_gb", "gpu_percent"),
    )
    aggs = []
    for name, value, percent in resources:
        order = F.when(F.col(value).isNotNull(), F.struct(-F.col(value), F.col("ts")))
        row = F.struct(
            F.lit(name).alias("resource"),
            F.col(value).alias("peak_gb"),
            F.coalesce(percent, F.lit(0.0)).alias("percent"),
            F.col("label").alias("label"),
        )
        aggs.append(F.min_by(row, order).alias(name))
    rows = snapshots.groupBy("run_id").agg(*aggs, F.count(_gpu()).alias("gpu_n"))
    peaks = F.array_compact(
        F.array(
            F.col("system"), F.col("process"), F.when(F.col("gpu_n") > 0, F.col("gpu"))
        )
    )
    return rows.select("run_id", F.inline(peaks))


def resource_timeline(snapshots: DataFrame) -> DataFrame:
    """Seconds since the run's first snapshot.

    The start is aggregated on the map side and joined back: one row per run, which Spark
    broadcasts by its size, or whose partner rows adaptive execution splits. A run with very
    many snapshots is never gathered in one task as a window over it would.
    """
    start = snapshots.groupBy("run_id").agg(F.min("ts").alias("start_ts"))
    return snapshots.join(start, "run_id").select(
        "run_id",
        "ts",
        (F.col("ts") - F.col("start_ts")).alias("elapsed_s"),
        "label",
        "process_gb",
        "gpu_used_gb",
    )


def resource_checks(snapshots: DataFrame) -> DataFrame:
    rows = snapshots.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"),
        (F.max("ts") - F.min("ts")).alias("duration"),
        F.min_by("process_gb", "ts").alias("first"),
        F.max("process_gb").alias("peak"),
        F.min("process_gb").alias("low"),
    )
    n = F.col("n")
    checks = rows.select(
        "run_id",
        (n >= MIN_SNAPSHOTS).alias("sufficient_snapshots"),
        (F.col("duration") > 10.0).alias("adequate_duration"),
        ((n >= 2) & (F.col("peak") > F.col("first") * 1.1)).alias("has_peak"),
        (~((n >= MIN_SNAPSHOTS) & (F.col("low") < F.col("first") * 0.8))).alias(
            "logical_progression"
        ),
    )
    issues = F.array_compact(
        F.array(
            F.when(~F.col("sufficient_snapshots"), F.lit("insufficient snapshots")),
            F.when(~F.col("adequate_duration"), F.lit("short monitoring duration")),
            F.when(~F.col("has_peak"), F.lit("no peak captured")),
            F.when(~F.col("logical_progression"), F.lit("illogical progression")),
        )
    )
    return checks.withColumn("issues", F.array_join(issues, "; "))


def resource_compare(summaries: DataFrame, sizes: Mapping[str, float]) -> DataFrame:
    """Per run whether it has enough snapshots; and, for exactly two runs of declared size,
    whether the larger one has the higher peak. Empty with fewer than two runs."""
    table = F.create_map(*[F.lit(x) for r, s in sizes.items() for x in (r, float(s))])
    size = F.try_element_at(table, F.col("run_id"))
    pair = summaries.agg(
        F.struct(
            F.count(F.lit(1)).alias("runs"),
            (
                (F.count(F.lit(1)) == 2)
                & (F.count(size) == 2)
                & (F.max(size) > F.min(size))
            ).alias("comparable"),
            (
                F.max_by("peak_process_gb", size) > F.min_by("peak_process_gb", size)
            ).alias("ordered"),
        )
    ).scalar()
    return (
        summaries.withColumn("pair", pair)
        .where(F.col("pair")["runs"] >= 2)
        .select(
            "run_id",
            "peak_process_gb",
            "total_snapshots",
            (F.col("total_snapshots") >= MIN_SNAPSHOTS).alias("adequate"),
            F.when(F.col("pair")["comparable"], F.col("pair")["ordered"]).alias("size_order_ok"),
        )
    )


def resource_combine(summaries: DataFrame) -> DataFrame:
    return summaries.agg(
        F.sum("total_snapshots").alias("total_snapshots"),
        F.sum("duration_s").alias("duration_s"),
        F.max("peak_process_gb").alias("peak_process_gb"),
        F.avg("avg_process_gb").alias("avg_process_gb"),
        F.max("peak_system_gb").alias("peak_system_gb"),
        F.max("peak_gpu_gb").alias("peak_gpu_gb"),
        F.avg("avg_gpu_gb").alias("avg_gpu_gb"),
        F.max(F.when(F.col("gpu_total_gb") > 0, F.col("gpu_total_gb"))).alias("gpu_total_gb"),
    )


def call_profile(calls: DataFrame) -> DataFrame:
    return calls.agg(
        F.avg("inference_time").alias("avg_inference_time"),
        F.avg("memory_used_mb").alias("avg_memory_used_mb"),
        F.max("peak_memory_mb").alias("max_peak_memory_mb"),
    )


def validation_summary(runs: DataFrame) -> DataFrame:
    ok = F.col("success")
    n = F.count(F.lit(1))
    zero = F.lit(0.0)
    quick = F.when(ok, F.struct(F.col("load_time"), F.col("model_name")))
    slow = F.when(ok, F.struct(-F.col("load_time"), F.col("model_name")))
    return runs.agg(
        n.alias("total_models_tested"),
        count_if(ok).alias("successful_validations"),
        ratio(count_if(ok), n).alias("validation_success_rate"),
        F.coalesce(F.avg(F.when(ok, F.col("load_time"))), zero).alias("average_load_time"),
        F.coalesce(F.avg(F.when(ok, F.col("memory_usage"))), zero).alias("average_memory_usage"),
        F.min_by("model_name", quick).alias("fastest_model"),
        F.min_by("model_name", slow).alias("slowest_model"),
    )


def validation_failures(runs: DataFrame) -> DataFrame:
    return runs.where(~_known("success")).select("model_name", "error_message")


def validation_findings(
    runs: DataFrame, memory_above: float = 12.0, load_above: float = 60.0
) -> DataFrame:
    """Rows (finding, detail, value); ``no_issues`` only where nothing else was found."""
    ok = F.col("success")
    errors = (
        runs.where(~_known("success") & (F.coalesce("error_message", F.lit("")) != ""))
        .groupBy(F.split_part("error_message", F.lit(":"), F.lit(1)).alias("detail"))
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
        .where(F.col("value") > 1)
    )
    repeated = errors.agg(F.count(F.lit(1))).scalar()
    facts = runs.agg(
        F.count(F.lit(1)).alias("n"),
        ratio(count_if(ok), F.count(F.lit(1))).alias("rate"),
        F.max(F.when(ok, F.col("memory_usage"))).alias("memory"),
        F.max(F.when(ok, F.col("load_time"))).alias("load"),
    )

    def row(test: Column, finding: str, value: Column) -> Column:
        return F.when(
            test,
            F.struct(
                F.lit(finding).alias("finding"),
                F.lit("").alias("detail"),
                value.cast("double").alias("value"),
            ),
        )

    n, rate = F.col("n"), F.col("rate")
    own = F.array_compact(
        F.array(
            row(n == 0, "no_data", F.lit(0)),
            row(F.col("memory") > memory_above, "high_memory", F.col("memory")),
            row(F.col("load") > load_above, "slow_loading", F.col("load")),
            row((n > 0) & (rate < 0.5), "low_success_rate", rate),
            row((n > 0) & (rate == 1.0), "all_succeeded", rate),
        )
    )
    fallback = F.array(row(F.lit(True), "no_issues", F.lit(0)))
    found = facts.select(
        F.inline(F.when((F.size(own) == 0) & (repeated == 0), fallback).otherwise(own))
    )
    return found.unionByName(
        errors.select(F.lit("repeated_error").alias("finding"), "detail", "value")
    )
