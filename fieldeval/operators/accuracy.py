"""Accuracy reports over scored documents and scored fields."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldeval.functions.base import count_if, ratio, strip, strip_value
from fieldeval.functions.score import Scorer, match_field, score_field, truth_missing
from fieldeval.functions.values import has_value
from fieldeval.operators.align import aligned_scores, scored_columns, with_truth
from fieldeval.operators.quantiles import as_columns, counted_values, exact_quantiles
from fieldeval.operators.shredded import Fields
from fieldeval.schema import FieldSpec

# Decimal places at which accuracies are compared with thresholds and with each other.
PLACES = 8


def _sum_of(spec: FieldSpec, part: Callable[[int], Column], zero: float = 0) -> Column:
    """Sum over the numbers of the fields."""
    return sum((part(i) for i, _, _ in spec.items()), F.lit(zero))


def document_accuracy(
    results: DataFrame,
    truth: DataFrame,
    spec: FieldSpec,
    scorer: Scorer = score_field,
    key: str = "doc_id",
    more: Mapping[str, Column] | None = None,
    type_field: str | None = None,
) -> DataFrame:
    """One row per result: mean over all fields of the spec, fields with a truth, fields
    extracted. Failed rows carry nulls; equal rows stay apart, as each is scored in itself.
    ``more`` are further columns taken from the result's row; with ``type_field`` there is
    ``document_type``, the true value of that field."""
    ok = F.col("successful")
    known = _sum_of(spec, lambda i: (~F.col(f"__{i}_missing")).cast("int"))
    total = _sum_of(spec, lambda i: F.col(f"__{i}_score"), 0.0)
    found = Fields(results).count_of(spec.names)
    joined = with_truth(results, truth, key)
    held, more = results.columns, dict(more or {})
    if type_field is not None:
        joined = joined.withColumn("document_type", Fields(joined, "truth_fields").get(type_field))
        held, more = [*held, "document_type"], more | {"document_type": F.col("document_type")}
    scored = scored_columns(joined, held, spec, scorer, more={"missing": truth_missing})
    return scored.select(
        key,
        "model",
        "successful",
        F.when(ok, F.col("processing_time")).alias("processing_time"),
        F.when(ok, F.round(total / F.lit(len(spec.names)), PLACES)).alias("accuracy"),
        F.when(ok, known).cast("long").alias("truth_fields"),
        F.when(ok, found).alias("extracted_fields"),
        *(c.alias(n) for n, c in more.items()),
    )


def model_accuracy(
    doc_accuracy: DataFrame,
    requested: DataFrame | None = None,
    models: Iterable[str] = (),
    more: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Means over successful documents and rates over all that were asked for.

    ``requested`` has a row for each of those; one without a result counts as failed. Without
    it the rows at hand are all. A model of ``models`` without any row has failed throughout.
    ``more`` are further aggregates.
    """
    asked_models = [F.lit(m).alias("model") for m in models]
    if asked_models:
        session = doc_accuracy.sparkSession
        named = session.range(1).select(F.explode(F.array(*asked_models)).alias("model"))
        found = model_accuracy(doc_accuracy, requested, more=more)
        none = F.lit(0).cast("long") if requested is None else requested.agg(F.count(F.lit(1))).scalar()
        both = found.join(named, "model", "full_outer")
        asked = F.coalesce("total_images", none)
        both = both.withColumns({"failed": F.coalesce("failed", asked), "total_images": asked})
        zeros = ["successful", "success_rate", "avg_accuracy", "avg_processing_time", "avg_fields_extracted", "total_processing_time"]
        return both.na.fill(0, zeros).select(*found.columns)
    ok = F.col("successful")
    done = count_if(ok)
    asked = F.count(F.lit(1))
    if requested is not None:
        asked = F.max(requested.agg(F.count(F.lit(1))).scalar())
    return doc_accuracy.groupBy("model").agg(
        asked.alias("total_images"),
        done.alias("successful"),
        (asked - done).alias("failed"),
        ratio(done, asked).alias("success_rate"),
        F.coalesce(F.avg(F.when(ok, F.col("accuracy"))), F.lit(0.0)).alias("avg_accuracy"),
        ratio(F.sum(F.when(ok, F.col("processing_time"))), done).alias("avg_processing_time"),
        F.coalesce(F.avg(F.when(ok, F.col("extracted_fields"))), F.lit(0.0)).alias(
            "avg_fields_extracted"
        ),
        F.coalesce(F.sum(F.when(ok, F.col("processing_time"))), F.lit(0.0)).alias(
            "total_processing_time"
        ),
        *(c.alias(n) for n, c in (more or {}).items()),
    )


def field_accuracy(scored_fields: DataFrame) -> DataFrame:
    """Mean score per model and field over long rows of successful documents.

    The mean is rounded to eight places: sums taken in any task order then agree, and fields
    that tie do tie.
    """
    return scored_fields.groupBy("model", "ordinal", "field").agg(
        F.round(F.avg("score"), PLACES).alias("accuracy"), F.count(F.lit(1)).alias("documents")
    )


def filled_fields(results: DataFrame) -> Column:
    """Number of a result's fields that are filled."""
    return F.size(F.filter(Fields(results).values(), lambda v: has_value(v, "strict")))


def non_na_fields(results: DataFrame) -> DataFrame:
    """Mean number of filled fields per document and model."""
    return results.groupBy("model").agg(F.avg(filled_fields(results)).alias("non_na_fields"))


def non_na_fields_from_accuracy(field_acc: DataFrame) -> DataFrame:
    return field_acc.groupBy("model").agg(
        count_if(F.col("accuracy") > 0).cast("double").alias("non_na_fields")
    )


def match_fields(
    results: DataFrame, truth: DataFrame, spec: FieldSpec, key: str = "doc_id"
) -> DataFrame:
    """Long rows with ``matched``; absent values on either side read ``N/A``. Documents without
    truth can't be matched: ``align.missing_truth`` lists them with an error."""
    return aligned_scores(results, truth, spec, scorer=match_field, name="matched", key=key, absent="N/A", how="inner")


def truth_match_report(matched: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: fields with truth, correct ones among them, percent to two places."""
    relevant = F.lower(strip(F.col("truth"))) != "n/a"
    return (
        matched.groupBy(key, "model")
        .agg(
            count_if(relevant & F.col("matched")).alias("correct_fields"),
            count_if(relevant).alias("total_fields"),
        )
        .withColumn(
            "accuracy_percentage",
            F.round(ratio(F.col("correct_fields"), F.col("total_fields")) * 100, 2),
        )
    )


def truth_match_documents(
    results: DataFrame, truth: DataFrame, spec: FieldSpec, key: str = "doc_id"
) -> DataFrame:
    """``truth_match_report`` of ``match_fields``, summed up inside each result's row."""
    joined = with_truth(results.select(key, "model", "extracted_fields"), truth, key, "inner")
    relevant = {"relevant": lambda t, n: F.lower(strip_value(t)) != "n/a"}
    matched = scored_columns(joined, [key, "model"], spec, match_field, "N/A", "matched", relevant)
    correct = _sum_of(spec, lambda i: (F.col(f"__{i}_relevant") & F.col(f"__{i}_matched")).cast("int"))
    total = _sum_of(spec, lambda i: F.col(f"__{i}_relevant").cast("int"))
    rows = matched.select(key, "model", correct.alias("correct"), total.alias("total"))
    sums = rows.groupBy(key, "model").agg(F.sum("correct").alias("correct_fields"), F.sum("total").alias("total_fields"))
    share = ratio(F.col("correct_fields"), F.col("total_fields"))
    return sums.withColumn("accuracy_percentage", F.round(share * 100, 2))


def truth_match_summary(report: DataFrame) -> DataFrame:
    return report.groupBy("model").agg(
        F.count(F.lit(1)).alias("total_images"),
        F.avg("accuracy_percentage").alias("overall_accuracy"),
        F.avg("correct_fields").alias("average_correct_fields"),
    )


def truth_match_fields(matched: DataFrame) -> DataFrame:
    """Correct percent per model and field where the truth is not ``N/A``; null if never."""
    has_truth = F.col("truth") != "N/A"
    return matched.groupBy("model", "ordinal", "field").agg(
        F.round(
            ratio(count_if(has_truth & F.col("matched")), count_if(has_truth), None) * 100, 2
        ).alias("accuracy")
    )


def best_and_worst(field_acc: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` best and ``n`` worst fields per model; ties keep field order."""
    from pyspark.sql import Window

    rows = field_acc.where(F.col("accuracy").isNotNull())
    high = Window.partitionBy("model").orderBy(F.col("accuracy").desc(), "ordinal")
    low = Window.partitionBy("model").orderBy(F.col("accuracy").asc(), "ordinal")
    ranked = rows.select(
        "model",
        "field",
        "accuracy",
        F.row_number().over(high).alias("best_rank"),
        F.row_number().over(low).alias("worst_rank"),
    )
    keep = F.array_compact(
        F.array(
            F.when(
                F.col("best_rank") <= n,
                F.struct(F.lit("best").alias("list"), F.col("best_rank").alias("rank")),
            ),
            F.when(
                F.col("worst_rank") <= n,
                F.struct(F.lit("worst").alias("list"), F.col("worst_rank").alias("rank")),
            ),
        )
    )
    return ranked.select("model", "field", "accuracy", F.inline(keep))


def accuracy_matrix(field_acc: DataFrame, models: Iterable[str]) -> DataFrame:
    """One row per field, one percent column per model; 0 where a model lacks the field."""
    names = list(models)
    out = field_acc.groupBy("ordinal", "field").pivot("model", names).agg(F.max("accuracy"))
    return out.select(
        "ordinal", "field", *[(F.coalesce(m, F.lit(0.0)) * 100).alias(m) for m in names]
    )


def overview_summary(
    results: DataFrame, truth: DataFrame, spec: FieldSpec, requested: DataFrame | None = None, key: str = "doc_id"
) -> DataFrame:
    """``model_accuracy`` with ``non_na_fields``, from one scan of the results."""
    docs = document_accuracy(results, truth, spec, key=key, more={"filled": filled_fields(results)})
    return model_accuracy(docs, requested, more={"non_na_fields": F.avg("filled")})


def overview_table(summary: DataFrame, non_na: DataFrame | None, memory: DataFrame) -> DataFrame:
    """Accuracy, seconds, filled fields and memory per model; memory may be unknown. Filled
    fields are those of ``non_na``, or the summary's own (``overview_summary``)."""
    both = summary if non_na is None else summary.join(non_na, "model", "left")
    return (
        both.join(memory.select("model", "memory_gb"), "model", "left")
        .select("model", "avg_accuracy", "avg_processing_time", "non_na_fields", "memory_gb")
    )


def best_models(summary: DataFrame) -> DataFrame:
    """Most accurate and fastest model; empty with fewer than two models."""
    return (
        summary.agg(
            F.count(F.lit(1)).alias("models"),
            F.min_by("model", F.struct(-F.round("avg_accuracy", PLACES), F.col("model"))).alias("best_accuracy"),
            F.min_by("model", F.struct(F.round("avg_processing_time", PLACES), F.col("model"))).alias("fastest"),
        )
        .where(F.col("models") >= 2)
        .drop("models")
    )


def evaluated_documents(
    results: DataFrame, truth: DataFrame, spec: FieldSpec, scorer: Scorer = score_field, key: str = "doc_id"
) -> DataFrame:
    """``document_evaluation`` of ``aligned_scores``, summed up inside each result's row."""
    joined = with_truth(results.select(key, "model", "extracted_fields"), truth, key)
    scored = scored_columns(joined, [key, "model"], spec, scorer)
    total = _sum_of(spec, lambda i: F.col(f"__{i}_score"), 0.0)
    good = _sum_of(spec, lambda i: (F.col(f"__{i}_score") >= 0.99).cast("int"))
    rows = scored.select(key, "model", total.alias("total"), good.alias("good"))
    n = F.count(F.lit(1)) * len(spec.names)
    return rows.groupBy(key, "model").agg(
        (F.sum("total") / n).alias("overall_accuracy"),
        F.sum("good").alias("correct_fields"),
        n.alias("total_fields"),
        (ratio(F.sum("good"), n) * 100).alias("field_accuracy_rate"),
    )


def document_evaluation(scored_fields: DataFrame, key: str = "doc_id") -> DataFrame:
    """Accuracy, number of fields at 0.99 or better, total and rate per document."""
    n, correct = F.count(F.lit(1)), count_if(F.col("score") >= 0.99)
    return scored_fields.groupBy(key, "model").agg(
        F.avg("score").alias("overall_accuracy"),
        correct.alias("correct_fields"),
        n.alias("total_fields"),
        (ratio(correct, n) * 100).alias("field_accuracy_rate"),
    )


def document_evaluation_wide(
    scored: DataFrame, spec: FieldSpec, key: str = "doc_id"
) -> DataFrame:
    """The same with three columns per field (accuracy, extracted, truth), alphabetically.

    Takes ``score_documents`` rows, so no pivot is needed.
    """
    places = {n: i - 1 for i, n, _ in spec.items()}
    total = F.aggregate("scores", F.lit(0.0), lambda acc, s: acc + s["score"])
    correct = F.size(F.filter("scores", lambda s: s["score"] >= 0.99))
    cells = []
    for n in sorted(places):
        s = F.col("scores")[places[n]]
        cells += [
            s["score"].alias(f"{n}_accuracy"),
            s["extracted"].alias(f"{n}_extracted"),
            s["truth"].alias(f"{n}_ground_truth"),
        ]
    return scored.select(
        key,
        "model",
        (total / F.size("scores")).alias("overall_accuracy"),
        correct.alias("correct_fields"),
        F.size("scores").alias("total_fields"),
        (correct / F.size("scores") * 100).alias("field_accuracy_rate"),
        *cells,
    )


def quality_distribution(doc_eval: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts per accuracy band, mean, best and worst document per model."""
    a = F.round("overall_accuracy", PLACES)
    return doc_eval.groupBy("model").agg(
        F.count(F.lit(1)).alias("total_images"),
        F.avg(a).alias("overall_accuracy"),
        count_if(a >= 0.99).alias("perfect_documents"),
        count_if((a >= 0.8) & (a < 0.99)).alias("good_documents"),
        count_if((a >= 0.6) & (a < 0.8)).alias("fair_documents"),
        count_if(a < 0.6).alias("poor_documents"),
        F.min_by(key, F.struct((-a).alias("a"), F.col(key))).alias("best_image"),
        F.min_by(key, F.struct(a.alias("a"), F.col(key))).alias("worst_image"),
    )


def readiness(
    quality: DataFrame,
    field_acc: DataFrame,
    min_accuracy: float = 0.80,
    min_perfect: float = 0.30,
    min_fields: int = 15,
    field_level: float = 0.90,
    gate: float = 0.85,
) -> DataFrame:
    """Deployment checks per model and the single accuracy gate."""
    strong = field_acc.groupBy("model").agg(
        count_if(F.col("accuracy") >= field_level).alias("strong_fields")
    )
    overall = F.round("overall_accuracy", PLACES)
    perfect = ratio(F.col("perfect_documents"), F.col("total_images"))
    return quality.join(strong, "model", "left").select(
        "model",
        (overall >= min_accuracy).alias("accuracy_ok"),
        (perfect >= min_perfect).alias("perfect_ok"),
        (F.coalesce("strong_fields", F.lit(0)) >= min_fields).alias("fields_ok"),
        (overall >= gate).alias("gate_ok"),
    )


def readiness_of(
    scored: DataFrame,
    spec: FieldSpec,
    min_accuracy: float = 0.80,
    min_perfect: float = 0.30,
    min_fields: int = 15,
    field_level: float = 0.90,
    gate: float = 0.85,
) -> DataFrame:
    """The same checks from ``score_documents`` rows: one pass, one aggregate per model."""
    places = [i - 1 for i, _, _ in spec.items()]
    mean = F.aggregate("scores", F.lit(0.0), lambda acc, s: acc + s["score"]) / F.size("scores")
    fields = [F.col("scores")[i]["score"].alias(f"f{i}") for i in places]
    per = scored.select("model", F.round(mean, PLACES).alias("mean"), *fields)
    strong = sum((F.round(F.avg(f"f{i}"), PLACES) >= field_level).cast("int") for i in places)
    overall = F.round(F.avg("mean"), PLACES)
    return per.groupBy("model").agg(
        (overall >= min_accuracy).alias("accuracy_ok"),
        (ratio(count_if(F.col("mean") >= 0.99), F.count(F.lit(1))) >= min_perfect).alias("perfect_ok"),
        (strong >= min_fields).alias("fields_ok"),
        (overall >= gate).alias("gate_ok"),
    )


def accuracy_by_type(doc_accuracy: DataFrame) -> DataFrame:
    """Mean accuracy per model and ``document_type`` (``document_accuracy`` with a ``type_field``);
    null where no truth is known.

    Documents without an accuracy are left out by the aggregate: a filter on it would be pushed below
    the scoring, where Spark may take long to derive what else holds for so many columns.
    """
    scored = F.count("accuracy").alias("documents")
    per = doc_accuracy.groupBy("model", "document_type").agg(scored, F.avg("accuracy").alias("accuracy"))
    return per.where(F.col("documents") > 0)


def low_accuracy_documents(doc_accuracy: DataFrame, below: float = 0.8) -> DataFrame:
    return doc_accuracy.where(F.round("accuracy", PLACES) < below)


def sparse_documents(results: DataFrame, below: int = 10) -> DataFrame:
    """Documents with fewer than ``below`` filled fields."""
    filled = F.size(F.filter(Fields(results).values(), lambda v: has_value(v, "rates")))
    return results.withColumn("filled", filled).where(F.col("filled") < below)


def weak_fields(field_acc: DataFrame, below: float = 0.5) -> DataFrame:
    """Fields under a mean accuracy, worst first."""
    return field_acc.where(F.col("accuracy") < below).orderBy("accuracy", "model", "ordinal")


def describe_accuracy(
    doc_accuracy: DataFrame, places: int = PLACES, store: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Count, mean, standard deviation and quartiles of accuracies per model.

    Accuracies are rounded to the places at which they compare everywhere, so a group has a
    bounded number of values; the quartiles are exact, from histograms that get finer.
    The counts of values are read several times: ``store`` keeps them, so that the documents
    are scored once.
    """
    counted = counted_values(doc_accuracy, "model", "accuracy", places)
    if store is not None:
        counted = store(counted)
    n, v = F.col("n"), F.col("u") / 10**places
    total, s1, s2 = F.sum(n), F.sum(n * v), F.sum(n * v * v)
    variance = F.greatest((s2 - s1 * s1 / total), F.lit(0.0)) / F.nullif(total - 1, F.lit(0))
    figures = counted.groupBy(F.col("g").alias("model")).agg(
        total.alias("count"), (s1 / total).alias("mean"), F.sqrt(variance).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")
    )
    names = {0.25: "q25", 0.50: "q50", 0.75: "q75"}
    found = as_columns(exact_quantiles(counted, "model", names, places), "model", names)
    columns = ["model", "count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    return figures.join(found, "model").select(*columns)
