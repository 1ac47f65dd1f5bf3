"""Bringing results and truth together.

The join is one equi-join of document rows (maps, not exploded fields) on the document key;
truth holds one row per key, and a document has one result per model, so no key is hot. The
field values are looked up inside the row before it is unrolled; the long form meets an
aggregate with map-side combine at once and is never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldeval.functions.base import strip
from fieldeval.functions.score import Scorer, score_field
from fieldeval.operators.fields import lookup
from fieldeval.operators.shredded import Fields
from fieldeval.schema import FieldSpec


def with_truth(
    results: DataFrame, truth: DataFrame, key: str = "doc_id", how: str = "left"
) -> DataFrame:
    """Results with ``truth_fields``; null, which reads as no values, where no truth is known."""
    return results.join(truth.select(key, "truth_fields"), key, how)


def missing_truth(results: DataFrame, truth: DataFrame, key: str = "doc_id") -> DataFrame:
    """Results that can't be matched, with ``error``: no truth is known for them."""
    error = F.concat(F.lit("No ground truth found for "), F.col(key))
    return results.join(truth.select(key), key, "left_anti").withColumn("error", error)


def _names(spec: FieldSpec) -> Column:
    return F.array(
        *[
            F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("field"))
            for i, n, _ in spec.items()
        ]
    )


def _cells(joined: DataFrame, spec: FieldSpec, absent: str | None) -> list[tuple[str, list[Column]]] | None:
    """(field, (ordinal, field, truth, extracted)) over the fields of the spec, where both sides
    or one of them have them by their place; null where both are maps."""
    sides = [Fields(joined, c) for c in ("truth_fields", "extracted_fields")]
    if not any(s.shredded for s in sides):
        return None

    def found(i: int, n: str) -> list[Column]:
        truth, extracted = (F.coalesce(s.get(n), F.lit(absent)) for s in sides)
        return [F.lit(i).alias("ordinal"), F.lit(n).alias("field"), truth.alias("truth"), extracted.alias("extracted")]

    return [(n, found(i, n)) for i, n, _ in spec.items()]


def _values(joined: DataFrame, spec: FieldSpec, absent: str | None) -> Column:
    """Array of (ordinal, field, truth, extracted) over the fields of the spec."""
    cells = _cells(joined, spec, absent)
    if cells is not None:
        return F.array(*(F.struct(*c) for _, c in cells))

    def found(s: Column) -> Column:
        return F.struct(
            s["ordinal"].alias("ordinal"),
            s["field"].alias("field"),
            F.coalesce(lookup("truth_fields", s["field"]), F.lit(absent)).alias("truth"),
            F.coalesce(lookup("extracted_fields", s["field"]), F.lit(absent)).alias("extracted"),
        )

    return F.transform(_names(spec), found)


def align_with_truth(
    results: DataFrame,
    truth: DataFrame,
    spec: FieldSpec,
    *keep: str,
    key: str = "doc_id",
    absent: str | None = "",
    how: str = "left",
) -> DataFrame:
    """Long rows: every field of the spec for every evaluated document and model.

    Missing values become ``absent``; null keeps them apart from empty ones. Documents without
    truth are compared with missing values, or left out where ``how`` is inner.
    """
    held = list(dict.fromkeys((key, "model", *keep)))
    joined = with_truth(results.select(*held, "extracted_fields"), truth, key, how)
    return joined.select(*held, F.inline(_values(joined, spec, absent)))


def score_fields(
    aligned: DataFrame, scorer: Scorer = score_field, name: str = "score"
) -> DataFrame:
    """Add the scorer's value to aligned long rows.

    The facts are columns of their own, worked out once, before the rule reads them.
    """
    facts = scorer.facts(F.col("extracted"), F.col("truth"), F.col("field"))
    named = {k: F.col(f"__{k}") for k in facts}
    return (
        aligned.withColumns({f"__{k}": v for k, v in facts.items()})
        .withColumn(name, scorer.rule(named, F.col("field")))
        .drop(*[f"__{k}" for k in facts])
    )


def score_documents(
    results: DataFrame,
    truth: DataFrame,
    spec: FieldSpec,
    scorer: Scorer = score_field,
    key: str = "doc_id",
) -> DataFrame:
    """Document rows with ``scores``: an array of (ordinal, field, truth, extracted, score)."""
    scored = scored_columns(with_truth(results, truth, key), results.columns, spec, scorer)
    return scored.select(*results.columns, _scores(spec, "score").alias("scores"))


def aligned_scores(
    results: DataFrame,
    truth: DataFrame,
    spec: FieldSpec,
    *keep: str,
    scorer: Scorer = score_field,
    name: str = "score",
    key: str = "doc_id",
    absent: str | None = "",
    how: str = "left",
) -> DataFrame:
    """The rows of ``align_with_truth`` with the scorer's value, scored before they are unrolled."""
    held = list(dict.fromkeys((key, "model", *keep)))
    joined = with_truth(results.select(*held, "extracted_fields"), truth, key, how)
    # The array is unrolled as an expression: of a column Spark would ask that it is not empty, and that
    # filter, pushed below the scoring, works out all scores once more and multiplies the constraints.
    scored = scored_columns(joined, held, spec, scorer, absent, name)
    return scored.select(*held, F.inline(_scores(spec, name)))


def scored_columns(
    joined: DataFrame,
    held: Iterable[str],
    spec: FieldSpec,
    scorer: Scorer,
    absent: str | None = "",
    name: str = "score",
    more: Mapping[str, Callable[[Column, str], Column]] | None = None,
) -> DataFrame:
    """``held`` and for field number i the columns ``__i_truth``, ``__i_extracted`` and ``__i_<name>``,
    field by field: each has the part of the rule that its name leaves.

    Values and facts are columns, so they are compiled and worked out once; in a lambda over the
    fields Spark would interpret them for every value. ``more`` are further columns, from the true
    value and the name of the field.
    """
    sides = [Fields(joined, c) for c in ("truth_fields", "extracted_fields")]
    names = list(scorer.facts(F.lit(""), F.lit(""), F.lit("")))
    columns: dict[str, Column] = {}
    for i, n, _ in spec.items():
        truth, extracted = (F.coalesce(s.get(n), F.lit(absent)) for s in sides)
        columns |= {f"__{i}_truth": truth, f"__{i}_extracted": extracted}
        columns |= {f"__{i}_{k}": v for k, v in scorer.facts(extracted, truth, n).items()}
        columns |= {f"__{i}_{k}": of(truth, n) for k, of in (more or {}).items()}

    def scored(i: int, n: str) -> Column:
        return scorer.rule({k: F.col(f"__{i}_{k}") for k in names}, n).alias(f"__{i}_{name}")

    given = ["truth", "extracted", *(more or {})]
    kept = [f"__{i}_{c}" for i, _, _ in spec.items() for c in given]
    worked_out = joined.select(*held, *(c.alias(k) for k, c in columns.items()))
    return worked_out.select(*held, *kept, *(scored(i, n) for i, n, _ in spec.items()))


def _scores(spec: FieldSpec, name: str) -> Column:
    """Array of (ordinal, field, truth, extracted, ``name``) of what ``scored_columns`` has in columns."""

    def cell(i: int, n: str) -> Column:
        cells = [F.col(f"__{i}_{c}").alias(c) for c in ("truth", "extracted", name)]
        return F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("field"), *cells)

    return F.array(*(cell(i, n) for i, n, _ in spec.items()))


def flag_missing_inputs(truth: DataFrame, images: DataFrame, key: str = "doc_id") -> DataFrame:
    """Truth documents with ``error`` set where no input file is known."""
    known = images.select(F.col("name").alias(key)).distinct().withColumn("found", F.lit(True))
    return truth.join(known, key, "left").select(
        *truth.columns,
        F.when(F.col("found").isNull(), F.concat(F.lit("Image not found: "), F.col(key))).alias(
            "error"
        ),
    )


def validate_truth(
    rows: DataFrame, images: DataFrame, name: str = "image_name", path: str = "image_path"
) -> DataFrame:
    """Add ``status``: invalid, missing_image, path_mismatch or valid, in that order.

    Rows without a name need no lookup, so they take no part in the join, where they would be
    one key; a name that fills many rows makes a large partition of the join, which adaptive
    execution deals out.
    """
    clean_name = strip(F.coalesce(name, F.lit("")))
    clean_path = strip(F.coalesce(path, F.lit("")))
    # Grouped by one more column than the join has, names are dealt once more for the join: it then
    # stands right on its shuffles, where adaptive execution can split a large partition.
    known = (
        images.where(F.col("name") != "")
        .groupBy(F.col("name").alias("__name"), F.length("name").alias("__length"))
        .agg(F.lit(True).alias("__found"))
        .drop("__length")
    )
    keyed = rows.withColumn("__name", clean_name)
    unnamed = keyed.where(F.col("__name") == "").select(*rows.columns, F.lit("invalid").alias("status"))
    base = F.substring_index(F.rtrim(clean_path, F.lit("/")), "/", -1)
    status = (
        F.when(F.col("__found").isNull(), "missing_image")
        .when((clean_path != "") & (base != clean_name), "path_mismatch")
        .otherwise("valid")
    )
    named = keyed.where(F.col("__name") != "").join(known, "__name", "left")
    return named.select(*rows.columns, status.alias("status")).unionByName(unnamed)


def extra_images(images: DataFrame, rows: DataFrame, name: str = "image_name") -> DataFrame:
    """Inventory names the truth table does not list."""
    listed = rows.select(strip(F.col(name)).alias("name")).where(F.col("name") != "").distinct()
    return images.join(listed, "name", "left_anti")


def models_side_by_side(
    doc_accuracy: DataFrame, left: str, right: str, key: str = "doc_id"
) -> DataFrame:
    """Both models' accuracies per document; a document only one model saw has a null."""
    one = F.col("model") == left
    two = F.col("model") == right
    return (
        doc_accuracy.where(one | two)
        .groupBy(key)
        .agg(
            F.max(F.when(one, F.col("accuracy"))).alias("left_accuracy"),
            F.max(F.when(two, F.col("accuracy"))).alias("right_accuracy"),
        )
    )
