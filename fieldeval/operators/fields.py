"""Field lists, shape changes and exports of result rows.

Result rows carry their fields as MAP<STRING,STRING>, one row per document and model. Going
wide reads the map and going long explodes it, so neither needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldeval import schema as S
from fieldeval.functions.base import col_of, count_if, ratio, strip
from fieldeval.functions.values import doc_name, has_value, na_to_null, quality_rating
from fieldeval.operators.shredded import Fields
from fieldeval.schema import Bands, FieldSpec


def lookup(fields: Column | str, name: Column | str) -> Column:
    """Value of a key or null."""
    return F.try_element_at(col_of(fields), F.lit(name) if isinstance(name, str) else name)


def fields_from_template(
    templates: DataFrame, id_col: str, text_col: str, drop: Iterable[str] = S.TEMPLATE_WORDS
) -> DataFrame:
    """Rows (id, ordinal, field) for every ``NAME: [..]`` line, in order, duplicates kept."""
    names = F.filter(
        F.transform(
            F.split(F.col(text_col), "\n"),
            lambda x: F.regexp_extract(strip(x), r"^\s*([A-Z_]+):\s*\[.*\]", 1),
        ),
        lambda n: (n != "") & ~n.isin(*drop),
    )
    return templates.select(F.col(id_col), F.posexplode(names).alias("pos", "field")).select(
        id_col, (F.col("pos") + 1).alias("ordinal"), "field"
    )


def restrict_to_fields(long: DataFrame, fields: DataFrame) -> DataFrame:
    """Long rows (…, field, value) of the fields that are rows of ``fields`` (field, …): for
    field lists that are data, of any length, rather than configuration."""
    return long.join(fields.select("field"), "field", "left_semi")


def weight_of(field: Column | str, spec: FieldSpec) -> Column:
    """Weight by upper-cased name; null for a name outside the spec."""
    table = F.create_map(*[F.lit(x) for n, w in zip(spec.names, spec.weights) for x in (n, w)])
    return F.try_element_at(table, F.upper(col_of(field)))


def with_weights(rows: DataFrame, overrides: Mapping[str, float]) -> DataFrame:
    """Add ``weight``: the override for the row's field, else 1.0."""
    chosen = F.lit(None).cast("double")
    if overrides:
        table = F.create_map(*[F.lit(x) for n, w in overrides.items() for x in (n, float(w))])
        chosen = F.try_element_at(table, F.col("field"))
    return rows.withColumn("weight", F.coalesce(chosen, F.lit(1.0)))


def attach_weights(rows: DataFrame, spec: FieldSpec) -> DataFrame:
    """Add ``weight`` to long rows; rows of unknown fields are left out."""
    return rows.withColumn("weight", weight_of("field", spec)).where(F.col("weight").isNotNull())


def restrict_to_spec(rows: DataFrame, spec: FieldSpec, fields: str = "extracted_fields") -> DataFrame:
    return rows.withColumn(fields, Fields(rows, fields).only(spec.names))


def to_long(rows: DataFrame, *keep: str, fields: str = "extracted_fields") -> DataFrame:
    """One row per document, model and extracted field.

    The outer form is used because Spark guards a plain explode with a filter on its input,
    and would evaluate a parser behind that input once more for the filter.
    """
    return rows.select(*keep, F.explode_outer(Fields(rows, fields).as_map()).alias("field", "value")).where(
        F.col("field").isNotNull()
    )


def to_wide(
    rows: DataFrame,
    spec: FieldSpec,
    *keep: str,
    default: str = "N/A",
    prefix: str = "",
    fields: str = "extracted_fields",
    use_na_strings: bool = True,
) -> DataFrame:
    """One column per field of the spec, in order."""
    held = Fields(rows, fields)
    cells = [
        na_to_null(F.coalesce(held.get(n), F.lit(default)), use_na_strings).alias(prefix + n)
        for n in spec.names
    ]
    return rows.select(*keep, *cells)


def batch_to_wide(batch: DataFrame, spec: FieldSpec, use_na_strings: bool = False) -> DataFrame:
    """Batch result rows as ``image`` plus one column per field."""
    named = batch.withColumn("image", doc_name("filename", "image"))
    return to_wide(named, spec, "image", use_na_strings=use_na_strings)


def _valued(spec: FieldSpec, prefix: str) -> Column:
    total = F.lit(0)
    for n in spec.names:
        total = total + has_value(prefix + n, "rates").cast("int")
    return total


def export_results(rows: DataFrame, spec: FieldSpec, bands: Bands = Bands()) -> DataFrame:
    """Flat row per model and image with field columns, filled count and quality band."""
    base = rows.select(
        F.col("model").alias("model_name"),
        F.coalesce("img_name", F.lit("")).alias("image_name"),
        F.coalesce("processing_time", F.lit(0.0)).alias("processing_time"),
        F.coalesce("response_length", F.lit(0)).alias("response_length"),
        F.coalesce("successful", F.lit(False)).alias("successful"),
        F.coalesce(Fields(rows).count(), F.lit(0)).alias("field_count"),
        "extracted_fields",
    )
    plain = [c for c in base.columns if c != "extracted_fields"]
    wide = to_wide(base, spec, *plain, prefix="field_")
    return wide.withColumn("fields_with_values", _valued(spec, "field_")).withColumn(
        "quality_rating", quality_rating("fields_with_values", bands)
    )


def export_metrics_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "model",
        F.coalesce("img_name", F.lit("unknown")).alias("image"),
        F.coalesce("successful", F.lit(False)).alias("successful"),
        F.coalesce(Fields(rows).count(), F.lit(0)).alias("field_count"),
        F.coalesce("core_fields_found", F.lit(0)).alias("core_fields_found"),
        F.coalesce("extraction_time", F.lit(0.0)).alias("extraction_time"),
    )


# Source columns of the truth record; the other fields are always N/A.
_SOURCE_TEXT = {
    "SUPPLIER": "business_name",
    "ABN": "abn",
    "PAYER_NAME": "payer_name",
    "PAYER_ADDRESS": "payer_address",
    "PAYER_PHONE": "payer_phone",
    "PAYER_EMAIL": "payer_email",
    "INVOICE_DATE": "date",
    "DUE_DATE": "due_date",
    "QUANTITIES": "quantities",
    "PRICES": "prices",
    "BUSINESS_ADDRESS": "business_address",
    "BUSINESS_PHONE": "business_phone",
    "BSB_NUMBER": "bsb",
    "BANK_ACCOUNT_NUMBER": "bank_account",
    "DESCRIPTIONS": "items_list",
}
_SOURCE_MONEY = {"GST": "gst", "TOTAL": "total", "SUBTOTAL": "subtotal"}


def map_source_to_truth(
    source: DataFrame, *keep: str, spec: FieldSpec = S.DEFAULT_SPEC
) -> DataFrame:
    """Source records to one column per field; columns the source lacks count as absent."""

    def cell(name: str) -> Column:
        if name == "DOCUMENT_TYPE" and "document_type" in source.columns:
            return F.coalesce("document_type", F.lit("INVOICE"))
        if name == "DOCUMENT_TYPE":
            return F.lit("INVOICE")
        if name in _SOURCE_TEXT and _SOURCE_TEXT[name] in source.columns:
            return F.coalesce(_SOURCE_TEXT[name], F.lit("N/A"))
        if name in _SOURCE_MONEY and _SOURCE_MONEY[name] in source.columns:
            amount = F.col(_SOURCE_MONEY[name])
            return F.when(
                amount.isNotNull() & (amount != 0), F.format_string("$%.2f", amount)
            ).otherwise("N/A")
        return F.lit("N/A")

    return source.select(*keep, *[cell(n).alias(n) for n in spec.names])


def restrict_documents(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return rows.join(ids.select(key), key, "left_semi")


def dependent_field_check(
    wide: DataFrame, rules: Mapping[str, Iterable[str]], type_col: str = "DOCUMENT_TYPE"
) -> DataFrame:
    """Add ``<field>_CONFIDENCE`` = ``low`` where a type's required field is ``N/A``."""
    flags: dict[str, Column] = {}
    for kind, required in rules.items():
        for name in required:
            test = (F.col(type_col) == kind) & (F.col(name) == "N/A")
            col = f"{name}_CONFIDENCE"
            flags[col] = F.when(test, "low") if col not in flags else flags[col].when(test, "low")
    return wide.withColumns(flags)


def completeness_profile(wide: DataFrame, spec: FieldSpec) -> DataFrame:
    """Present count, total and percent per field, and one ``(overall)`` row.

    Counts are taken in a single pass; only the one-row result is turned into rows.
    """
    counts = wide.agg(
        F.count(F.lit(1)).alias("__rows"), *[F.count(n).alias(n) for n in spec.names]
    )
    rows = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(n).alias("field"),
            F.col(n).alias("present"),
            F.col("__rows").alias("total"),
        )
        for i, n, _ in spec.items()
    ]
    all_present = sum((F.col(n) for n in spec.names), F.lit(0).cast("long"))
    rows.append(
        F.struct(
            F.lit(len(spec) + 1).alias("ordinal"),
            F.lit("(overall)").alias("field"),
            all_present.alias("present"),
            (F.col("__rows") * len(spec)).alias("total"),
        )
    )
    return counts.select(F.inline(F.array(*rows))).withColumn(
        "percent", ratio(F.col("present"), F.col("total")) * 100
    )


def fill_rates(wide: DataFrame, fields: Iterable[str]) -> DataFrame:
    """Non-blank count and rate per truth field, in one pass."""
    names = list(fields)
    counts = wide.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[count_if(strip(F.coalesce(n, F.lit(""))) != "").alias(n) for n in names],
    )
    rows = [
        F.struct(
            F.lit(n).alias("field"), F.col("__rows").alias("total"), F.col(n).alias("non_empty")
        )
        for n in names
    ]
    return counts.select(F.inline(F.array(*rows))).withColumn(
        "fill_rate", ratio(F.col("non_empty"), F.col("total"))
    )
