"""Rules on single values: missing markers, names, bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldeval import schema as S
from fieldeval.functions.base import col_of, strip
from fieldeval.schema import Bands, SpeedBands


def na_to_null(c: Column | str, use_na_strings: bool = False) -> Column:
    value = col_of(c)
    return value if use_na_strings else F.nullif(value, F.lit("N/A"))


def has_value(c: Column | str, rule: str = "rates") -> Column:
    """Whether a value counts as present; null never does."""
    value = col_of(c)
    if rule == "rates":
        found = ~value.isin("N/A", "n/a", "")
    elif rule == "strict":
        found = (value != "") & ~F.upper(strip(value)).isin("N/A", "")
    elif rule == "documented":
        found = ~F.upper(value).isin(*S.NA_VARIANTS)
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return F.coalesce(found, F.lit(False))


def doc_name(filename: Column | str, image: Column | str | None = None) -> Column:
    """File name without directories; ``unknown`` when neither source has one."""
    sources = [col_of(filename)] + ([] if image is None else [col_of(image)])
    name = F.coalesce(*sources, F.lit("unknown"))
    # A trailing slash does not hide the last path part.
    return F.when(
        F.contains(name, F.lit("/")), F.substring_index(F.rtrim(name, F.lit("/")), "/", -1)
    ).otherwise(name)


def quality_rating(c: Column | str, bands: Bands = Bands()) -> Column:
    n = col_of(c)
    return (
        F.when(n >= bands.excellent, "excellent")
        .when(n >= bands.good, "good")
        .when(n >= bands.fair, "fair")
        .otherwise("poor")
    )


def speed_rating(c: Column | str, bands: SpeedBands = SpeedBands()) -> Column:
    seconds = col_of(c)
    return (
        F.when(seconds < bands.very_fast, "Very Fast")
        .when(seconds < bands.fast, "Fast")
        .when(seconds < bands.moderate, "Moderate")
        .otherwise("Slow")
    )


def memory_estimate(parameters: Column | str, bits: Column | str, family: Column | str) -> Column:
    """Gigabytes for a model of ``parameters`` at 4, 8 or 16 bits.

    Family ``internvl`` has no 4-bit form: it falls back to 16 bits.
    """
    n, width, fam = col_of(parameters).cast("double"), col_of(bits), col_of(family)
    vision = fam == "internvl"
    factor = (
        F.when(vision & (width == 8), 1.0 * 1.4)
        .when(vision, 2.0 * 1.3)
        .when(width == 4, 0.5 * 1.5)
        .when(width == 8, 1.0 * 1.3)
        .otherwise(2.0 * 1.2)
    )
    return n / float(1024**3) * factor


def parameters_from_name(c: Column | str) -> Column:
    """Parameter count from a model path: first size name, in table order, that occurs."""
    path = col_of(c)
    chain = F.when(F.lit(False), F.lit(0).cast("long"))
    for name, count in S.MODEL_PARAMETERS.items():
        alt = name.replace("-", "_").lower()
        chain = chain.when(
            F.contains(path, F.lit(name)) | F.contains(F.lower(path), F.lit(alt)),
            F.lit(count).cast("long"),
        )
    return chain.otherwise(F.lit(S.DEFAULT_PARAMETERS).cast("long"))


def within_limit(
    gb: Column | str, limit: float = S.GPU_LIMIT_GB, margin: float = S.GPU_SAFETY_MARGIN
) -> Column:
    return col_of(gb) <= limit * margin


def capacity_status(
    gb: Column | str, limit: float = S.GPU_LIMIT_GB, margin: float = S.GPU_SAFETY_MARGIN
) -> Column:
    usage = col_of(gb)
    return F.when(usage <= limit * margin, "SAFE").when(usage <= limit, "MARGIN").otherwise("OVER")
