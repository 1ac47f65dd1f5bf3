"""Comparison of one extracted value with its true value.

``field`` decides which rule applies, so one expression serves the whole long table and
stays inside code generation. A :class:`Scorer` has two steps, because its rule looks at the
same normalised values many times: ``facts`` names the values worked out once per field, and
``rule`` chooses the score from them. Calling the scorer does both in one expression. Where the
field is known by name, as text and not as a column, only the part that it needs is built.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldeval import schema as S
from fieldeval.functions.base import col_of, is_in, let, strip, strip_value, words


Facts = Mapping[str, Column]


@dataclass(frozen=True)
class Scorer:
    facts: Callable[[Column, Column, Column | str], dict[str, Column]]
    rule: Callable[[Facts, Column | str], Column]

    def __call__(
        self, extracted: Column | str, truth: Column | str, field: Column | str
    ) -> Column:
        f = col_of(field)
        return self.rule(self.facts(col_of(extracted), col_of(truth), f), f)


def _by_field(
    first: Column, f: Column | str, rules: Iterable[tuple[Iterable[str], Callable[[], Column]]], other: Callable[[], Column]
) -> Column:
    """``first``, a chain of conditions, continued by the rule of the field."""
    for names, value in rules:
        if not isinstance(f, str):
            first = first.when(is_in(f, names), value())
        elif f in names:
            return first.otherwise(value())
    return first.otherwise(other())


def _number(c: Column) -> Column:
    # What has no digit is no number; the cast would raise and catch an exception to find that.
    return F.when((c != "") & (c != "."), c.try_cast("double"))


def score_amount(extracted: Column, truth: Column, keep: str = "[^0-9.]") -> Column:
    """Numbers within a cent; the text itself where one side is no number."""
    e = _number(F.regexp_replace(extracted, keep, ""))
    g = _number(F.regexp_replace(truth, keep, ""))
    near = F.abs(e - g) < 0.01
    return F.when(F.coalesce(near, extracted == truth), 1.0).otherwise(0.0)


def score_list(extracted: Column, truth: Column) -> Column:
    """Share of equal items at equal places; 0 where the counts differ."""

    def share(p: Column) -> Column:
        same = F.filter(
            F.zip_with(p["e"], p["g"], lambda a, b: strip(a) == strip(b)), lambda x: x
        )
        return F.when(F.size(p["e"]) != F.size(p["g"]), 0.0).otherwise(
            F.size(same).cast("double") / F.size(p["g"])
        )

    halves = F.struct(
        F.split(extracted, r"\|", -1).alias("e"), F.split(truth, r"\|", -1).alias("g")
    )
    return F.when(extracted == truth, 1.0).otherwise(let(halves, share))


def score_date(extracted: Column, truth: Column) -> Column:
    keep = r"[^0-9/\-]"
    same = F.regexp_replace(extracted, keep, "") == F.regexp_replace(truth, keep, "")
    return F.when(same, 1.0).otherwise(0.0)


def score_text(extracted: Column, truth: Column) -> Column:
    return (
        F.when(extracted == truth, 1.0)
        .when(F.contains(truth, extracted) | F.contains(extracted, truth), 0.8)
        .otherwise(0.0)
    )


def truth_missing(truth: Column, field: Column | str, zero_is_missing: bool = True) -> Column:
    """No truth: absent, empty, or (numeric fields) a number equal to zero."""
    missing = F.coalesce(truth, F.lit("")) == ""
    if not zero_is_missing or (isinstance(field, str) and field not in S.NUMERIC_TRUTH_FIELDS):
        return missing
    number = F.when(
        truth.rlike(r"^\s*[+-]?[0-9.]+([eE][+-]?[0-9]+)?\s*$"), _number(truth)
    )
    zero = F.coalesce(number == 0.0, F.lit(False))
    return missing | (zero if isinstance(field, str) else is_in(field, S.NUMERIC_TRUTH_FIELDS) & zero)


def field_scorer(zero_is_missing: bool = True) -> Scorer:
    """0 to 1. Fields named ``DATE`` use the date rule; a truth of zero counts as no truth
    unless ``zero_is_missing`` is off."""

    def facts(e: Column, g: Column, f: Column | str) -> dict[str, Column]:
        return {
            "no_truth": truth_missing(g, f, zero_is_missing),
            "empty": F.coalesce(e, F.lit("")) == "",
            "e": F.lower(strip_value(e)),
            "g": F.lower(strip_value(g)),
        }

    def rule(x: Facts, f: Column | str) -> Column:
        e, g = x["e"], x["g"]
        first = F.when(x["no_truth"], F.when(x["empty"], 1.0).otherwise(0.0)).when(x["empty"], 0.0)
        rules = (
            (S.AMOUNT_FIELDS, lambda: score_amount(e, g)),
            (S.LIST_FIELDS, lambda: score_list(e, g)),
            (S.DATE_FIELDS, lambda: score_date(e, g)),
        )
        return _by_field(first, f, rules, lambda: score_text(e, g))

    return Scorer(facts, rule)


def documented_scorer() -> Scorer:
    """Second rule set: markers of absence on both sides agree, amounts keep their sign."""

    def absent(c: Column) -> Column:
        return F.coalesce(F.upper(c).isin(*S.NA_VARIANTS), F.lit(True))

    def facts(e: Column, g: Column, f: Column | str) -> dict[str, Column]:
        return {
            "no_truth": absent(g),
            "no_value": absent(e),
            "empty": F.coalesce(e, F.lit("")) == "",
            "e": F.lower(strip_value(e)),
            "g": F.lower(strip_value(g)),
        }

    def rule(x: Facts, f: Column | str) -> Column:
        e, g = x["e"], x["g"]
        first = F.when(x["no_truth"], F.when(x["no_value"], 1.0).otherwise(0.0)).when(x["empty"], 0.0)
        rules = (
            (S.MATCH_AMOUNT_FIELDS, lambda: score_amount(e, g, r"[^0-9.\-]")),
            (S.DOCUMENTED_LIST_FIELDS, lambda: score_list(e, g)),
            (S.DOCUMENTED_DATE_FIELDS, lambda: score_date(e, g)),
        )
        return _by_field(first, f, rules, lambda: score_text(e, g))

    return Scorer(facts, rule)


score_field = field_scorer()
score_field_documented = documented_scorer()


def match_amount(extracted: Column, truth: Column) -> Column:
    """First number of each within a cent; null where either has none."""
    first = "([0-9.]+)"
    e = _number(F.regexp_extract(extracted, first, 1))
    g = _number(F.regexp_extract(truth, first, 1))
    return F.abs(g - e) < 0.01


def match_address(extracted: Column, truth: Column) -> Column:
    """At least 70 % of the distinct words of the truth are there."""
    return let(
        F.struct(
            F.array_distinct(words(extracted)).alias("e"), F.array_distinct(words(truth)).alias("g")
        ),
        lambda p: F.size(F.array_intersect(p["g"], p["e"])) >= F.size(p["g"]) * 0.7,
    )


def match_set(extracted: Column, truth: Column) -> Column:
    """Equal sets of comma-separated items."""

    def items(c: Column) -> Column:
        return F.sort_array(F.array_distinct(F.transform(F.split(c, ",", -1), strip)))

    return items(extracted) == items(truth)


def field_matcher() -> Scorer:
    """True or false per field; absent values count as ``N/A``."""

    def normal(c: Column) -> Column:
        return F.lower(strip_value(F.coalesce(c, F.lit("N/A"))))

    def facts(e: Column, g: Column, f: Column | str) -> dict[str, Column]:
        return {"e": normal(e), "g": normal(g)}

    def rule(x: Facts, f: Column | str) -> Column:
        e, g = x["e"], x["g"]
        first = F.when(e == g, True).when((e == "n/a") | (g == "n/a"), False)
        rules = (
            (S.MATCH_AMOUNT_FIELDS, lambda: F.coalesce(match_amount(e, g), F.lit(False))),
            (S.MATCH_ADDRESS_FIELDS, lambda: match_address(e, g)),
            (S.MATCH_SET_FIELDS, lambda: match_set(e, g)),
        )
        return _by_field(first, f, rules, lambda: F.lit(False))

    return Scorer(facts, rule)


match_field = field_matcher()
