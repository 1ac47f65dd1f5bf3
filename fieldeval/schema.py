"""Field list, thresholds and word lists used as defaults throughout the package.

Everything here is configuration: each operator takes these values as arguments.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class FieldSpec:
    """An ordered field list with weights.

    The list is configuration and part of the plan, as array and map literals. A list that
    is data is a DataFrame instead, see ``operators.fields.restrict_to_fields``.
    """

    names: tuple[str, ...]
    weights: tuple[float, ...]

    @staticmethod
    def of(names: Iterable[str], weights: Mapping[str, float] | None = None) -> FieldSpec:
        ordered = tuple(dict.fromkeys(names))
        given = weights or {}
        return FieldSpec(ordered, tuple(float(given.get(n, 1.0)) for n in ordered))

    def __len__(self) -> int:
        return len(self.names)

    def items(self) -> list[tuple[int, str, float]]:
        """(ordinal starting at 1, name, weight) in list order."""
        return [(i, n, w) for i, (n, w) in enumerate(zip(self.names, self.weights), 1)]


@dataclass(frozen=True)
class Bands:
    """Thresholds for a quality band over field counts."""

    excellent: float = 12
    good: float = 8
    fair: float = 5


@dataclass(frozen=True)
class SpeedBands:
    """Upper limits in seconds of the speed bands."""

    very_fast: float = 15.0
    fast: float = 25.0
    moderate: float = 40.0


# The fields of a business document, in report order.
BUSINESS_FIELDS = (
    "DOCUMENT_TYPE",
    "SUPPLIER",
    "ABN",
    "PAYER_NAME",
    "PAYER_ADDRESS",
    "PAYER_PHONE",
    "PAYER_EMAIL",
    "INVOICE_DATE",
    "DUE_DATE",
    "GST",
    "TOTAL",
    "SUBTOTAL",
    "SUPPLIER_WEBSITE",
    "QUANTITIES",
    "PRICES",
    "BUSINESS_ADDRESS",
    "BUSINESS_PHONE",
    "BANK_NAME",
    "BSB_NUMBER",
    "BANK_ACCOUNT_NUMBER",
    "ACCOUNT_HOLDER",
    "STATEMENT_PERIOD",
    "OPENING_BALANCE",
    "CLOSING_BALANCE",
    "DESCRIPTIONS",
)

DEFAULT_SPEC = FieldSpec.of(BUSINESS_FIELDS)

# Field groups of the scoring rules.
NUMERIC_TRUTH_FIELDS = ("GST", "TOTAL", "SUBTOTAL")
AMOUNT_FIELDS = ("GST", "TOTAL", "SUBTOTAL")
LIST_FIELDS = ("ITEMS", "QUANTITIES", "PRICES")
DATE_FIELDS = ("DATE",)
MATCH_AMOUNT_FIELDS = ("GST", "TOTAL", "SUBTOTAL", "OPENING_BALANCE", "CLOSING_BALANCE")
MATCH_ADDRESS_FIELDS = ("PAYER_ADDRESS", "BUSINESS_ADDRESS")
MATCH_SET_FIELDS = ("QUANTITIES", "PRICES", "DESCRIPTIONS")
DOCUMENTED_LIST_FIELDS = ("QUANTITIES", "PRICES", "DESCRIPTIONS")
DOCUMENTED_DATE_FIELDS = ("INVOICE_DATE", "DUE_DATE")
NA_VARIANTS = ("N/A", "NA", "", "NAN", "NULL", "NONE", "NIL")

# Template words that are no field names.
TEMPLATE_WORDS = ("CORRECT", "WRONG", "EXAMPLE")

# Special tokens removed from responses.
SPECIAL_TOKENS = (
    "<|begin_of_text|>",
    "<|end_of_text|>",
    "<|start_header_id|>",
    "<|end_header_id|>",
    "<|eot_id|>",
    "<|reserved_special_token_",
    "<pad>",
    "</s>",
)

# Words that may repeat without limit when word repeats are capped.
FREE_WORDS = ("and", "or", "the", "a", "an", "is", "are", "was", "were")

# Words ignored when looking for a repeated token.
COMMON_WORDS = (
    "the",
    "and",
    "or",
    "a",
    "an",
    "is",
    "are",
    "to",
    "of",
    "in",
    "for",
    "with",
    "n/a",
)

# Punctuation stripped from a word before counting it.
WORD_PUNCTUATION = ".,!?;:"

# Markers that end the useful part of a response, in order of precedence.
END_MARKERS = (
    "**END OF",
    "END OF DOCUMENT",
    "END OF OUTPUT",
    "END OF FILE",
    "Note:",
    "NOTE:",
    "Answer:",
    "Final Answer:",
    "The output is exactly",
    "The above output",
    "Please ensure",
    "I apologize",
    "I hope it is correct",
)

# Phrases that mark a line as an instruction.
INSTRUCTION_PHRASES = (
    "example:",
    "format:",
    "output:",
    "instruction:",
    "required output format",
    "answer:",
    "final answer:",
)

# Fuel words and bank words for document classification.
FUEL_WORDS = (
    "13ulp",
    "ulp",
    "unleaded",
    "diesel",
    "litre",
    " l ",
    ".l ",
    "price/l",
    "per litre",
    "fuel",
)
BANK_WORDS = (
    "account",
    "balance",
    "transaction",
    "deposit",
    "withdrawal",
    "bsb",
    "opening balance",
    "closing balance",
    "statement period",
    "account number",
    "sort code",
    "debit",
    "credit",
    "available balance",
    "current balance",
)

# Limits and default sizes.
MAX_NEW_TOKENS = 512
CHARS_PER_TOKEN = 5
PLAIN_CLIP_CHARS = 1000
LONG_RESPONSE_CHARS = 2000
SINGLE_LINE_CHARS = 200
GPU_LIMIT_GB = 16.0
GPU_SAFETY_MARGIN = 0.85
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tiff", "webp")

# Parameter counts by model size name.
MODEL_PARAMETERS = {
    "InternVL3-1B": 900_000_000,
    "InternVL3-2B": 2_000_000_000,
    "InternVL3-8B": 8_000_000_000,
    "InternVL3-9B": 9_000_000_000,
    "InternVL3-14B": 15_000_000_000,
    "InternVL3-38B": 38_000_000_000,
    "InternVL3-78B": 78_000_000_000,
}
DEFAULT_PARAMETERS = 8_000_000_000
