"""Response text: cleaning, repetition measures and classification (all row-local)."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldeval import schema as S
from fieldeval.functions.base import LINE_SPACE, NON_BLANK_SPACE, SPACE, any_contains, col_of, let, strip, strip_value, words

# A possessive repeat keeps the regex engine from recursing once per ``N/A``, so a text with
# tens of thousands of them does not overflow the stack. The look-aheads only turn away
# places where no run can begin.
_NA_RUN = rf"(?iU)(?![!-MO-mo-~])(?<!{SPACE})(?:{SPACE}*+N/A{SPACE}*+){{3,}}+"


def strip_special_tokens(c: Column | str, tokens: Iterable[str] = S.SPECIAL_TOKENS) -> Column:
    """Delete literal tokens; a token that is only a prefix leaves its tail in place."""
    listed = list(tokens)

    def without(x: Column) -> Column:
        out = x
        for t in listed:
            out = F.replace(out, F.lit(t), F.lit(""))
        # A text that has not even the first character of one is not searched for each.
        return F.when(any_contains(x, dict.fromkeys(t[:1] for t in listed)), out).otherwise(x)

    return let(col_of(c), without)


def collapse_na_runs(c: Column | str) -> Column:
    """Shorten runs of three or more ``N/A`` in any case to a single one.

    Runs that need white space between the repeats are runs of this kind too, so one pass
    leaves none of them.
    """
    return let(
        col_of(c),
        lambda x: F.when(
            x.rlike(rf"/[Aa]{SPACE}*+[Nn]/[Aa]"), F.regexp_replace(x, _NA_RUN, " N/A")
        ).otherwise(x),
    )


def drop_repeated_lines(c: Column | str, sep: str = "\n") -> Column:
    """Drop blank pieces and pieces equal to the piece kept before them."""

    def keep(ps: Column) -> Column:
        return F.filter(
            ps, lambda p, i: (i == 0) | (strip(p) != strip(F.get(ps, i - 1)))
        )

    def kept(x: Column) -> Column:
        pieces = F.filter(F.split(x, r"\Q" + sep + r"\E"), lambda p: strip(p) != "")
        one = F.when(strip_value(x) != "", x).otherwise("")
        return F.when(F.contains(x, F.lit(sep)), F.array_join(let(pieces, keep), sep)).when(x.isNotNull(), one)

    return let(col_of(c), kept)


def _word_key(w: Column) -> Column:
    return F.btrim(F.lower(w), F.lit(S.WORD_PUNCTUATION))


# Lines end at line feeds alone. What follows the white space at the start of one can't be white space.
_LINES = "(?md)"
_LINE = rf"{_LINES}^{LINE_SPACE}*+"


def _recurring(sorted_words: Column, more_than: int, but: Iterable[str]) -> tuple[Column, str]:
    """A text with a line for each of the sorted words, and the pattern that finds each word that
    occurs more often and is not listed: equal words are lines below each other."""
    listed = "|".join(re.escape(w) for w in but)
    other = rf"(?!(?:{listed})$)" if listed else ""
    often = rf"(?=([^\n]*+)(?:\n\1$){{{more_than}}})"
    return F.array_join(sorted_words, "\n"), rf"{_LINES}^{often}{other}\1(?:\n\1$)++"


# Words that occur too often in one text, beyond which its words are sorted by key and place.
_FEW = 16


def cap_word_repeats(
    c: Column | str, cap: int = 2, free: Iterable[str] = S.FREE_WORDS
) -> Column:
    """Keep the first ``cap`` occurrences of each word; texts under three words stay.

    Words are sorted, so that those that occur too often are found by one pattern. Where they are few,
    their first places are looked up and one pass leaves all their other places out; else words are
    sorted by (key, position), where an occurrence is too many when the entry ``cap`` places before
    it has the same key.
    """
    text = col_of(c)
    free_words = list(free)
    edges = "[" + re.escape(S.WORD_PUNCTUATION) + "]"

    def keep(entries: Column) -> Column:
        return F.filter(
            entries,
            lambda e, i: (i < cap)
            | (F.get(entries, i - cap)["key"] != e["key"])
            | e["key"].isin(*free_words),
        )

    def by_sorting(ws: Column) -> Column:
        entries = F.transform(
            ws,
            lambda w, i: F.struct(
                _word_key(w).alias("key"), i.alias("pos"), w.alias("word")
            ),
        )
        kept = let(F.sort_array(entries), keep)
        in_order = F.sort_array(
            F.transform(kept, lambda e: F.struct(e["pos"].alias("pos"), e["word"].alias("word")))
        )
        return F.transform(in_order, lambda e: e["word"])

    def first_places(keys: Column, word: Column) -> Column:
        """Places, from 1, of the first ``cap`` occurrences of a word that has more."""

        def and_next(found: Column) -> Column:
            last = F.element_at(found, -1)
            rest = F.slice(keys, last + 1, F.size(keys))
            return F.array_append(found, last + F.array_position(rest, word).cast("int"))

        found = F.array(F.array_position(keys, word).cast("int"))
        for _ in range(cap - 1):
            found = let(found, and_next)
        return found

    def by_places(ws: Column, keys: Column, often: Column) -> Column:
        def kept(places: Column) -> Column:
            return F.filter(
                ws, lambda w, i: ~F.array_contains(often, F.get(keys, i)) | F.array_contains(places, i + 1)
            )

        return let(F.flatten(F.transform(often, lambda w: first_places(keys, w))), kept)

    def keys_of(joined: Column) -> Column:
        """Words lower-cased, without punctuation at the ends."""
        # A run is looked at from its first mark on, so that a long one inside a word is read once.
        runs = rf"{edges}(?:(?<!{edges}{edges}){edges}*+(?= |\z)|(?<= {edges}|^{edges}){edges}*+)"
        return F.split(F.regexp_replace(F.lower(joined), runs, ""), " ")

    def capped(ws: Column, joined: Column, keys: Column) -> Column:
        lines, pattern = _recurring(F.sort_array(keys), cap, free_words)

        def chosen(often: Column) -> Column:
            n = F.size(often)
            kept = F.when(n <= _FEW, by_places(ws, keys, often)).otherwise(by_sorting(ws))
            return F.when(n == 0, joined).otherwise(F.array_join(kept, " "))

        return let(F.regexp_extract_all(lines, F.lit(pattern), F.lit(1)), chosen)

    def of_words(ws: Column) -> Column:
        # One inside the other: what a lambda returns is copied, and so only the text is.
        if cap < 1:
            found = F.array_join(by_sorting(ws), " ")
        else:
            found = let(F.array_join(ws, " "), lambda x: let(keys_of(x), lambda keys: capped(ws, x, keys)))
        return F.when(F.size(ws) < 3, text).otherwise(found)

    return let(words(text), of_words)


def single_spaced(c: Column) -> Column:
    """Every run of white space as one blank; single blanks are passed over unmatched."""

    def spaced(x: Column) -> Column:
        found = F.regexp_replace(x, f"(?![!-~])(?: (?![!-~]){SPACE}++|(?! ){NON_BLANK_SPACE}{SPACE}*+)", " ")
        return F.when(F.contains(x, F.lit("  ")) | x.rlike(NON_BLANK_SPACE), found).otherwise(x)

    return let(c, spaced)


def squeeze_space(c: Column | str) -> Column:
    return strip(single_spaced(col_of(c)))


def clip_text(c: Column | str, max_chars: int) -> Column:
    text = col_of(c)
    return F.when(
        F.length(text) > max_chars, F.concat(F.left(text, F.lit(max_chars)), F.lit("..."))
    ).otherwise(text)


def clean_response(
    c: Column | str,
    enabled: bool = True,
    max_tokens: int = S.MAX_NEW_TOKENS,
    line_sep: str = "\\n",
) -> Column:
    """The whole cleaning chain; null and blank become the empty string.

    ``line_sep`` defaults to the two characters backslash and n, so that real line breaks
    are squeezed to spaces later and not treated as separators here.
    """
    raw = F.coalesce(col_of(c), F.lit(""))
    if not enabled:
        return strip(clip_text(squeeze_space(raw), S.PLAIN_CLIP_CHARS))
    out = collapse_na_runs(strip_special_tokens(strip(raw)))
    out = let(out, lambda x: drop_repeated_lines(x, line_sep))
    out = let(out, lambda x: cap_word_repeats(x))
    # Leading space survives the squeeze and counts towards the clip limit.
    out = single_spaced(out)
    out = let(out, lambda x: clip_text(x, max_tokens * S.CHARS_PER_TOKEN))
    return let(out, strip_value)


def _share_of_frequent(sorted_keys: Column, threshold: float) -> Column:
    """Distinct keys seen at least ``threshold`` times over distinct keys."""
    need = max(1, -int(-threshold // 1))

    def share(ks: Column) -> Column:
        first = F.filter(
            F.transform(
                ks,
                lambda k, i: F.when(
                    (i == 0) | (F.get(ks, i - 1) != k),
                    F.coalesce(F.get(ks, i + (need - 1)) == k, F.lit(False)),
                ),
            ),
            lambda f: f.isNotNull(),
        )
        return let(
            first,
            lambda f: F.when(F.size(f) == 0, F.lit(0.0)).otherwise(
                F.size(F.filter(f, lambda x: x)).cast("double") / F.size(f)
            ),
        )

    return let(sorted_keys, share)


def word_repetition(c: Column | str, threshold: float = 3) -> Column:
    """Share of distinct words that occur at least ``threshold`` times."""
    return let(
        words(F.coalesce(col_of(c), F.lit(""))),
        lambda ws: F.when(F.size(ws) < 3, F.lit(0.0)).otherwise(
            _share_of_frequent(F.sort_array(F.transform(ws, _word_key)), threshold)
        ),
    )


def phrase_repetition(c: Column | str, threshold: float = 2) -> Column:
    """Share of distinct adjacent word pairs that occur at least ``threshold`` times."""

    def pairs(ws: Column) -> Column:
        return F.transform(
            F.slice(ws, F.lit(1), F.size(ws) - 1),
            lambda w, i: F.lower(F.concat(w, F.lit(" "), F.get(ws, i + 1))),
        )

    return let(
        words(F.coalesce(col_of(c), F.lit(""))),
        lambda ws: F.when(F.size(ws) < 3, F.lit(0.0)).otherwise(
            _share_of_frequent(F.sort_array(pairs(ws)), threshold)
        ),
    )


def repetition_metrics(
    df: DataFrame, col: str, word_threshold: float = 3, phrase_threshold: float = 2, enabled: bool = True
) -> DataFrame:
    """Shares of frequent words and phrases; 0 where repetition control is off."""
    if not enabled:
        return df.withColumns({n: F.lit(0.0) for n in ("word_repetition", "phrase_repetition")})
    return df.withColumns(
        {
            "word_repetition": word_repetition(col, word_threshold),
            "phrase_repetition": phrase_repetition(col, phrase_threshold),
        }
    )


def is_repetitive(threshold: float = 0.3, enabled: bool = True) -> Column:
    """On the two columns added by :func:`repetition_metrics`; false where control is off."""
    if not enabled:
        return F.lit(False)
    return (F.col("word_repetition") > threshold) | (F.col("phrase_repetition") > threshold)


def limit_tokens(c: Column | str, limit: int = S.MAX_NEW_TOKENS, enabled: bool = True) -> Column:
    return F.least(col_of(c), F.lit(limit)) if enabled else col_of(c)


def needs_cleaning(c: Column | str) -> Column:
    text = col_of(c)
    return any_contains(text, ("**", "```", "Answer:")) | (
        F.length(text) > S.LONG_RESPONSE_CHARS
    )


def strip_markdown(c: Column | str) -> Column:
    text = col_of(c)
    picked = (
        F.when(F.contains(text, F.lit("```")), strip(F.substring_index(text, "```", 1)))
        .when(
            F.contains(text, F.lit("**Answer:**")),
            strip(F.split_part(text, F.lit("**Answer:**"), F.lit(2))),
        )
        .otherwise(text)
    )
    return F.regexp_replace(F.replace(picked, F.lit("**"), F.lit("")), rf"\*{SPACE}*", "")


def cut_at_marker(c: Column | str, markers: Iterable[str] = S.END_MARKERS) -> Column:
    """Keep the text before the first marker, first in list order, that occurs."""
    found = list(markers)

    def cut(x: Column) -> Column:
        chain = F.when(F.lit(False), x)
        for m in found:
            chain = chain.when(F.contains(x, F.lit(m)), strip(F.substring_index(x, m, 1)))
        return chain.otherwise(x)

    return let(col_of(c), cut)


def cut_at_na_run(c: Column | str, n: int = 10) -> Column:
    """Cut where a run of at least ``n`` ``N/A`` begins."""
    pattern = rf"(?sU)\b(?:N/A{SPACE}*+){{{n},}}+.*+$"
    return let(
        col_of(c),
        lambda x: F.when(x.rlike(pattern), strip(F.regexp_replace(x, pattern, ""))).otherwise(x),
    )


def prepare_for_parsing(c: Column | str) -> Column:
    return cut_at_na_run(cut_at_marker(strip_markdown(c)))


def extraction_method(c: Column | str, common: Iterable[str] = S.COMMON_WORDS) -> Column:
    """Label a response by how clean its ``KEY: value`` lines are.

    Lines are counted by patterns that match each of them once, on the whole text: cut into an
    array, every test of every line would be interpreted.
    """
    text = col_of(c)
    common_words = list(common)

    total = F.regexp_count(text, F.lit(rf"{_LINE}[^\n]"))
    pairs = F.regexp_count(text, F.lit(rf"{_LINE}(?![#*])[^:\n]*+:"))
    markdown = (
        F.contains(text, F.lit("**"))
        | text.rlike(rf"{_LINE}[#*\-|]")
        | text.rlike(rf"{_LINES}^[^:_\n]*+_[^:_\n]*+_[^:\n]*+$")
    )
    joined, often = _recurring(F.sort_array(words(F.lower(text))), 3, common_words)
    facts = F.struct(
        total.alias("total"), pairs.alias("pairs"), markdown.alias("markdown"), joined.rlike(often).alias("repeated")
    )

    def label(f: Column) -> Column:
        clean = (f["total"] > 0) & (f["pairs"] / F.greatest(f["total"], F.lit(1)) > 0.8)
        return (
            F.when(clean & f["markdown"], "clean_with_markdown")
            .when(clean & f["repeated"], "clean_with_repetition")
            .when(clean, "clean_extraction")
            .when(f["markdown"] & ~f["repeated"], "markdown_fallback")
            .when(f["repeated"], "repetition_control")
            .otherwise("complex_parsing")
        )

    return let(facts, label)


def classify_document(c: Column | str, rules: str = "detailed") -> Column:
    """Struct of document type, confidence and whether it counts as a business document."""
    if rules not in ("detailed", "simple"):
        raise ValueError(f"unknown rule set {rules!r}")

    def has(x: Column, *needles: str) -> Column:
        return any_contains(x, needles)

    # Patterns, phrases, types and confidences of both rule sets.
    fuel_amount = r"(?U)\d\.\d{2,3}\s*+l\b|\d\s*+litre"
    bank_account = r"(?U)\d{3}-\d{3}\s++\d{4,10}|\bbsb\b|\baccount\s++number\b"

    def detailed(x: Column) -> list[tuple[Column, str, float]]:
        return [
            (has(x, "fuel_receipt", "fuel receipt"), "fuel_receipt", 0.90),
            (has(x, *S.FUEL_WORDS) | x.rlike(fuel_amount), "fuel_receipt", 0.95),
            (has(x, "fuel", "petrol"), "fuel_receipt", 0.85),
            (has(x, "tax_invoice", "tax invoice"), "tax_invoice", 0.85),
            (has(x, "tax") & has(x, "invoice"), "tax_invoice", 0.80),
            (has(x, "bank_statement", "bank statement"), "bank_statement", 0.90),
            (has(x, *S.BANK_WORDS) | x.rlike(bank_account), "bank_statement", 0.95),
            (has(x, "bank"), "bank_statement", 0.75),
            (has(x, "receipt"), "receipt", 0.75),
            (has(x, "invoice"), "tax_invoice", 0.70),
        ]

    def simple(x: Column) -> list[tuple[Column, str, float]]:
        return [
            (has(x, "fuel_receipt", "fuel receipt"), "fuel_receipt", 0.90),
            (has(x, "tax_invoice", "tax invoice"), "tax_invoice", 0.85),
            (has(x, "bank_statement", "bank statement"), "bank_statement", 0.85),
            (has(x, "receipt"), "receipt", 0.75),
            (has(x, "invoice"), "tax_invoice", 0.70),
        ]

    def decide(x: Column) -> Column:
        chain = F.when(F.lit(False), F.lit(None).cast("struct<type:string,confidence:double>"))
        for test, kind, conf in (detailed if rules == "detailed" else simple)(x):
            chain = chain.when(
                test, F.struct(F.lit(kind).alias("type"), F.lit(conf).alias("confidence"))
            )
        return chain.otherwise(
            F.struct(F.lit("unknown").alias("type"), F.lit(0.50).alias("confidence"))
        )

    return let(
        let(F.lower(col_of(c)), decide),
        lambda d: F.struct(
            d["type"].alias("document_type"),
            d["confidence"].alias("confidence"),
            ((d["type"] != "unknown") & (d["confidence"] > 0.7)).alias("is_business_document"),
        ),
    )


def response_length(c: Column | str) -> Column:
    return F.length(col_of(c))
