"""``KEY: value`` parsing. Each parser maps one text to MAP<STRING,STRING> in its own row."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldeval import schema as S
from fieldeval.functions.base import OTHER_SPACE, any_contains, col_of, let, lines, strip
from fieldeval.functions.text import needs_cleaning, prepare_for_parsing, single_spaced
from fieldeval.schema import FieldSpec


def _last_wins(pairs: Column) -> Column:
    """array<struct<key,pos,value>> to a map; of equal keys the highest position stays. Only
    where keys are repeated are they sorted."""

    def keep(es: Column) -> Column:
        return F.filter(
            es, lambda e, i: F.coalesce(F.get(es, i + 1)["key"] != e["key"], F.lit(True))
        )

    def as_map(es: Column) -> Column:
        return F.map_from_arrays(es["key"], es["value"])

    def chosen(es: Column) -> Column:
        distinct = F.size(F.array_distinct(es["key"])) == F.size(es)
        return F.when(distinct, as_map(es)).otherwise(let(let(F.sort_array(es), keep), as_map))

    return let(pairs, chosen)


def _entry(key: Column, pos: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), pos.alias("pos"), value.alias("value"))


def parse_kv_tokens(c: Column | str, spec: FieldSpec | None = None) -> Column:
    """A word ending in ``:`` opens a key; its value runs to the next such word.

    A key without value gets ``N/A``; a key that is the last word is ignored. With ``spec``
    only listed keys are kept, though unlisted keys still end a value.
    """
    # With every run of white space as one blank, line feeds and tabs are free to mark keys: the
    # text is matched once, word by word without a step back, and cut at single characters then.
    marked = F.regexp_replace(
        F.trim(single_spaced(F.coalesce(col_of(c), F.lit("")))), r"(?:^| )([^ ]*+)(?<=:)", "\n$1\t"
    )

    def entries(parts: Column) -> Column:
        last = F.size(parts) - 1

        def entry(p: Column, i: Column) -> Column:
            value = F.trim(F.substring_index(p, "\t", -1))
            # Only the last key can have nothing after it because the text ends there.
            shown = F.coalesce(F.nullif(value, F.lit("")), F.when(i < last, F.lit("N/A")))
            # The key's own colon stands before the tab.
            return _entry(F.left(p, F.instr(p, "\t") - 2), i, shown)

        # What comes before the first key has no tab.
        return F.filter(F.transform(parts, entry), lambda e: (e["pos"] > 0) & e["value"].isNotNull())

    found = let(F.split(marked, "\n"), entries)
    if spec is not None:
        found = F.filter(found, lambda e: e["key"].isin(*spec.names))
    return _last_wins(found)


def _split_single_line(x: Column, spec: FieldSpec, strip: Callable[[Column], Column]) -> Column:
    names = "|".join(re.escape(n) for n in spec.names)
    # Names of one word end at the colon, which is looked for before they are tried one by one.
    ahead = "" if any(set(" :") & set(n) for n in spec.names) else "(?=[^ :]++:)"
    parts = F.split(F.regexp_replace(x, f" {ahead}({names}):", "\n$1:"), "\n")
    broken = F.array_remove(F.transform(parts, strip), "")
    return F.when(
        ~F.contains(x, F.lit("\n")) & (F.length(x) > S.SINGLE_LINE_CHARS), broken
    ).otherwise(F.split(x, "\n"))


def split_single_line(c: Column | str, spec: FieldSpec) -> Column:
    """Array of lines; one long line is broken before every known field name."""
    return let(strip(col_of(c)), lambda x: _split_single_line(x, spec, strip))


def parse_kv_lines(c: Column | str, spec: FieldSpec = S.DEFAULT_SPEC) -> Column:
    """Line-wise parser with key normalisation; lines without a usable key are skipped.

    Most texts hold no white space but blanks and line feeds, no asterisks, no quotes and no
    instruction: that is found once for the text, and none of it is looked for in every line then.
    """

    phrases = "|".join(re.escape(p) for p in S.INSTRUCTION_PHRASES)
    # Letters with any blanks and underscores between, before or after them.
    letters = r"^[_ ]*+\p{L}[\p{L}_ ]*+$"
    number = r"^\p{Nd}+\.\s*"

    def blanks_off(line: Column) -> Column:
        return F.trim(line)

    def wanted(line: Column) -> Column:
        return (
            F.contains(line, F.lit(":"))
            & ~F.startswith(line, F.lit("#"))
            & ~F.startswith(line, F.lit("NOTE:"))
            & ~F.startswith(line, F.lit("Note:"))
        )

    def named(key: Column, pos: Column, value: Column) -> Column:
        return _entry(F.replace(key, F.lit(" "), F.lit("_")), pos, value)

    def valid(e: Column) -> Column:
        return (e["value"] != "") & (F.length(e["key"]) > 1) & e["key"].rlike(letters)

    def pair(line: Column, pos: Column) -> Column:
        def cut(x: Column) -> Column:
            at = F.instr(x, ":")
            key = F.replace(F.upper(strip(F.left(x, at - 1))), F.lit("*"), F.lit(""))
            value = strip(F.replace(strip(F.substr(x, at + 1)), F.lit("*"), F.lit("")))
            value = strip(F.btrim(F.btrim(value, F.lit('"')), F.lit("'")))
            return named(key, pos, value)

        return let(F.regexp_replace(line, number, ""), cut)

    def plain_pair(line: Column, pos: Column) -> Column:
        def cut(x: Column) -> Column:
            key = F.upper(F.trim(F.substring_index(x, ":", 1)))
            return named(key, pos, F.trim(F.substr(x, F.instr(x, ":") + 1)))

        # A line that starts with a letter or the like has no number before it.
        return F.when((line >= "A") & (line < "\x7f"), cut(line)).otherwise(let(F.regexp_replace(line, number, ""), cut))

    def parsed(x: Column) -> Column:
        kept = F.filter(
            F.transform(_split_single_line(x, spec, strip), strip), lambda l: wanted(l) & ~F.lower(l).rlike(phrases)
        )
        return F.filter(F.transform(kept, pair), valid)

    def plainly_parsed(x: Column) -> Column:
        kept = F.filter(F.transform(_split_single_line(x, spec, blanks_off), blanks_off), wanted)
        return F.filter(F.transform(kept, plain_pair), valid)

    def chosen(x: Column) -> Column:
        told = let(F.lower(x), lambda l: any_contains(l, S.INSTRUCTION_PHRASES))
        plain = ~x.rlike(OTHER_SPACE[:-1] + "*\"']") & ~told
        return F.when(plain, plainly_parsed(x)).otherwise(parsed(x))

    return _last_wins(let(strip(F.coalesce(col_of(c), F.lit(""))), chosen))


def count_kv_lines(c: Column | str) -> Column:
    def counts(line: Column) -> Column:
        at = F.instr(line, ":")
        return (
            (at > 0)
            & (strip(F.left(line, at - 1)) != "")
            & (strip(F.substr(line, at + 1)) != "")
        )

    return F.size(F.filter(lines(F.coalesce(col_of(c), F.lit(""))), counts))


def has_kv(c: Column | str, min_pairs: int = 3) -> Column:
    def counts(line: Column) -> Column:
        at = F.instr(line, ":")
        key = F.replace(strip(F.left(line, at - 1)), F.lit("_"), F.lit(""))
        return (at > 0) & key.rlike(r"^\p{L}+$") & (strip(F.substr(line, at + 1)) != "")

    return F.size(F.filter(lines(F.coalesce(col_of(c), F.lit(""))), counts)) >= min_pairs


def parse_response(
    c: Column | str,
    spec: FieldSpec = S.DEFAULT_SPEC,
    enabled: bool = True,
    smart: bool = True,
) -> Column:
    """Route a response to the plain or the full parser; the choice is made row by row."""
    text = F.coalesce(col_of(c), F.lit(""))
    if not enabled:
        return parse_kv_tokens(text)
    full = parse_kv_lines(prepare_for_parsing(text), spec)
    if not smart:
        return full
    return F.when(needs_cleaning(text), full).otherwise(parse_kv_tokens(text))


def parse_responses(
    responses: DataFrame,
    col: str = "raw_text",
    spec: FieldSpec = S.DEFAULT_SPEC,
    enabled: bool = True,
    smart: bool = True,
) -> DataFrame:
    """Add ``extracted_fields`` to a table of responses."""
    return responses.withColumn("extracted_fields", parse_response(col, spec, enabled, smart))
