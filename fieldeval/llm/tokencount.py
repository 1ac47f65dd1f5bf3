"""Token counts of a text's sections from one encoding of the whole text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldeval.llm.common import records
from fieldeval.llm.tokens import RANKS, SPECIAL, VOCABULARY, ByteBpe, byte_bpe

#: Sections of a text as sorted, disjoint (start, end) in characters.
Sections = Callable[[str], list[tuple[int, int]]]


def lines(text: str) -> list[tuple[int, int]]:
    """Lines with their line feed; an empty text is one empty line."""
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, min(at + len(line) + 1, len(text))))
        at += len(line) + 1
    return out


def token_lengths(encoder: ByteBpe) -> np.ndarray:
    """Bytes of each id."""
    lengths = np.zeros(max(encoder.ranks.values()) + 2, np.int64)
    for data, rank in encoder.ranks.items():
        lengths[rank] = len(data)
    lengths[-1] = len(SPECIAL)
    return lengths


def token_spans(text: str, ids: list[int], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last character of each token; a token that holds part of a
    character's bytes spans the whole of it."""
    ends = np.cumsum(lengths[ids])
    data = np.frombuffer(text.encode(), np.uint8)
    character = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte
    if not len(ends):
        return ends, ends
    return character[np.concatenate([[0], ends[:-1]])], character[ends - 1] + 1


def attribute(start: np.ndarray, end: np.ndarray, sections: list[tuple[int, int]]) -> np.ndarray:
    """The section of each token, -1 for none: an interval join of two sorted lists.

    A token belongs to the section that holds most of its characters, to the earlier of
    equals. Tokens outside all sections belong to none.
    """
    if not sections:
        return np.full(len(start), -1)
    lows = np.array([low for low, _ in sections])
    highs = np.array([high for _, high in sections])
    first = np.searchsorted(highs, start, side="right")  # the first section that ends after it
    last = np.searchsorted(lows, end, side="left") - 1  # the last that starts before its end
    out = np.where(first <= last, first, -1)
    for k in np.flatnonzero(first < last).tolist():
        at = np.arange(first[k], last[k] + 1)
        shared = np.minimum(highs[at], end[k]) - np.maximum(lows[at], start[k])
        out[k] = at[shared.argmax()]
    return out


def section_counts(
    docs: DataFrame, sections: Sections = lines, vocabulary: str = VOCABULARY, ranks: str = RANKS
) -> DataFrame:
    """(doc_id, section, start, end, n_tokens, doc_tokens): a row for each section of each row.

    Every text is encoded once and whole, so the counts of sections that cover a text add up
    to doc_tokens. Null texts count as empty; repeated rows repeat; an empty table gives no
    rows; further columns are ignored.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(vocabulary, ranks)
        lengths = token_lengths(encoder)
        for batch in batches:
            doc_ids, numbers, starts, ends, counts, totals = [], [], [], [], [], []
            for doc_id, text in records(iter([batch])):
                text = text or ""
                ids = encoder.ids(text)
                spans = sections(text)
                of = attribute(*token_spans(text, ids, lengths), spans)
                doc_ids += [doc_id] * len(spans)
                numbers += range(len(spans))
                starts += [low for low, _ in spans]
                ends += [high for _, high in spans]
                counts += np.bincount(of[of >= 0], minlength=len(spans)).tolist()
                totals += [len(ids)] * len(spans)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()),
                    pa.array(numbers, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (starts, ends, counts, totals)),
                ],
                ["doc_id", "section", "start", "end", "n_tokens", "doc_tokens"],
            )

    schema = "doc_id long, section int, start long, end long, n_tokens long, doc_tokens long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, schema)
