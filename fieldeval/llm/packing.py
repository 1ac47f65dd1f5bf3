"""Bounded-space best-fit packing of documents into fixed-length sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldeval.llm.common import records, written
from fieldeval.llm.tokens import RANKS, VOCABULARY, byte_bpe

CAPACITY = 2048
#: Bins open at a time in one task.
OPEN_BINS = 65_536
#: Pieces that one task packs, about: enough that bins left open at its end don't count.
PIECES_PER_TASK = 100_000
END = 0


def pieces(ids: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else the first one is the rest."""
    n = len(ids)
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


class OpenBins:
    """Best fit over a fixed number of open bins, found by free space in a bitset."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN_BINS) -> None:
        self.capacity, self.most = capacity, most
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0  # bit f is set while a bin with free space f is open
        self.open = self.made = 0

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) of the next piece: the open bin that it leaves fullest, or a new one."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            found = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes first
            free, found = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            self.by_free[left].append(found)
            self.bits |= 1 << left
            self.open += 1
        return found, self.capacity - free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        self.open -= 1
        if not bins:
            self.bits &= ~(1 << free)
        return found


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """Pieces of every row of docs (doc_id, text), with the CRC-32 of their ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(vocabulary, ranks)
        for batch in batches:
            out = []
            for doc_id, text in records(iter([batch])):
                ids = np.array([*encoder.ids(text or ""), END], "<u4")
                for k, (at, n) in enumerate(pieces(ids)):
                    out.append((doc_id, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, _PIECE)


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bins = OpenBins()
    for batch in batches:
        task = batch.column(5).to_pylist()
        places = [bins.put(n) for n in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:5],
                pa.array([(t << 40) + b for t, (b, _) in zip(task, places)], pa.int64()),
                pa.array([offset for _, offset in places], pa.int64()),
            ],
            [*batch.schema.names[:5], "sequence_id", "offset"],
        )


def pack(docs: DataFrame) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece.

    A document is its ids and one end id; null text counts as empty, so it has the end id
    alone. Pieces are dealt to tasks by a hash of their row, each task packs its own, longest
    first, and numbers its sequences under its own number. Repeated rows are packed as often
    as they come; an empty table gives no rows; further columns are ignored.
    """
    cut = written(token_pieces(docs), "pieces")
    tasks = max(1, -(-cut.count() // PIECES_PER_TASK))
    # Long pieces first, so that short ones fill what is left; equal rows stay together.
    dealt = cut.repartition(tasks).withColumn("task", F.spark_partition_id().cast("long"))
    ordered = dealt.sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32")
    return ordered.mapInArrow(_packed_rows, f"{_PIECE}, sequence_id long, offset long")
