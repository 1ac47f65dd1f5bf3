"""Vector codes: parts of integer vectors named by their nearest codebook entries.

Distances come from dictionaries. For every dimension of a batch its distinct integers are
found and their squared differences to all entries are tabulated once; a vector's distance to
an entry is then a gather by dictionary code for each dimension, added over the part. All
arithmetic is on integers: 32 or 64 bits where a bound on the values proves that they suffice,
Python's own integers otherwise.

Vectors of different lengths have codebooks of their own. A length that does not divide by the
number of parts is cut at floor(k * length / parts), so parts differ by one component at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldeval.llm.common import written

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Vectors of which distances are held at a time.
BLOCK = 4096

#: Entries (entry, component) of every vector length.
Books = dict[int, np.ndarray]


class Assigned(NamedTuple):
    """Codes (vector, part) and distances (vector), the latter of any integer type."""

    codes: np.ndarray
    errors: np.ndarray


def bounds(length: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """Where each part starts and ends."""
    cuts = [k * length // parts for k in range(parts + 1)]
    return list(zip(cuts, cuts[1:]))


def floored(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite doubles; Python integers where 64 bits could overflow."""
    whole = np.floor(values * scale) if abs(values).max(initial=0) < 2.0**900 else None
    if whole is not None and abs(whole).max(initial=0) < 2.0**50:
        return whole.astype(np.int64)
    exact = [(n * scale) // d for n, d in (x.as_integer_ratio() for x in values.ravel().tolist())]
    return np.array(exact, object).reshape(values.shape)


def dictionary(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct integers, the place of each row's among them)."""
    if column.dtype == np.int64:
        low = column.min()
        if int(column.max()) - int(low) <= 4 * len(column) + 1024:
            above = column - low
            present = np.bincount(above) > 0
            return np.flatnonzero(present) + low, (np.cumsum(present) - 1)[above]
    values, codes = np.unique(column, return_inverse=True)
    return values, codes.reshape(-1)


def _kind(vectors: np.ndarray, book: np.ndarray) -> Any:
    """The narrowest type in which no distance can overflow."""
    most = max(int(abs(vectors).max(initial=0)), int(abs(book).max(initial=0)))
    reach = (2 * most) ** 2 * max(1, vectors.shape[1])
    return np.int32 if reach < 2**31 else np.int64 if reach < 2**62 else object


def assign(vectors: np.ndarray, book: np.ndarray, parts: int = PARTS) -> Assigned:
    """Nearest entry of every part (ties to the lower index) and distances summed over parts."""
    n, length = vectors.shape
    kind = _kind(vectors, book)
    if kind is not object:
        vectors, book = vectors.astype(np.int64), book.astype(np.int64)
    codes = np.zeros((n, parts), np.int64)
    errors = np.zeros(n, object if kind is object else np.int64)
    for part, (low, high) in enumerate(bounds(length, parts)):
        if low == high:
            continue
        found = [dictionary(vectors[:, k]) for k in range(low, high)]
        tables = [((v[:, None] - book[None, :, low + k]) ** 2).astype(kind) for k, (v, _) in enumerate(found)]
        for at in range(0, n, BLOCK):
            rows = slice(at, at + BLOCK)
            distance = tables[0][found[0][1][rows]]
            for table, (_, places) in zip(tables[1:], found[1:]):
                distance += table[places[rows]]
            best = distance.argmin(1)
            codes[rows, part] = best
            errors[rows] += distance[np.arange(len(best)), best]
    return Assigned(codes, errors)


def _valid(vector: Column) -> Column:
    """Vectors that are not null and hold no null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & fine


def kept_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, vector): rows with a sound vector; without a label column all are null."""
    named = F.col(label) if label in table.columns else F.lit(None).cast("int")
    return table.select(
        F.col(key).alias("vec_id"), named.alias("label"), F.col(vector).cast("array<double>").alias("vector")
    ).where(_valid(F.col("vector")))


def _matrices(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows of the batch, integer matrix) for each vector length of a batch."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for length in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == length)
        yield length, rows, floored(flat[starts[rows][:, None] + np.arange(length)])


def first_books(kept: DataFrame, entries: int = ENTRIES) -> Books:
    """Each length's entries: its vectors with the smallest ids (equal ids by their components,
    null ids last), fewer where there are fewer."""
    books: Books = {}
    sized = kept.select("vec_id", "vector", F.size("vector").alias("n"))
    for (length,) in sized.select("n").distinct().collect():
        order = (F.asc_nulls_last("vec_id"), F.asc("vector"))
        rows = sized.where(F.col("n") == length).orderBy(*order).limit(entries).collect()
        books[length] = floored(np.array([r["vector"] for r in rows], np.float64).reshape(len(rows), length))
    return books


def _next_books(kept: DataFrame, books: Books, parts: int) -> Books:
    """Entries replaced by the floored mean of their parts; those without parts stay.

    Each task sends one row for every entry and component at most, whatever its input.
    """
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for length, _, vectors in _matrices(batch.column(0)):
                book = shared.value[length]
                codes = assign(vectors, book, parts).codes
                total = sums.setdefault(length, np.zeros(book.shape, object))
                count = counts.setdefault(length, np.zeros((len(book), parts), np.int64))
                for part, (low, high) in enumerate(bounds(length, parts)):
                    count[:, part] += np.bincount(codes[:, part], minlength=len(book))
                    for k in range(low, high):
                        total[:, k] += _sums(codes[:, part], vectors[:, k], len(book))
        for length, total in sums.items():
            size = np.repeat(counts[length], [high - low for low, high in bounds(length, parts)], axis=1)
            entry, place = np.nonzero(size)
            yield pa.RecordBatch.from_pydict(
                {
                    "length": pa.array(np.full(len(entry), length), pa.int32()),
                    "entry": pa.array(entry, pa.int32()),
                    "place": pa.array(place, pa.int32()),
                    "total": pa.array([str(x) for x in total[entry, place]], pa.string()),
                    "n": pa.array(size[entry, place], pa.int64()),
                }
            )

    partial = kept.select("vector").mapInArrow(rows, "length int, entry int, place int, total string, n long")
    total = F.try_sum(F.col("total").try_cast("decimal(38,0)"))
    found = partial.groupBy("length", "entry", "place").agg(total.alias("total"), F.sum("n").alias("n"))
    out = {length: book.astype(object) for length, book in books.items()}
    for r in found.collect():
        if r["total"] is not None:
            out[r["length"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return {length: _narrow(book) for length, book in out.items()}


def _sums(codes: np.ndarray, column: np.ndarray, entries: int) -> np.ndarray:
    """Sum of a column for every entry, exact."""
    if column.dtype == np.int64 and int(abs(column).max(initial=0)) * len(column) < 2**53:
        return np.bincount(codes, column, entries).astype(np.int64).astype(object)
    out = np.zeros(entries, object)
    np.add.at(out, codes, column.astype(object))
    return out


def _narrow(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if abs(book).max(initial=0) < 2**50 else book


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books:
    """Codebooks of `kept_vectors` after some rounds over all of them.

    A codebook has `entries` rows of one vector's length, so what goes through the driver does
    not grow with the table. Sums beyond 38 digits leave an entry's component as it was.
    """
    books = first_books(kept, entries)
    for _ in range(rounds):
        books = _next_books(kept, books, parts)
    return books


def digest(book: np.ndarray, parts: int = PARTS) -> str:
    """SHA-256 of a codebook's integers by part, entry and position, joined by commas."""
    numbers = (str(int(x)) for low, high in bounds(book.shape[1], parts) for row in book[:, low:high] for x in row)
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def encode(kept: DataFrame, books: Books, parts: int = PARTS) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256); an error beyond a long is null."""
    shared = kept.sparkSession.sparkContext.broadcast((books, {n: digest(book, parts) for n, book in books.items()}))
    key, label = (kept.schema[name].dataType.simpleString() for name in ("vec_id", "label"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digests = shared.value
        for batch in batches:
            n = batch.num_rows
            codes, errors, sums = np.empty(n, object), np.empty(n, object), np.empty(n, object)
            for length, at, vectors in _matrices(batch.column(2)):
                found = assign(vectors, held[length], parts)
                text = found.codes.astype(np.uint8).tobytes().hex()
                codes[at] = [text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)]
                errors[at] = [e if e < 2**63 else None for e in found.errors.tolist()]
                sums[at] = digests[length]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array(codes.tolist(), pa.string()),
                    pa.array(errors.tolist(), pa.int64()),
                    pa.array(sums.tolist(), pa.string()),
                ],
                ["vec_id", "label", "code", "error", "codebooks_sha256"],
            )

    return kept.mapInArrow(rows, f"vec_id {key}, label {label}, code string, error long, codebooks_sha256 string")


def decode(code: str, book: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """The entries that a code names, as one vector."""
    found = bytes.fromhex(code)
    return np.concatenate([book[k, low:high] for k, (low, high) in zip(found, bounds(book.shape[1], parts))])


def codes(table: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every sound vector.

    Vectors that are null or hold null or non-finite components are left out; repeated rows
    each count and get a row; null ids come last in the choice of first entries; an error or
    sum of errors beyond a long is null; an empty table gives no rows; further columns are
    ignored. Label sums are taken per label first and
    joined back, so a label that many rows share is never gathered.
    """
    kept = kept_vectors(table)
    coded = written(encode(kept, train(kept)), "codes")
    total = F.try_sum(F.col("error").cast("decimal(38,0)")).try_cast("long")
    total = F.when(F.count("error") == F.count("*"), total)
    sums = coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of_label")
    both = coded.join(sums, F.col("label").eqNullSafe(F.col("of_label")))
    return both.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _assign_sql(n: int, books: str) -> str:
    """CTE a{n}: nearest entry of every vector's part."""
    return f"""a{n} AS (
  SELECT vec_id, label, part, v, min(struct_pack(d := d, e := entry)) AS best
  FROM (SELECT k.vec_id, k.label, k.part, k.v, b.entry,
               list_sum(list_transform(range(1, len(k.v) + 1), lambda j: (k.v[j] - b.v[j]) * (k.v[j] - b.v[j]))) AS d
        FROM kept k JOIN {books} b ON k.part = b.part)
  GROUP BY vec_id, label, part, v
)"""


def _books_sql(n: int, before: str) -> str:
    """CTE b{n}: entries replaced by the floored mean of their parts in a{n}."""
    return f"""b{n} AS (
  SELECT o.part, o.entry, coalesce(m.v, o.v) AS v FROM {before} o LEFT JOIN (
    SELECT part, e, list(CAST(floor_div AS BIGINT) ORDER BY j) AS v FROM (
      SELECT part, best.e AS e, j, CASE WHEN sum(v[j]) >= 0 THEN sum(v[j]) // count(*)
             ELSE -((-sum(v[j]) + count(*) - 1) // count(*)) END AS floor_div
      FROM (SELECT part, best, v, unnest(range(1, len(v) + 1)) AS j FROM a{n}) GROUP BY part, best.e, j)
    GROUP BY part, e) m ON m.part = o.part AND m.e = o.entry
)"""


CODES_SQL = f"""
WITH sound AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w,
         row_number() OVER (ORDER BY vec_id) - 1 AS n
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), kept AS (
  SELECT vec_id, label, n, part, list_slice(w, part * len(w) // 16 + 1, (part + 1) * len(w) // 16) AS v
  FROM sound, (SELECT unnest(range(16)) AS part)
), b0 AS (SELECT part, n AS entry, v FROM kept WHERE n < 64),
{_assign_sql(1, 'b0')}, {_books_sql(1, 'b0')},
{_assign_sql(2, 'b1')}, {_books_sql(2, 'b1')},
{_assign_sql(3, 'b2')}, coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', CAST(best.e AS INTEGER)), '' ORDER BY part) AS code,
         CAST(sum(best.d) AS BIGINT) AS error
  FROM a3 GROUP BY vec_id, label
), sums AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded, sums
"""
