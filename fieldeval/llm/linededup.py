"""Line deduplication by an exact set-similarity join with prefix, position and length filters."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain, pairwise
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldeval.llm.common import SLICE, chunks, records, set_aside, sorted_runs, with_fields, written

#: Jaccard similarity from which two lines match: NUM / DEN.
NUM, DEN = 4, 5
#: Counters of the rarity sketch. Any common order of tokens gives exact results; the
#: counts only make it a good one, so their number needn't grow with the vocabulary.
SLOTS = 1 << 20
_BLOCK = 1 << 14
#: Lists of lines go out by broadcast up to so many lines, beyond it by shuffle.
BROADCAST_LINES = 4_000_000
#: Postings that need all their candidates go out by broadcast up to so many.
BROADCAST_SETS = 500_000
#: Lines of more distinct tokens have a signature of twice the bits.
LONG = 24
#: Rows under one token that are compared in one task; more are joined.
HOT = 16_384
#: Partners of a line under one token that are all tried where none is likely.
FEW = 64
#: Bytes of texts whose words are hashed at a time: what is held for them stays in the cache.
_TEXT_BYTES = 1 << 17
_NO_ID = -(1 << 63)
_PLACE = ("d", "line_no", "row_key")
_PLACE_SCHEMA = "d long, line_no int, row_key long"


def _table(seed: int, *shape: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, shape, np.uint64, endpoint=False)


_WHITE = b" \t\n\x0b\x0c\r"
_INSIDE = bytes(byte not in _WHITE for byte in range(256))
#: Random numbers of the bytes, 0 for white space. A word's hash is the sum of its bytes' numbers
#: times powers of an odd factor, taken along the text and divided by that of the word's start.
_BYTES = np.where(np.isin(np.arange(256), list(_WHITE)), np.uint64(0), _table(1, 256))
_FACTOR = 0x9E3779B97F4A7C1B
_SPAN = 1 << 20


def _powers(factor: int) -> np.ndarray:
    out = np.full(_SPAN, factor, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_FACTOR), _powers(pow(_FACTOR, -1, 1 << 64))


def _mixed(x: np.ndarray, factor: int) -> np.ndarray:
    """Each number spread over all its bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(factor)
    return x ^ (x >> np.uint64(29))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of a text, without a step in Python for each."""
    if len(text) > _SPAN:
        return _long_hashes(text)
    inside = np.frombuffer(text.translate(_INSIDE), np.bool_)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    value = np.take(_BYTES, np.frombuffer(text, np.uint8), mode="clip")
    value *= _UP[: len(value)]
    return _mixed(np.add.reduceat(value, starts) * _DOWN[starts], 0x9E3779B97F4A7C15), starts


_WORD_END = re.compile(rb"[ \t\n\x0b\x0c\r]|\Z")


def _long_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The same of a longer text, in pieces cut at white space. A word longer than a piece is cut
    from its start, and its parts' hashes are added, each mixed with its number."""
    hashes, starts = [], []
    at = 0
    while at < len(text):
        stop = len(text)
        if stop - at > _SPAN:
            stop = max(text.rfind(bytes([c]), at, at + _SPAN) for c in _WHITE) + 1
        if stop > at:
            some, where = word_hashes(text[at:stop])
        else:
            stop = _WORD_END.search(text, at).start()
            parts = [word_hashes(text[k : min(k + _SPAN, stop)])[0] for k in range(at, stop, _SPAN)]
            mixed = [_mixed(part + np.uint64(k), 0xD6E8FEB86659FD93) for k, part in enumerate(parts)]
            some, where = (sum(mixed) if len(mixed) > 1 else parts[0]), np.zeros(1, np.int64)
        hashes.append(some)
        starts.append(where + at)
        at = stop
    return np.concatenate(hashes), np.concatenate(starts)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with the place of each row: (d, row_key). Rows alike in id and text share one."""
    return docs.withColumn("d", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))).withColumn(
        "row_key", F.xxhash64("doc_id", "text")
    )


def _once(keyed: DataFrame) -> DataFrame:
    """One of the rows alike in id and text; rows without their like are not shuffled."""
    repeated = written(keyed.groupBy("d", "row_key").count().where("count > 1").select("d", "row_key"), "repeated")
    if repeated.isEmpty():
        return keyed
    many = keyed.join(repeated, ["d", "row_key"], "left_semi").dropDuplicates(["d", "row_key"])
    return keyed.join(repeated, ["d", "row_key"], "left_anti").unionByName(many)


def _texts(keyed: DataFrame, *more: str) -> DataFrame:
    return keyed.where("text is not null").select("d", "row_key", F.col("text").cast("binary").alias("text"), *more)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SLOTS - 1)).astype(np.int64)


def _blocks(parts: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for block, part in parts:
        if part.any():
            yield pa.RecordBatch.from_pydict(
                {"block": pa.array([block], pa.int32()), "counts": pa.array([part.astype("<i8").tobytes()], pa.binary())}
            )


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for block, counts in records(batches):
        part = np.frombuffer(counts, "<i8")
        sums[block] = sums[block] + part if block in sums else part
    yield from _blocks(iter(sums.items()))


_SCAN = f"h1 long, h2 long, {_PLACE_SCHEMA}, block int, counts binary"
_SCAN_NAMES = [part.split()[0] for part in _SCAN.split(", ")]


def _scan_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line with words: a digest of its words, and its place. At the end the
    task's counts of words, in blocks."""
    counts = np.zeros(SLOTS, np.int64)
    for part in chunks(batches, 2, _TEXT_BYTES):
        texts = Texts.of([text for _, _, text in part])
        if not len(texts.hashes):
            continue
        np.add.at(counts, _slots(texts.hashes), 1)
        d, row_key = (np.array([row[k] for row in part], np.int64)[texts.doc] for k in (0, 1))
        # The sum of the words' hashes, whatever their order.
        digests = (
            np.add.reduceat(_mixed(texts.hashes, factor), texts.low).view(np.int64)
            for factor in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
        )
        rows = len(texts.low)
        columns = (*digests, d, texts.line_no.astype(np.int32), row_key)
        rest = [pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *rest], _SCAN_NAMES)
    for batch in _blocks(enumerate(counts.reshape(-1, _BLOCK))):
        rest = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64())]
        yield pa.RecordBatch.from_arrays([*rest, *batch.columns], _SCAN_NAMES)


def rarity(scan: DataFrame) -> np.ndarray:
    """A 16-bit code of the count of each slot: 0 for one or none, then by the logarithm.

    SLOTS numbers come to the driver, however large the input is.
    """
    parts = scan.where("block is not null").select("block", "counts").repartition("block")
    counts = np.ones(SLOTS, np.int64)
    for block, data in parts.mapInArrow(_sum_rows, "block int, counts binary").collect():
        counts[block * _BLOCK : (block + 1) * _BLOCK] = np.frombuffer(data, "<i8")
    return np.floor(1024 * np.log2(np.maximum(counts, 1))).astype(np.uint16)


class Texts(NamedTuple):
    """Words of some texts. Line k, of those with words, begins at word low[k] and is
    line_no[k] of text doc[k]; number counts all lines of the texts before it."""

    hashes: np.ndarray
    low: np.ndarray
    doc: np.ndarray
    line_no: np.ndarray
    number: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes], held: np.ndarray | None = None) -> Texts:
        """All lines with words, or those of them that are held by their number."""
        text = b"\n".join(texts)
        hashes, starts = word_hashes(text)
        line = np.cumsum(np.frombuffer(text, np.uint8) == 10, dtype=np.int32)[starts]
        if held is not None:
            hashes, line = hashes[held[line]], line[held[line]]
        fresh = np.ones(len(line), bool)
        fresh[1:] = line[1:] != line[:-1]
        low = np.flatnonzero(fresh)
        number = line[low]
        first = first_numbers(texts)
        doc = np.searchsorted(first, number, side="right") - 1
        return cls(hashes, low, doc, number - first[doc], number)


def first_numbers(texts: list[bytes]) -> np.ndarray:
    """Lines of all texts before each."""
    lines = np.array([text.count(b"\n") + 1 for text in texts])
    return np.cumsum(lines) - lines


class Lines(NamedTuple):
    """Distinct tokens of lines: those of line ids[k], rarest first, are
    keys[bounds[k]:bounds[k + 1]]. A key is a rarity code and 48 bits of the token's hash, so
    keys are the order as well."""

    ids: np.ndarray
    keys: np.ndarray
    bounds: np.ndarray


def token_sets(texts: list[bytes], codes: np.ndarray | None, lines: list[list[int]], numbers: list[list[int]]) -> Lines:
    """The wanted lines of some texts: for each text their numbers in it, and their ids. Without
    codes the keys are whole hashes, in no order of rarity."""
    first = first_numbers(texts)
    sizes = [len(some) for some in lines]
    at = np.repeat(first, sizes) + np.fromiter(chain.from_iterable(lines), np.int64, sum(sizes))
    ids = np.full(int(first[-1]) + texts[-1].count(b"\n") + 1, -1)
    ids[at] = np.fromiter(chain.from_iterable(numbers), np.int64, len(at))
    found = Texts.of(texts, ids >= 0)
    keys = found.hashes
    if codes is not None:
        keys = (codes[_slots(keys)].astype(np.uint64) << np.uint64(48)) | (keys >> np.uint64(16))
    for a, b in pairwise([*found.low.tolist(), len(keys)]):
        keys[a:b].sort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    new[found.low] = True
    sizes = np.add.reduceat(new, found.low, dtype=np.int64) if len(found.low) else found.low
    return Lines(ids[found.number], keys[new], np.concatenate([[0], np.cumsum(sizes)]))


def first_lines(scan: DataFrame) -> DataFrame:
    """The first line of every distinct bag of words; ids ascend with the place."""
    lines = scan.where("block is null").groupBy("h1", "h2").agg(F.min(F.struct(*_PLACE)).alias("first"))
    first = lines.select("first.*").orderBy(*_PLACE)
    return written(first.withColumn("id", F.monotonically_increasing_id()), "sets")


_POSTING = "key long, id long, n int, at int, sign long, sign2 long"
_POSTING_NAMES = [part.split()[0] for part in _POSTING.split(", ")]


def among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which keys are among the wanted ones, which ascend and are not none."""
    spot = np.searchsorted(wanted, keys)
    return wanted[np.minimum(spot, len(wanted) - 1)] == keys


def postings(sets: DataFrame, keyed: DataFrame, codes: Any, only: Any = None) -> DataFrame:
    """A row for each set and token of its prefix, from the texts that hold the sets' lines; with
    `only`, ascending keys, for these alone."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 2, _TEXT_BYTES):
            lines = token_sets([row[2] for row in part], codes.value, [row[3] for row in part], [row[4] for row in part])
            sizes = np.diff(lines.bounds)
            line = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(lines.keys)) - lines.bounds[line]
            prefix = sizes - -(-NUM * sizes // DEN) + 1
            # A token counted once in all texts has no partner.
            pick = (at < prefix[line]) & (lines.keys >> np.uint64(48) > 0)
            if only is not None:
                pick = np.flatnonzero(pick)
                pick = pick[among(lines.keys[pick], only.value)]
                if not len(pick):
                    continue
            of = line[pick]
            number, keys, starts = of, lines.keys, lines.bounds[:-1]
            if only is not None:  # signatures of few lines
                shown = np.zeros(len(sizes), bool)
                shown[of] = True
                number = (np.cumsum(shown) - 1)[of]
                keys, line = keys[shown[line]], line[shown[line]]
                starts = np.cumsum(sizes[shown]) - sizes[shown]
            # Parity of the tokens under each of 64 bits, in long lines of two halves of the
            # tokens: two signatures differ in no more bits than their sets in tokens.
            bits = np.uint64(1) << (keys & np.uint64(63))
            second = (sizes > LONG)[line] & (keys >> np.uint64(6) & np.uint64(1) == 1)
            signs = (
                np.bitwise_xor.reduceat(np.where(half, bits, np.uint64(0)), starts).view(np.int64)
                for half in (~second, second)
            )
            columns = (
                lines.keys[pick].view(np.int64),
                lines.ids[of],
                sizes[of].astype(np.int32),
                at[pick].astype(np.int32),
                *(sign[number] for sign in signs),
            )
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _POSTING_NAMES)

    return _texts_with(keyed, sets).mapInArrow(rows, _POSTING)


def _fits(n: Any, at: Any, m: Any, other_at: Any, low: Callable[[Any, Any], Any]) -> Any:
    """Length and positional filter: whether two sets that share a token at these places can
    still match. Overlap o matches if o / (n + m - o) >= NUM / DEN."""
    length = (n * DEN >= m * NUM) & (m * DEN >= n * NUM)
    most = low(at, other_at) + low(n - at, m - other_at)
    return length & (most * (NUM + DEN) >= (n + m) * NUM)


#: hot: 0 for a pair (s, t), else a posting of a frequent key; 2 if it has no likely partner.
_FOUND = f"hot byte, s long, t long, more boolean, {_POSTING}"
_FOUND_NAMES = [part.split()[0] for part in _FOUND.split(", ")]


class Partners(NamedTuple):
    """Pairs (row, earlier row) that may match, whether the row has more of them, and which
    rows have a likely partner."""

    row: np.ndarray
    other: np.ndarray
    more: np.ndarray
    likely: np.ndarray


def partners(
    run: np.ndarray, n: np.ndarray, at: np.ndarray, sign: np.ndarray, sign2: np.ndarray, few: int, long: int
) -> Partners:
    """Earlier rows of the same run that pass all filters.

    A row whose signature differs from one by half the tokens that a match may differ in, or
    less, takes that one and looks no further. Else it takes the nearest and the `few` next to
    it in the run, which are all of them in most cases.
    """
    place = np.arange(len(run)) - np.searchsorted(run, run)
    best, count, least = np.full(len(run), -1), np.zeros(len(run), np.int64), np.full(len(run), 1 << 30)
    likely = np.zeros(len(run), bool)
    met: list[tuple[np.ndarray, np.ndarray]] = []
    index = np.flatnonzero(place)
    gap = 1
    while len(index):
        other = index - gap
        good = _fits(n[index], at[index], n[other], at[other], np.minimum)
        i, j = index[good], other[good]
        one, two = sign[i] ^ sign[j], sign2[i] ^ sign2[j]
        apart = np.where(
            (n[i] > long) & (n[j] > long),
            np.bitwise_count(one).astype(np.int64) + np.bitwise_count(two),
            np.bitwise_count(one ^ two),
        )
        room = (n[i] + n[j]) * (DEN - NUM) - apart * (NUM + DEN)
        near = room >= 0
        i, j, apart, room = i[near], j[near], apart[near], room[near]
        if len(i):
            count[i] += 1
            nearer = apart < least[i]
            best[i[nearer]], least[i[nearer]] = j[nearer], apart[nearer]
            # In short lines words that differ too often cancel out in the signature.
            likely[i] |= (room >= apart * (NUM + DEN)) & (n[i] >= 16)
            kept = count[i] <= few
            met.append((i[kept], j[kept]))
            index = index[~likely[index]]
        gap += 1
        index = index[place[index] >= gap]
    i, j = (np.concatenate(x) for x in zip(*met)) if met else (best[:0], best[:0])
    first = ~likely[i]
    row = np.flatnonzero((best >= 0) & (likely | (count > few)))
    more = np.concatenate([np.ones(len(row), bool), count[i[first]] > few])
    return Partners(np.concatenate([row, i[first]]), np.concatenate([best[row], j[first]]), more, likely)


def _sweep(batches: Iterator[pa.RecordBatch], most: int, few: int, long: int) -> Iterator[pa.RecordBatch]:
    """Pairs that may match from postings sorted by key and id. Rows of keys with more than
    `most` rows are compared within the pieces that they come in, and passed on."""
    for table, hot in sorted_runs(batches, 1, most):
        key = table.column(0).to_numpy()
        same = np.concatenate([[False], key[1:] == key[:-1], [False]])
        if not hot:  # most keys have one row alone
            table = table.filter(pa.array(same[1:] | same[:-1]))
        if not table.num_rows:
            continue
        columns = [table.column(k).combine_chunks() for k in range(len(_POSTING_NAMES))]
        key, ids, n, at = (columns[k].to_numpy() for k in range(4))
        run = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        signs = (columns[k].to_numpy().view(np.uint64) for k in (4, 5))
        found = partners(run, n.astype(np.int64), at.astype(np.int64), *signs, few, long)
        pick = found.likely[found.row] if hot else np.ones(len(found.row), bool)
        row, other, more = found.row[pick], found.other[pick], found.more[pick]
        empty = [pa.nulls(len(row), column.type) for column in columns[1:]]
        pairs = [np.zeros(len(row), np.int8), ids[row], ids[other], more, key[row]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, pairs), *empty], _FOUND_NAMES)
        if hot:
            none = pa.nulls(table.num_rows, pa.int64())
            kind = np.where(found.likely, 1, 2).astype(np.int8)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind), none, none, pa.nulls(table.num_rows, pa.bool_()), *columns], _FOUND_NAMES
            )


def _all_earlier(mine: DataFrame, postings: DataFrame) -> DataFrame:
    """mine (postings named s_*) with every earlier posting of the key that passes the filters."""
    met = mine.join(postings, mine.s_key == postings.key).where(F.col("id") < F.col("s_id"))
    met = met.where(_fits(F.col("s_n"), F.col("s_at"), F.col("n"), F.col("at"), F.least))
    one, two = (F.col(f"s_{c}").bitwiseXOR(F.col(c)) for c in ("sign", "sign2"))
    both = (F.col("s_n") > LONG) & (F.col("n") > LONG)
    apart = F.when(both, F.bit_count(one) + F.bit_count(two)).otherwise(F.bit_count(one.bitwiseXOR(two)))
    return met.where(apart * (NUM + DEN) <= (F.col("s_n") + F.col("n")) * (DEN - NUM))


def _named(postings: DataFrame) -> DataFrame:
    return postings.select(*[F.col(c).alias(f"s_{c}") for c in postings.columns])


def _few(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join, to broadcast only where its checked number of rows is small."""
    return F.broadcast(df) if rows <= BROADCAST_LINES else df


def _texts_with(keyed: DataFrame, sets: DataFrame) -> DataFrame:
    """(d, row_key, text, lines, ids): texts once each, with the numbers and ids of the sets' lines."""
    lists = sets.groupBy("d", "row_key").agg(F.collect_list(F.struct("line_no", "id")).alias("wanted"))
    lists = lists.select("d", "row_key", F.col("wanted.line_no").alias("lines"), F.col("wanted.id").alias("ids"))
    joined = _texts(keyed).join(_few(lists, sets.count()), ["d", "row_key"])
    return joined.select("d", "row_key", "text", "lines", "ids")


def _verified(pairs: DataFrame, sets: DataFrame, keyed: DataFrame) -> DataFrame:
    """The s (as id) of the written pairs of sets (s, t) that match by all their tokens."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 2, _TEXT_BYTES):
            lines = token_sets([row[2] for row in part], None, [row[3] for row in part], [row[4] for row in part])
            tokens = pa.ListArray.from_arrays(pa.array(lines.bounds, pa.int32()), pa.array(lines.keys.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(lines.ids), tokens], ["id", "tokens"])

    ids = pairs.select(F.explode(F.array("s", "t")).alias("id")).distinct()
    wanted = written(sets.join(_few(ids, 2 * pairs.count()), "id", "left_semi"), "wanted")
    tokens = written(_texts_with(keyed, wanted).mapInArrow(rows, "id long, tokens array<long>"), "tokens")
    for side in ("s", "t"):
        pairs = pairs.join(tokens.select(F.col("id").alias(side), F.col("tokens").alias(f"{side}_tokens")), side)
    shared = F.size(F.array_intersect("s_tokens", "t_tokens"))
    total = F.size("s_tokens") + F.size("t_tokens")
    matched = pairs.where(shared * (NUM + DEN) >= total * NUM).select(F.col("s").alias("id")).distinct()
    return written(matched, "matched")


def kept_lines(keyed: DataFrame) -> DataFrame:
    """Places of the lines with words that have no earlier match; keyed has no row twice."""
    scan = written(_texts(keyed).mapInArrow(_scan_rows, _SCAN), "scan")
    codes = keyed.sparkSession.sparkContext.broadcast(rarity(scan))
    sets = first_lines(scan)
    rows = postings(sets, keyed, codes)
    dealt = rows.repartition("key").sortWithinPartitions("key", "id")
    swept = written(dealt.mapInArrow(partial(_sweep, most=HOT, few=FEW, long=LONG), _FOUND), "swept")

    # Keys of very many rows: those without a likely partner nearby meet all in a join whose
    # large groups Spark splits; the last earlier one stands for the others.
    hot = swept.where("hot > 0").select("hot", *_POSTING_NAMES)
    met = _all_earlier(_named(hot.where("hot = 2").drop("hot")), hot).groupBy(
        F.col("s_id").alias("s"), F.col("s_key").alias("key")
    ).agg(F.max("id").alias("t"), (F.count("*") > 1).alias("more"))
    pairs = swept.where("hot = 0").select("s", "key", "t", "more").unionByName(met.select("s", "key", "t", "more"))
    tried = written(pairs.select("s", "t").distinct(), "tried")
    settled = _verified(tried, sets, keyed)

    # Sets of which no pair matches meet all others under the keys that have more.
    open_keys = pairs.where("more").select(F.col("s").alias("id"), "key").distinct().join(settled, "id", "left_anti")
    open_keys = written(open_keys, "open")
    number = open_keys.count()
    if number:
        some = written(sets.join(_few(open_keys.select("id").distinct(), number), "id", "left_semi"), "open-sets")
        mine = _named(postings(some, keyed, codes).join(_few(open_keys, number), ["id", "key"], "left_semi").select(_POSTING_NAMES))
        if number <= BROADCAST_SETS:
            mine = F.broadcast(mine)
            keys = np.unique(np.array([key for key, in open_keys.select("key").distinct().collect()], np.int64).view(np.uint64))
            rows = postings(sets, keyed, codes, keyed.sparkSession.sparkContext.broadcast(keys))
        rest = _all_earlier(mine, rows).select(F.col("s_id").alias("s"), F.col("id").alias("t")).distinct()
        rest = written(rest.join(tried, ["s", "t"], "left_anti"), "rest")
        settled = settled.unionByName(_verified(rest, sets, keyed))
    kept = sets.join(_few(settled, settled.count()), "id", "left_anti")
    return written(kept.select(*_PLACE), "kept")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with text less its later matches, and n_lines, n_removed (int) beside it.

    Lines are parts between line feeds, tokens their parts between ASCII white space. Two
    lines match if their token sets have Jaccard similarity NUM / DEN or more. A line goes if
    any earlier line of the table matches it, in the order of doc_id (null first), then line
    number; whether that line stays itself doesn't matter. Lines without tokens stay.
    Rows alike in doc_id and text are one document: they lose the same lines. Null texts stay
    null with 0 lines. Columns named n_lines or n_removed are replaced.
    """
    docs, back = set_aside(docs.drop("n_lines", "n_removed"), "d", "row_key", "kept")
    keyed = _keyed(docs)
    kept = kept_lines(_once(keyed.select("d", "row_key", "text")))
    lists = kept.groupBy("d", "row_key").agg(F.collect_list("line_no").alias("kept"))
    joined = keyed.join(_few(lists, kept.count()), ["d", "row_key"], "left").drop("d", "row_key")
    at, last = joined.columns.index("text"), len(joined.columns) - 1
    schema = with_fields(joined.drop("kept"), ("n_lines", T.IntegerType()), ("n_removed", T.IntegerType()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(low, SLICE) for b in batches for low in range(0, b.num_rows, SLICE)):
            texts, totals, removed = [], [], []
            for text, kept in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist()):
                lines = [] if text is None else text.split("\n")
                stay = set(kept or ())
                left = [line for k, line in enumerate(lines) if k in stay or not line.encode().split()]
                texts.append(None if text is None else "\n".join(left))
                totals.append(len(lines))
                removed.append(len(lines) - len(left))
            columns = [*batch.columns[:last], pa.array(totals, pa.int32()), pa.array(removed, pa.int32())]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:last], "n_lines", "n_removed"])

    return joined.mapInArrow(rows, schema).withColumnsRenamed(back)


def without_copied_lines(docs: DataFrame) -> DataFrame:
    """The rows and columns of docs with text deduplicated, less those that lost every line
    with words to earlier ones."""
    docs, back = set_aside(docs, "n_lines", "n_removed")
    found = dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    return found.where(~emptied).select(docs.columns).withColumnsRenamed(back)
