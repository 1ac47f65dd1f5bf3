"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldeval.llm.common import components, records, sorted_runs, utf8, written

SEED = 42
#: Bits masked in turn. Two fingerprints that differ in 3 bits differ in at most 2 outside
#: the block of one of them; those two bits meet in the middle, one flip from each side.
BLOCKS = ((0, 21), (21, 42), (42, 64))
#: Buckets above this size are keyed once more, so that no bucket's pairs are enumerated
#: beyond it; nothing is dropped.
PAIRWISE = 64
#: Ids of rows that stay are broadcast up to so many, beyond it joined by shuffle.
BROADCAST_IDS = 2_000_000
_HASH_BYTES = 4 << 20


def simhash(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    hashes = np.fromiter(map(digest, grams), np.uint64)
    ones = np.zeros(64, np.int64)
    step = _HASH_BYTES // 64
    for at in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[at : at + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    set_bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view(np.uint64)[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [_signed(simhash(text)) for text in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(prints, pa.int64())], ["doc_id", "text_key", "fp"])


def _signed_mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def _varied(keep: Column, tag: Column) -> Callable[[Column], Column]:
    return lambda flip: F.col("fp").bitwiseXOR(flip).bitwiseAND(keep).bitwiseOR(tag)


def _variants(fps: DataFrame) -> DataFrame:
    """(block, key, fp): the fingerprint outside each block, as it is and with each bit flipped."""
    parts = []
    for block, (low, high) in enumerate(BLOCKS):
        outside = [b for b in range(64) if not low <= b < high]
        keep = F.lit(_signed_mask(outside))
        flips = F.array(*[F.lit(_signed_mask(x)) for x in [[], *([b] for b in outside)]])
        # The block's own bits hold its number: one long names block and variant.
        tag = F.lit(_signed(block << low))
        parts.append(F.transform(flips, _varied(keep, tag)))
    return fps.select(
        "fp", F.posexplode(F.array(*parts)).alias("block", "keys")
    ).select(F.col("block").cast("byte").alias("block"), F.explode("keys").alias("key"), "fp")


def _outside() -> np.ndarray:
    return ~np.array([sum(1 << b for b in range(low, high)) for low, high in BLOCKS], np.uint64)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


_LINKS = "kind byte, u long, v long, block byte"


def _link_rows(kind: int, u: np.ndarray, v: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
    arrays = [np.full(len(u), kind, np.int8), u.view(np.int64), v.view(np.int64), block.astype(np.int8)]
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["kind", "u", "v", "block"])


def _verified(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links (kind 0) inside small buckets; rows of large ones (kind 1: key, fp) are passed on."""
    outside = _outside()
    for table, large in sorted_runs(batches, 2, most):
        block = table.column(0).to_numpy()
        key = table.column(1).to_numpy().view(np.uint64)
        fp = table.column(2).to_numpy().view(np.uint64)
        if large:
            yield _link_rows(1, key, fp, block)
            continue
        bucket = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (block[1:] != block[:-1]))])
        shared = np.bincount(bucket)[bucket] > 1
        bucket, key, fp, block = bucket[shared], key[shared], fp[shared], block[shared]
        centre = ((fp ^ key) & outside[block]) == 0
        for gap in range(1, min(most, len(fp))):
            same = bucket[gap:] == bucket[:-gap]
            if not same.any():
                break
            at = np.flatnonzero(same)
            a, b, k = fp[at], fp[at + gap], block[at]
            near = _popcount(a ^ b) <= 3
            # Equal outside the block: every flip meets, so only the unflipped variant counts.
            near &= (((a ^ b) & outside[k]) != 0) | (centre[at] & centre[at + gap])
            if near.any():
                yield _link_rows(0, a[near], b[near], k[near])


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Second keys for rows of large buckets. All rows under one of them link with each other:
    outside the block they differ by two flips at most, inside only in the wild bit; rows at
    the bucket's centre, equal outside, also get every flip inside beside the wild bit.
    """
    outside = _outside()
    for batch in batches:
        for key, fp, block in records(iter([batch])):
            low, high = BLOCKS[block]
            width = high - low
            inner = (fp >> low) & ((1 << width) - 1)
            centre = ((fp ^ key) & int(outside[block])) & ((1 << 64) - 1) == 0
            forms = chain([inner], (inner ^ (1 << i) for i in range(width)) if centre else [])
            out = [(key, block, j, form & ~(1 << j)) for form in forms for j in range(width)]
            out = list(dict.fromkeys(out))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.int64()),
                    pa.array(columns[1], pa.int8()),
                    pa.array(columns[2], pa.int8()),
                    pa.array(columns[3], pa.int32()),
                    pa.array([fp] * len(out), pa.int64()),
                ],
                ["key", "block", "wild", "form", "fp"],
            )


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row under one key linked with the first row under it."""
    # No key has more than flips outside times two rows, so none is hot.
    for table, _ in sorted_runs(batches, 4, 1 << 20):
        columns = [table.column(k).to_numpy() for k in range(4)]
        fp = table.column(4).to_numpy()
        new = np.ones(len(fp), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        starts = np.flatnonzero(new)
        first = np.repeat(fp[starts], np.diff(np.append(starts, len(fp))))
        at = np.flatnonzero(fp != first)
        yield pa.RecordBatch.from_arrays([pa.array(first[at]), pa.array(fp[at])], ["u", "v"])


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) that join all pairs within 3 bits.

    Every fingerprint emits its variants within half the radius: for each block of bits,
    which is masked, itself and each single flip outside, 131 in all. Any two fingerprints
    within 3 bits share a variant. Buckets up to PAIRWISE distinct fingerprints are verified
    pair by pair; larger ones are split by finer keys under which all rows are linked, so
    the first row under a key stands for the pairs.
    """
    spread = _variants(fps).repartition("key").sortWithinPartitions("block", "key", "fp")
    found = written(spread.mapInArrow(partial(_verified, most=PAIRWISE), _LINKS), "buckets")
    large = found.where("kind = 1").select(F.col("u").alias("key"), F.col("v").alias("fp"), "block")
    finer = large.mapInArrow(_finer, "key long, block byte, wild byte, form int, fp long")
    finer = finer.repartition("key", "block", "wild", "form").sortWithinPartitions("key", "block", "wild", "form", "fp")
    return found.where("kind = 0").select("u", "v").unionByName(finer.mapInArrow(_stars, "u long, v long"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp, root) for every row: rows whose fingerprints links join share a root."""
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), utf8("text").alias("text"))
    prints = written(keyed.mapInArrow(_fingerprint_rows, "doc_id long, text_key long, fp long"), "prints")
    roots = written(components(links(prints.select("fp").distinct())), "roots")
    return prints.join(roots, prints.fp == roots.node, "left").select(
        "doc_id", "text_key", "fp", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text).

    Fingerprints link at 3 or fewer differing bits; component_id is the smallest doc_id that
    links reach. Texts without words and null texts have fingerprint zero and link like any
    other. Repeated rows give repeated rows; a component of null doc_ids alone has a null
    component_id. An empty table gives no rows; further columns are ignored.
    """
    found = written(classes(docs), "classes")
    smallest = written(found.groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")
    return found.join(smallest, "root").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of near duplicates, that of the smallest doc_id (null last),
    with the columns of docs. Of rows alike in doc_id and text one stays."""
    found = written(classes(docs), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    best = found.groupBy("root").agg(F.min(order).alias("best"))
    winners = written(best.select(F.col("best.doc_id").alias("id"), F.col("best.text_key").alias("key")), "winners")
    repeated = found.groupBy("doc_id", "text_key").count().where("count > 1")
    repeated = written(repeated.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")), "repeated")

    def of(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
        same = docs["doc_id"].eqNullSafe(rows["id"]) & (F.xxhash64(docs["text"]) == rows["key"])
        return docs.join(rows, same, how)

    kept = of(docs, F.broadcast(winners) if winners.count() <= BROADCAST_IDS else winners, "left_semi")
    if repeated.isEmpty():
        return kept
    once = of(kept, repeated, "left_semi").dropDuplicates(["doc_id", "text"])
    return of(kept, repeated, "left_anti").unionByName(once)
