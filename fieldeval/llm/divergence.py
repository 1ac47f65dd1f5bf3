"""Divergence of sources: how far apart the term frequencies of a language's sources are.

Terms travel as 64-bit digests of language and term. Tasks count the terms of their documents
by group (language, source); what is shuffled is digest, group, and two counts. A second scan
finds for every digest the smallest and the largest language and term: where they differ, terms
collide, and only those are counted anew by their text. Text is joined back to the terms that a
report lists.

Languages and groups are named by digests too; of a few seeds one is taken under which no two
of them share a digest.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldeval.llm.common import records, utf8, written

LEAST_DOCS = 3
MOST_RANKS = 200
#: Probabilities are integers of this scale.
SCALE = 1_000_000_000
#: Distinct terms of groups counted in a task before they are passed on (about 150 bytes each).
HELD_TERMS = 1_000_000
#: Bytes of a text split into words at a time, and rows of a batch that is passed on.
PIECE_BYTES = 1 << 20
ROWS = 1 << 16
#: Sources whose sums against all others one task holds.
SOURCE_BLOCK = 256
#: Kept terms of a language in one bucket of pair sums, about, and the most buckets.
BUCKET_TERMS = 10_000
MOST_BUCKETS = 4096
#: Probabilities (term, source) held at a time.
CELLS = 1 << 18
DIGEST_BITS = 64

_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_REST = regex.compile(rb"[A-Za-z\x80-\xff]*")


def _term_lists(text: bytes, piece: int) -> Iterator[list[bytes]]:
    """Terms of a text, in lists of bounded pieces that end between terms."""
    at = 0
    while at < len(text):
        end = min(at + piece, len(text))
        end = _REST.match(text, end).end()
        yield text[at:end].translate(_FOLD).split()
        at = end


def _digests(lang: int, terms: list[bytes], bits: int) -> np.ndarray:
    """Digests of terms, seeded by their language's id."""
    found = np.fromiter(map(xxhash.xxh64_intdigest, terms, repeat(lang & (2**64 - 1))), np.uint64, len(terms))
    return (found & np.uint64(2**bits - 1)).view(np.int64)


def _batches(names: list[str], columns: list[pa.Array | np.ndarray]) -> Iterator[pa.RecordBatch]:
    table = pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names)
    for low in range(0, table.num_rows, ROWS):
        yield table.slice(low, ROWS)


def _counted(named: DataFrame, bits: int, only: set[int] | None = None) -> DataFrame:
    """(lang_id, group_id, digest, n, d): a task's terms with their words and documents.

    A term comes once for each group and each time that the task passes its counts on. With
    `only` the rows are those of these digests, and have the term as well.
    """
    asked = named.sparkSession.sparkContext.broadcast(only) if only is not None else None
    names = ["lang_id", "group_id", "digest", "n", "d"] + ["term"] * (only is not None)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], Counter[bytes]] = {}
        docs: dict[tuple[int, int], Counter[bytes]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, group), found in counts.items():
                terms = list(found)
                columns = [
                    np.full(len(terms), lang),
                    np.full(len(terms), group),
                    _digests(lang, terms, bits),
                    np.fromiter(found.values(), np.int64, len(terms)),
                    np.fromiter(map(docs[lang, group].__getitem__, terms), np.int64, len(terms)),
                ]
                if asked is not None:
                    at = [k for k, digest in enumerate(columns[2].tolist()) if digest in asked.value]
                    columns = [c[at] for c in columns] + [pa.array([terms[k] for k in at], pa.binary())]
                yield from _batches(names, columns)

        for lang, group, text in records(batches):
            found = counts.setdefault((lang, group), Counter())
            before = len(found)
            own: set[bytes] = set()
            for terms in _term_lists(text, PIECE_BYTES):
                found.update(terms)
                own.update(terms)
            docs.setdefault((lang, group), Counter()).update(own)
            held += len(found) - before
            if held > HELD_TERMS:
                yield from flush()
                counts, docs, held = {}, {}, 0
        yield from flush()

    kinds = "lang_id long, group_id long, digest long, n long, d long" + ", term binary" * (only is not None)
    return named.mapInArrow(rows, kinds)


def _dictionary(named: DataFrame, bits: int) -> DataFrame:
    """(digest, term, collides): the smallest term of every digest, and whether it is the only one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, set[bytes]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, found in seen.items():
                terms = list(found)
                columns = [np.full(len(terms), lang), _digests(lang, terms, bits), pa.array(terms, pa.binary())]
                yield from _batches(["lang_id", "digest", "term"], columns)

        for lang, text in records(batches):
            found = seen.setdefault(lang, set())
            before = len(found)
            for terms in _term_lists(text, PIECE_BYTES):
                found.update(terms)
            held += len(found) - before
            if held > HELD_TERMS:
                yield from flush()
                seen, held = {}, 0
        yield from flush()

    terms = named.select("lang_id", "text").mapInArrow(rows, "lang_id long, digest long, term binary")
    # Tasks send a term once already, so it is dealt before it is aggregated.
    found = terms.repartition("digest").groupBy("digest").agg(
        F.min("term").alias("lo"), F.max("term").alias("hi"), F.min("lang_id").alias("la"), F.max("lang_id").alias("lb")
    )
    return found.select("digest", F.col("lo").cast("string").alias("term"), F.expr("lo <> hi OR la <> lb").alias("collides"))


def _group_ids(seed: int) -> dict[str, Column]:
    return {"lang_id": F.xxhash64(F.lit(seed), "lang"), "group_id": F.xxhash64(F.lit(seed), "lang", "source")}


def _groups(named: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """(lang, source, lang_id, group_id) of every occurring group, and how ids are made."""
    groups = written(named.select("lang", "source").distinct(), "groups")
    for seed in range(64):
        ids = _group_ids(seed)
        held = groups.withColumns(ids)
        of_groups = F.count_distinct("group_id") == F.count("*")
        of_langs = F.count_distinct("lang_id") == F.count_distinct("lang")
        if held.agg(of_groups & of_langs).first()[0]:
            return held, ids
    raise ValueError("more groups than 64-bit digests tell apart")


def _kept_rows(least_docs: int):
    """Terms in enough documents as one row each, from rows sorted by (digest, group)."""

    def reduced(columns: list[np.ndarray], new: np.ndarray) -> list[np.ndarray]:
        at = np.flatnonzero(new)
        return [columns[0][at], columns[1][at], *(np.add.reduceat(c, at) for c in columns[2:])]

    def emitted(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        digest, group, n, d = columns
        if not len(digest):
            return
        starts = np.flatnonzero(np.append(True, digest[1:] != digest[:-1]))
        sizes = np.diff(np.append(starts, len(digest)))
        keep = np.add.reduceat(d, starts) >= least_docs
        rows = np.repeat(keep, sizes)
        offsets = np.append(0, np.cumsum(sizes[keep])).astype(np.int32)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(c[rows])) for c in (group, n)]
        yield from _batches(["digest", "groups", "counts"], [digest[starts][keep], *lists])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 4  # the last digest's groups: it may go on
        for batch in batches:
            columns = [np.append(h, c.to_numpy()) for h, c in zip(held, batch.columns)]
            if not len(columns[0]):
                continue
            digest, group = columns[:2]
            new = np.append(True, (digest[1:] != digest[:-1]) | (group[1:] != group[:-1]))
            columns = reduced(columns, new)
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            yield from emitted([c[:cut] for c in columns])
            held = [c[cut:] for c in columns]
        yield from emitted(held)

    return rows


def _kept_terms(named: DataFrame, dictionary: DataFrame, least_docs: int, bits: int) -> DataFrame:
    """(digest, split, groups, counts) of terms in enough documents of their language.

    `split` is the text where terms collide, else null. A term's row has an entry for every
    source of its language that has it.
    """
    counts = _counted(named, bits).select("digest", "group_id", "n", "d")
    sorted_ = counts.repartition("digest").sortWithinPartitions("digest", "group_id")
    kept = sorted_.mapInArrow(_kept_rows(least_docs), "digest long, groups array<long>, counts array<long>")
    kept = kept.withColumn("split", F.lit(None).cast("string"))
    # Few by the birthday bound: n terms give n^2 / 2^65 such pairs.
    collided = {r["digest"] for r in dictionary.where("collides").select("digest").collect()}
    if not collided:
        return kept
    rest = kept.join(dictionary.where("collides").select("digest"), "digest", "left_anti")
    again = _counted(named, bits, collided).withColumn("split", F.col("term").cast("string"))
    groups = again.groupBy("lang_id", "digest", "split", "group_id").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    split = groups.groupBy("lang_id", "digest", "split").agg(
        F.sum("d").alias("d"), F.array_sort(F.collect_list(F.struct("group_id", "n"))).alias("g")
    )
    split = split.where(F.col("d") >= least_docs).select("digest", "g.group_id", "g.n", "split")
    return rest.unionByName(split.toDF("digest", "groups", "counts", "split"))


def _stats(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups with the number of terms (v) and words (lang_total) of their language, their own
    words (total) and the number of the language's sources."""
    own = kept.select(F.explode(F.arrays_zip("groups", "counts")).alias("g")).select("g.*")
    own = own.groupBy(F.col("groups").alias("group_id")).agg(F.sum("counts").alias("total"))
    langs = kept.groupBy(F.col("groups")[0].alias("group_id")).agg(
        F.count("*").alias("v"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("words")
    )
    langs = langs.join(groups.select("group_id", "lang_id"), "group_id").groupBy("lang_id")
    langs = langs.agg(F.sum("v").alias("v"), F.sum("words").alias("lang_total"))
    sources = groups.groupBy("lang_id").agg(F.count("*").alias("n_sources"))
    both = groups.join(own, "group_id", "left").join(sources, "lang_id").join(langs, "lang_id", "left")
    return both.na.fill(0, ["total", "v", "lang_total"])


def _p(counts: np.ndarray, totals: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), with Python integers where 64 bits could overflow."""
    if counts.max(initial=0) < 2**62 // SCALE:
        return 1 + SCALE * (counts + 1) // totals
    return (1 + SCALE * (counts.astype(object) + 1) // totals).astype(np.int64)


class _Bucket:
    """Sums of one bucket of a language's terms, for one block of its sources.

    f of two probabilities is floor((p - q)^2 / q). No sum overflows: a group's probabilities
    add up to little more than SCALE, so the squares add up to less than 3 * SCALE^2.
    """

    def __init__(self, block: int, heads: list[tuple[int, int, int, int]], most: int, sources: int, cells: int) -> None:
        self.block, self.most, self.cells = block, most, cells
        heads = sorted(heads)
        self.groups = np.array([h[0] for h in heads], np.int64)
        self.size = np.array([h[1] + h[2] for h in heads], np.int64)
        self.lang_size = heads[0][3] + heads[0][2]
        self.absent = _p(np.zeros(len(heads), np.int64), np.maximum(1, self.size))
        self.low = block * sources
        self.sums = np.zeros((min(sources, len(heads) - self.low), len(heads)), np.int64)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.splits: dict[int, str] = {}
        self.n = 0

    def add(self, digests: np.ndarray, splits: list[str | None], sizes: np.ndarray, groups: np.ndarray, counts: np.ndarray) -> None:
        step = max(1, self.cells // len(self.groups))
        ends = np.cumsum(sizes)
        for at in range(0, len(sizes), step):
            here = slice(at, at + step)
            rows = slice(int(ends[at] - sizes[at]), int(ends[here][-1]))
            self._add(digests[here], splits[here], sizes[here], groups[rows], counts[rows])

    def _add(self, digests: np.ndarray, splits: list[str | None], sizes: np.ndarray, groups: np.ndarray, counts: np.ndarray) -> None:
        term = np.repeat(np.arange(len(sizes)), sizes)
        source = np.searchsorted(self.groups, groups)
        p = _p(counts, self.size[source])
        cells = np.repeat(self.absent[None, :], len(sizes), 0)
        cells[term, source] = p
        for s in range(len(self.sums)):
            apart = cells[:, self.low + s, None] - cells
            self.sums[s] += (apart * apart // cells).sum(0)
        if self.block == 0:
            q = _p(np.add.reduceat(counts, np.cumsum(sizes) - sizes), self.lang_size)[term]
            above = np.flatnonzero(p > q)
            value = (p[above] - q[above]) ** 2 // q[above]
            self.found.append((source[above], term[above] + self.n, value))
            self.splits |= {self.n + k: text for k, text in enumerate(splits) if text is not None}
            self.digests = np.append(self.digests, digests) if self.n else digests
            self.n += len(sizes)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(part, group_id, other, value, split): sums against each other source, and the terms
        of each source with one of the largest values of the bucket, all of equal value alike."""
        names = ["part", "group_id", "other", "value", "split"]

        def batch(part: str, group: np.ndarray, other: np.ndarray, value: np.ndarray, split: list[str | None]):
            kind = pa.array([part] * len(group), pa.string())
            return _batches(names, [kind, group, other, value, pa.array(split, pa.string())])

        for s, sums in enumerate(self.sums, self.low):
            others = np.flatnonzero(np.arange(len(self.groups)) != s)
            none = [None] * len(others)
            yield from batch("pair", np.full(len(others), self.groups[s]), self.groups[others], sums[others], none)
        if not self.found:
            return
        source, term, value = (np.concatenate(c) for c in zip(*self.found))
        for s in np.unique(source).tolist():
            at = np.flatnonzero(source == s)
            if len(at) > self.most:
                least = np.partition(value[at], len(at) - self.most)[len(at) - self.most]
                at = at[value[at] >= least]
            group = np.full(len(at), self.groups[s])
            texts = [self.splits.get(k) for k in term[at].tolist()]
            yield from batch("term", group, self.digests[term[at]], value[at], texts)


def _bucket_sums(most: int):
    """Rows of `_Bucket` from rows sorted by (lang_id, block, bucket), sources before terms."""
    sources, cells = SOURCE_BLOCK, CELLS

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple[int, int, int] | None = None
        heads: list[tuple[int, int, int, int]] = []
        bucket: _Bucket | None = None
        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in range(3)]
            new = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))
            cuts = np.append(np.flatnonzero(new), batch.num_rows)
            for a, b in zip(cuts, cuts[1:]):
                now = tuple(int(k[a]) for k in keys)
                if now != key:
                    if key is not None:
                        yield from (bucket or _Bucket(key[1], heads, most, sources, cells)).rows()
                    key, heads, bucket = now, [], None
                part = batch.slice(a, b - a)
                n_heads = int(part.column("head").to_numpy(zero_copy_only=False).sum())
                if n_heads:
                    ids = part.column("groups").slice(0, n_heads).flatten().to_pylist()
                    sizes = part.column("counts").slice(0, n_heads).to_pylist()
                    heads += [(group, *size) for group, size in zip(ids, sizes)]
                part = part.slice(n_heads)
                if part.num_rows:
                    bucket = bucket or _Bucket(key[1], heads, most, sources, cells)
                    groups = part.column("groups")
                    bucket.add(
                        part.column("digest").to_numpy(),
                        part.column("split").to_pylist(),
                        groups.value_lengths().to_numpy().astype(np.int64),
                        groups.flatten().to_numpy(),
                        part.column("counts").flatten().to_numpy(),
                    )
        if key is not None:
            yield from (bucket or _Bucket(key[1], heads, most, sources, cells)).rows()

    return rows


def _values(kept: DataFrame, stats: DataFrame, most: int) -> DataFrame:
    """Rows of `_Bucket` over all kept terms.

    A language's terms are dealt to buckets and its sources to blocks; a task adds up all terms
    of a bucket before it sends one sum for each pair. Every pair gets a sum, those of
    languages without kept terms as well.
    """
    buckets = F.expr(f"greatest(1, least(v div {BUCKET_TERMS}, {MOST_BUCKETS}))")
    blocks = F.expr(f"sequence(0L, (n_sources - 1) div {SOURCE_BLOCK})")
    names = ["lang_id", "block", "bucket", "head", "digest", "split", "groups", "counts"]
    heads = stats.select("*", F.explode(blocks).alias("block")).select(
        "lang_id",
        "block",
        F.explode(F.sequence(F.lit(0).cast("long"), buckets.cast("long") - 1)).alias("bucket"),
        F.lit(True).alias("head"),
        F.lit(0).cast("long").alias("digest"),
        F.lit(None).cast("string").alias("split"),
        F.array("group_id").alias("groups"),
        F.array("total", "v", "lang_total").alias("counts"),
    )
    of_lang = stats.select("lang_id", "group_id", "v", "n_sources")
    terms = kept.withColumn("group_id", F.col("groups")[0]).join(of_lang, "group_id")
    terms = terms.select("*", F.explode(blocks).alias("block")).withColumns(
        {"bucket": F.pmod(F.xxhash64("digest"), buckets.cast("long")), "head": F.lit(False)}
    )
    rows = heads.select(*names).unionByName(terms.select(*names)).repartition("lang_id", "block", "bucket")
    rows = rows.sortWithinPartitions("lang_id", "block", "bucket", F.desc("head"))
    return rows.mapInArrow(_bucket_sums(most), "part string, group_id long, other long, value long, split string")


def _pair_part(values: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, item, value) of every other source of a group's language."""
    sums = values.where("part = 'pair'").groupBy("group_id", "other").agg(F.sum("value").alias("value"))
    named = groups.select(F.col("group_id").alias("other"), F.col("source").alias("item"))
    return sums.join(named, "other").select("group_id", "item", "value")


def _term_part(values: DataFrame, dictionary: DataFrame, most: int) -> DataFrame:
    """(group_id, item, value) of terms more frequent in a group than in its language that may
    be among the `most` first.

    A group's smallest value that can rank is found from how often each value occurs; text is
    joined only to the terms that reach it.
    """
    terms = values.where("part = 'term'")
    down = Window.partitionBy("group_id").orderBy(F.desc("value"))
    counts = terms.groupBy("group_id", "value").agg(F.count("*").alias("c"))
    top = counts.withColumn("place", F.row_number().over(down)).where(F.col("place") <= most)
    before = F.sum("c").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c")
    least = top.withColumn("before", before).where(F.col("before") < most)
    least = least.groupBy("group_id").agg(F.min("value").alias("least"))
    may_rank = terms.join(least, "group_id").where("value >= least").withColumnRenamed("other", "digest")
    named = may_rank.join(dictionary.select("digest", "term"), "digest")
    return named.select("group_id", F.coalesce("split", "term").alias("item"), "value")


def audit(
    docs: DataFrame, least_docs: int = LEAST_DOCS, most_ranks: int = MOST_RANKS, digest_bits: int = DIGEST_BITS
) -> DataFrame:
    """(lang, source, part, item, value, rank) of every occurring group (lang, source).

    Part `pair` lists every other source of the language by the divergence summed over the
    language's kept terms, part `term` the terms more frequent in the group than in its
    language. Null text, lang and source count as empty strings; groups without terms take
    part; a language with one source has no pairs; repeated rows are documents of their own;
    equal values rank by item; an empty table gives no rows; further columns are ignored.
    """
    named = docs.select(
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), utf8("text").alias("text")
    )
    groups, ids = _groups(named)
    keyed = named.select(*(c.alias(n) for n, c in ids.items()), "text")
    dictionary = written(_dictionary(keyed, digest_bits), "dictionary")
    kept = written(_kept_terms(keyed, dictionary, least_docs, digest_bits), "kept_terms")
    stats = written(_stats(kept, groups), "group_stats")
    values = written(_values(kept, stats, most_ranks), "divergences")
    pairs = _pair_part(values, groups).withColumn("part", F.lit("pair"))
    terms = _term_part(values, dictionary, most_ranks).withColumn("part", F.lit("term"))
    rank = F.row_number().over(Window.partitionBy("group_id", "part").orderBy(F.desc("value"), "item"))
    tops = terms.withColumn("rank", rank).where(F.col("rank") <= most_ranks)
    found = pairs.withColumn("rank", rank).unionByName(tops).join(groups.select("group_id", "lang", "source"), "group_id")
    return found.select("lang", "source", "part", "item", "value", "rank")


AUDIT_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
), t AS (SELECT lang, source, k, unnest(words) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
v AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
dense AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, kept.n AS ln
  FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), gn AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS n FROM dense GROUP BY ALL),
p AS (
  SELECT dense.lang, dense.source, term, dense.n, 1 + 1000000000 * (dense.n + 1) // (gn.n + v.v) AS p,
         1 + 1000000000 * (ln + 1) // (v.n + v.v) AS q
  FROM dense JOIN gn USING (lang, source) JOIN v USING (lang)
), apart AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(apart.value, 0) AS BIGINT) AS value
  FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN apart ON apart.lang = g.lang AND apart.source = g.source AND apart.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
)
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found
) WHERE part = 'pair' OR rank <= 200
"""
