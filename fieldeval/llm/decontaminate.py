"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased.
The items' words form one automaton per block of at most `BLOCK_WORDS`; documents stream
through it and the length of the longest match that ends at each word is tracked. Where it
reaches the window's length, those words are hit.

Bounds: a block's automaton takes two states a word, 20 bytes each, so a broadcast stays under
64 MB for any benchmark; a larger benchmark has more blocks, and documents are scanned once for
each. Texts are scanned in pieces that overlap by a window less a word.
"""

from __future__ import annotations

import pickle
from array import array
from collections.abc import Iterator
from itertools import repeat
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldeval.llm.common import records, set_aside, utf8, written

WINDOW = 10
#: Words of items in one automaton, and of one item in a piece of its own.
BLOCK_WORDS = 500_000
PIECE_WORDS = 20_000
#: Bytes of a text scanned at a time.
PIECE_BYTES = 1 << 20

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_FOLD = bytes(b if b in _KEPT else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_WORD = regex.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    """Words of UTF-8 text; A-Z lower-cased."""
    return text.translate(_FOLD).split()


class Automaton:
    """Suffix automaton of several sequences of small ints, held in flat arrays.

    A state keeps its first transition in two arrays; only states that branch have more, in
    one dict by (state, word). The root's transitions are an array by word.
    """

    def __init__(self, n_words: int) -> None:
        self.root = array("i", repeat(-1, n_words))
        self.word, self.to = array("i", [-1]), array("i", [-1])
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.more: dict[int, int] = {}
        self.branches: dict[int, list[int]] = {}  # words of a state's further transitions

    def next(self, state: int, word: int) -> int:
        """The state after a word, -1 if there is none."""
        if not state:
            return self.root[word]
        if self.word[state] == word:
            return self.to[state]
        return self.more.get(state << 32 | word, -1)

    def _put(self, state: int, word: int, to: int) -> None:
        if not state:
            self.root[word] = to
        elif self.word[state] in (-1, word):
            self.word[state], self.to[state] = word, to
        else:
            key = state << 32 | word
            if key not in self.more:
                self.branches.setdefault(state, []).append(word)
            self.more[key] = to

    def _new(self, length: int) -> int:
        self.word.append(-1)
        self.to.append(-1)
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _copy_of(self, state: int, length: int) -> int:
        made = self._new(length)
        self.word[made], self.to[made], self.link[made] = self.word[state], self.to[state], self.link[state]
        for word in self.branches.get(state, ()):
            self._put(made, word, self.more[state << 32 | word])
        return made

    def _split(self, before: int, word: int) -> int:
        """The state that holds exactly the strings of `before` followed by the word."""
        found = self.next(before, word)
        if self.length[found] == self.length[before] + 1:
            return found
        made = self._copy_of(found, self.length[before] + 1)
        self.link[found] = made
        while before != -1 and self.next(before, word) == found:
            self._put(before, word, made)
            before = self.link[before]
        return made

    def add(self, words: list[int]) -> None:
        """Take in a further sequence."""
        last = 0
        for word in words:
            if self.next(last, word) != -1:
                last = self._split(last, word)
                continue
            made = self._new(self.length[last] + 1)
            at = last
            while at != -1 and self.next(at, word) == -1:
                self._put(at, word, made)
                at = self.link[at]
            self.link[made] = 0 if at == -1 else self._split(at, word)
            last = made

    def follow(self, state: int, n: int, word: int) -> tuple[int, int]:
        """(state, length) of the longest match that ends with the word."""
        while True:
            to = self.next(state, word)
            if to != -1:
                return to, n + 1
            if not state:
                return 0, 0
            state = self.link[state]
            n = self.length[state]


class Index:
    """What documents are held against: automaton, words, and the classes of windows.

    A window is `window` consecutive words of an item, or a shorter item whole. Windows that
    the same items hold are one class. `long_class` has, for a state, the class of the window
    that ends its strings; `short` the shorter items that do, with their lengths.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.ids: dict[bytes, int] = {}
        coded = [(key, [self.ids.setdefault(w, len(self.ids)) for w in words]) for key, words in items]
        auto = self.auto = Automaton(len(self.ids))
        for _, words in coded:
            auto.add(words)
        holders: dict[tuple[int, int], set[str]] = {}  # (state, length of window) -> items
        for key, words in coded:
            size = min(window, len(words))
            state = n = 0
            for at, word in enumerate(words):
                state, n = auto.follow(state, n, word)
                while auto.length[auto.link[state]] >= size:
                    state = auto.link[state]
                n = min(n, auto.length[state])
                if at >= size - 1:
                    holders.setdefault((state, size), set()).add(key)
        numbers: dict[tuple[str, ...], int] = {}
        classes = {at: numbers.setdefault(tuple(sorted(held)), len(numbers)) for at, held in holders.items()}
        self.classes = list(numbers)
        self.long_class = array("i", repeat(-1, len(auto.length)))
        self.short: dict[int, list[tuple[int, int]]] = {}
        own: dict[int, list[tuple[int, int]]] = {}
        for (state, size), number in classes.items():
            if size < window:
                own.setdefault(state, []).append((size, number))
        for state in sorted(range(1, len(auto.length)), key=auto.length.__getitem__):
            up = auto.link[state]
            number = classes.get((state, window), -1)
            self.long_class[state] = number if number >= 0 else self.long_class[up]
            if found := own.get(state, []) + self.short.get(up, []):
                self.short[state] = found
        self.least = min((size for _, size in holders), default=0)
        pairs = {p for _, words in coded for p in zip(words, words[1:])}
        self.pairs = np.zeros(1 << 20, bool)
        if pairs:
            self.pairs[self._slots(*np.array(list(pairs), np.int64).T)] = True

    @staticmethod
    def _slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 0x9E3779B1 + b * 0x85EBCA77) & ((1 << 20) - 1)

    def _runs(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(start, word ids) of stretches that may hold a window: no pair unknown to the items.

        It only leaves out what the automaton could not match, so that most words cost no step.
        """
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        known = ids >= 0
        joined = known[1:] & known[:-1]
        at = np.flatnonzero(joined)
        joined[at] = self.pairs[self._slots(ids[at], ids[at + 1])]
        starts = np.flatnonzero(known & np.append(True, ~joined))
        ends = np.flatnonzero(known & np.append(~joined, True)) + 1
        keep = ends - starts >= self.least
        for start, end in zip(starts[keep].tolist(), ends[keep].tolist()):
            yield start, ids[start:end].tolist()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans [start, end) in word numbers, in order and apart, and classes of windows."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        if not self.least or not words:
            return spans, found
        follow, window = self.auto.follow, self.window
        for start, ids in self._runs(words):
            state = n = 0
            for end, word in enumerate(ids, start + 1):
                state, n = follow(state, n, word)
                hit = 0
                if n >= window:
                    hit = n
                    found.add(self.long_class[state])
                for size, number in self.short.get(state, ()):
                    if size <= n:
                        hit = max(hit, size)
                        found.add(number)
                if hit:
                    low = end - hit
                    while spans and spans[-1][1] >= low:
                        low = min(low, spans.pop()[0])
                    spans.append((low, end))
        return spans, found

    def scan_text(self, text: bytes, most: int = PIECE_BYTES) -> tuple[int, list[tuple[int, int]], set[int]]:
        """(number of words, hit spans, classes) of a text of any length, in overlapping pieces."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        seen, kept = 0, list[bytes]()
        for piece in _pieces(text, most):
            words = kept + words_of(piece)
            more, classes = self.scan(words)
            at = seen - len(kept)
            for low, high in more:
                low, high = low + at, high + at
                if high <= seen:
                    continue  # found in the piece before
                while spans and spans[-1][1] >= low:
                    last = spans.pop()
                    low, high = min(low, last[0]), max(high, last[1])
                spans.append((low, high))
            found |= classes
            seen = at + len(words)
            kept = words[-(self.window - 1) :] if self.window > 1 else []
        return seen, spans, found


def _pieces(text: bytes, most: int) -> Iterator[bytes]:
    """Parts of a text that end between words."""
    at = 0
    while len(text) - at > most:
        end = at + most
        word = _WORD.match(text, end)  # a word that goes on
        end = word.end() if word else end
        yield text[at:end]
        at = end
    yield text[at:]


def _item_pieces(items: DataFrame, window: int) -> DataFrame:
    """(item_id, n, words): items' words, long items in pieces that overlap by a window less one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, text in records(batches):
            words = words_of(text)
            step = max(PIECE_WORDS, 2 * window)
            out = [words[at : at + step + window - 1] for at in range(0, len(words), step)]
            if len(out) > 1 and len(out[-1]) < window:
                out.pop()  # the piece before has these words
            yield pa.RecordBatch.from_pydict(
                {
                    "item_id": pa.array([key] * len(out), pa.string()),
                    "n": pa.array([len(w) for w in out], pa.int64()),
                    "words": pa.array([b" ".join(w) for w in out], pa.binary()),
                }
            )

    texts = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), utf8("text"))
    return texts.mapInArrow(rows, "item_id string, n long, words binary").distinct()


def build(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, int]:
    """(table, blocks): a table of each block's index and of its classes' items.

    Rows (block, class, item_id, index): the index has class null. Items with one id are one
    item with several texts; a null id counts as an item named by the empty string. Items
    without words, null texts among them, have no window.
    """
    cut = written(_item_pieces(items, window), "item_pieces")
    total = cut.agg(F.sum("n")).first()[0] or 0
    # Blocks are half full on average, so that an uneven deal keeps to the bound.
    blocks = max(1, -(-2 * total // BLOCK_WORDS)) if total > BLOCK_WORDS else 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[str, list[bytes]]]] = {}
        for block, key, words in records(batches):
            for done in [b for b in held if b != block]:
                yield from made(done, held.pop(done))
            held.setdefault(block, []).append((key, words.split()))
        for block, texts in held.items():
            yield from made(block, texts)

    def made(block: int, texts: list[tuple[str, list[bytes]]]) -> Iterator[pa.RecordBatch]:
        index = Index(texts, window)
        classes, index.classes = index.classes, []
        out: list[tuple[Any, ...]] = [(block, None, None, pickle.dumps(index))]
        out += [(block, k, key, None) for k, keys in enumerate(classes) for key in keys]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.binary()]
        names = ["block", "class", "item_id", "index"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    dealt = cut.select(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)).cast("int").alias("block"), "item_id", "words")
    sorted_ = dealt.repartition(blocks, "block").sortWithinPartitions("block", "item_id", "words")
    return written(sorted_.mapInArrow(rows, 'block int, class int, item_id string, index binary'), "automata"), blocks


def _scanned(docs: DataFrame, table: DataFrame, block: int, key: Column) -> DataFrame:
    """(doc_id, key, n_words, spans, classes) of every document against one block."""
    row = table.where((F.col("block") == block) & F.col("index").isNotNull()).select("index").first()
    blob = docs.sparkSession.sparkContext.broadcast(row["index"] if row else pickle.dumps(Index([])))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pickle.loads(blob.value)
        for batch in batches:
            counts, spans, classes = [], [], []
            for (text,) in records(iter([batch.select(["text"])])):
                n, at, found = index.scan_text(text, PIECE_BYTES)
                counts.append(n)
                spans.append([x for span in at for x in span])
                classes.append([block << 32 | k for k in sorted(found)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("key"),
                    pa.array(counts, pa.int64()),
                    pa.array(spans, pa.list_(pa.int64())),
                    pa.array(classes, pa.list_(pa.int64())),
                ],
                ["doc_id", "key", "n_words", "spans", "classes"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", key.alias("key"), utf8("text").alias("text"))
    return texts.mapInArrow(rows, f"doc_id {kind}, key binary, n_words long, spans array<long>, classes array<long>")


def _covered() -> Column:
    """Words in the spans [start, end, start, end, ...], which may overlap."""
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)),
        lambda k: F.struct(F.get("spans", k).alias("a"), F.get("spans", k + 1).alias("b")),
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    total = F.aggregate(
        F.array_sort(pairs),
        start,
        lambda acc, p: F.struct(
            (acc["n"] + F.greatest(F.lit(0), p["b"] - F.greatest(acc["to"], p["a"]))).alias("n"),
            F.greatest(acc["to"], p["b"]).alias("to"),
        ),
    )["n"]
    return F.when(F.size("spans") == 0, F.lit(0).cast("long")).otherwise(total)


def leaks(docs: DataFrame, table: DataFrame, blocks: int) -> DataFrame:
    """(doc_id, key, n_words, n_hit, spans, classes) of every document against all blocks.

    With one block this is one scan. With more, the further blocks' hits are kept by a digest
    of the text, once for equal texts, and joined to the first block's rows.
    """
    key = F.lit(None).cast("binary") if blocks == 1 else F.unhex(F.md5(utf8("text")))
    base = _scanned(docs, table, 0, key)
    if blocks > 1:
        hits = None
        for block in range(1, blocks):
            found = _scanned(docs, table, block, key).where(F.size("classes") > 0)
            found = written(found.groupBy("key").agg(F.first("spans").alias("s"), F.first("classes").alias("c")), "hits")
            hits = found if hits is None else hits.unionByName(found)
        merged = hits.groupBy("key").agg(
            F.flatten(F.collect_list("s")).alias("s"), F.flatten(F.collect_list("c")).alias("c")
        )
        none = F.array().cast("array<long>")
        base = written(base, "scanned").join(merged, "key", "left").select(
            "doc_id",
            "key",
            "n_words",
            F.concat("spans", F.coalesce("s", none)).alias("spans"),
            F.array_sort(F.concat("classes", F.coalesce("c", none))).alias("classes"),
        )
    return base.select("doc_id", "key", "n_words", _covered().alias("n_hit"), "spans", "classes")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of docs.

    A word is hit inside any occurrence of a window of an item; an item of fewer words than a
    window is one window. Null and empty texts have no words; repeated rows each get a row;
    items with equal texts are all listed; no items or no documents give rows without hits or
    no rows. Further columns are ignored.
    """
    table, blocks = build(items, window)
    rows = written(leaks(docs.select("doc_id", "text"), table, blocks).drop("key", "spans"), "leaks")
    hit = F.size("classes") > 0
    # Items are listed once for each set of classes: copies and alike documents share it.
    sets = rows.where(hit).select("classes").distinct()
    owners = table.where(F.col("class").isNotNull()).select(
        F.shiftleft(F.col("block").cast("long"), 32).bitwiseOR(F.col("class").cast("long")).alias("class"), "item_id"
    )
    listed = (
        sets.select("classes", F.explode("classes").alias("class"))
        .join(owners, "class")
        .groupBy("classes")
        .agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
        .select("classes", F.size("ids").cast("long").alias("n_items"), _digest(F.array_join("ids", ",")).alias("items_sha256"))
    )
    clean = rows.where(~hit).select("*", F.lit(0).cast("long").alias("n_items"), _digest(F.lit("")).alias("items_sha256"))
    both = rows.where(hit).join(listed, "classes").unionByName(clean)
    return both.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def without_leaks(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, least_words: int = WINDOW, most_share: float = 0.5
) -> DataFrame:
    """Documents with spans of hit words cut out; those with too large a share of them go.

    A span of `least_words` or more goes, from its first word to its last; a document with more
    than `most_share` of its words hit goes as a whole. All columns stay; texts without a cut
    span, null and empty ones among them, are unchanged.
    """
    table, blocks = build(items, window)
    plain, back = set_aside(docs, "key", "spans", "leak_words", "leak_hits")
    keyed = plain.withColumn("key", F.unhex(F.md5(utf8("text"))))
    found = leaks(keyed.select(F.col("key").alias("doc_id"), "text"), table, blocks).where("n_hit > 0")
    spans = written(
        found.groupBy(F.col("doc_id").alias("key")).agg(
            F.first("spans").alias("spans"), F.first("n_words").alias("leak_words"), F.first("n_hit").alias("leak_hits")
        ),
        "leak_spans",
    )

    @F.udf("binary", useArrow=True)
    def cut(text: bytes | None, at: list[int] | None) -> bytes | None:
        return None if text is None or at is None else without_spans(text, at, least_words)

    joined = keyed.join(spans, "key", "left")
    kept = joined.where(F.col("leak_hits").isNull() | (F.col("leak_hits") <= F.lit(most_share) * F.col("leak_words")))
    hit_text = F.when(F.col("spans").isNotNull(), F.col("text").cast("binary"))
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut(hit_text, "spans").cast("string"))
    out = kept.withColumn("text", text).select(*plain.columns)
    return out.withColumnsRenamed(back)


def without_spans(text: bytes, spans: list[int], least_words: int) -> bytes:
    """The text without the spans [start, end, ...] of word numbers that are long enough."""
    merged: list[list[int]] = []
    for low, high in sorted(zip(spans[::2], spans[1::2])):
        if merged and low <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    ends = {low: high for low, high in merged if high - low >= least_words}
    out, kept, until, begun = [], 0, -1, 0
    for k, word in enumerate(_WORD.finditer(text)):
        if k in ends:
            begun, until = word.start(), ends[k]
        if k == until - 1:
            out.append(text[kept:begun])
            kept = word.end()
    return b"".join([*out, text[kept:]])


#: One row a document; windows of documents of every length that the items have are joined.
CONTAMINATION_SQL = """
WITH w AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item, least(10, len(words)) AS size,
         array_to_string(list_slice(words, pos, pos + least(10, len(words)) - 1), ' ') AS gram
  FROM (SELECT item, words, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS pos FROM w WHERE len(words) > 0)
), d AS (
  SELECT row_number() OVER () AS k, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS words
  FROM documents
), grams AS (
  SELECT k, pos, size, array_to_string(list_slice(words, pos, pos + size - 1), ' ') AS gram
  FROM (SELECT k, words, size, unnest(range(1, len(words) - size + 2)) AS pos
        FROM d, (SELECT DISTINCT size FROM windows) WHERE len(words) >= size)
), found AS (
  SELECT g.k, g.pos, g.size, w.item FROM grams g JOIN windows w ON g.size = w.size AND g.gram = w.gram
), hit AS (
  SELECT k, count(DISTINCT p) AS n FROM (SELECT DISTINCT k, unnest(range(pos, pos + size)) AS p
        FROM (SELECT DISTINCT k, pos, size FROM found)) GROUP BY k
), items AS (
  SELECT k, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT k, item FROM found) GROUP BY k
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.k = hit.k LEFT JOIN items ON d.k = items.k
"""
