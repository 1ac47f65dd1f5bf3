"""Records of large CSV and JSON files, read in many tasks.

Spark cuts files at lines, or at any other separator, but a record of these formats may hold
separators inside quotes or brackets. So texts are cut first and understood later: each split
is summed up by what it does to the state at its start (are quotes open, which brackets are),
whatever that state is; a pass over the splits of a file, one small row each, gives the state
at the start of each; with it the records inside a split are cut out where they lie. Only the
ends of a split meet those of its neighbours in a shuffle.

Files are read by Spark's text source alone, so they may be in any store that Spark reads.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SPLIT = ("file", "block")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share, for what a query writes and
    reads again; a local folder only where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _segments(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, block, id, value): a file's text between separators, by the split it starts in."""
    texts = spark.read.option("lineSep", separator).text(path)
    return texts.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        F.col("_metadata.file_size").alias("size"),
        "value",
    )


def _in_order(segments: DataFrame, states: DataFrame) -> DataFrame:
    """Segments with the state at the start of their split, a split's segments together and in
    order however Spark joins them."""
    return segments.join(states, list(_SPLIT)).sortWithinPartitions(*_SPLIT, "id")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """((file, block), rows) of each stretch of a batch that lies in one split."""
    block = batch.column("block").to_numpy()
    file = batch.column("file").dictionary_encode().indices.to_numpy()
    new = np.append(True, (block[1:] != block[:-1]) | (file[1:] != file[:-1]))
    cuts = np.append(np.flatnonzero(new), batch.num_rows)
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        yield (batch.column("file")[a].as_py(), int(block[a])), batch.slice(a, b - a)


# ---------------------------------------------------------------------------------- CSV

# A field that ends on its line, and what is left of a quoted one that does not. Quotes count
# only at the start of a field; a doubled quote is one of the text.
_FIELD = r'(?:"(?:[^"]|"")*+"[^,]*+|(?!")[^,]*+)'
_OPEN = r'"(?:[^"]|"")*+\z'
_OPENS = rf"\A(?:{_FIELD},)*+{_OPEN}"
_STAYS = rf'\A(?:(?:[^"]|"")*+\z|(?:[^"]|"")*+"[^,]*+,(?:{_FIELD},)*+{_OPEN})'


def _csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with `opens` and `stays`: whether quotes are open after the line if they were
    closed, or open, before it."""
    lines = _segments(spark, path, "\n").drop("size").withColumn("value", F.regexp_replace("value", r"\r\z", ""))
    quoted = F.contains("value", F.lit('"'))
    return lines.select(
        "*",
        (quoted & F.col("value").rlike(_OPENS)).alias("opens"),
        (~quoted | F.col("value").rlike(_STAYS)).alias("stays"),
    )


def csv_states(lines: DataFrame) -> DataFrame:
    """(file, block, open, origin): whether a split starts inside quotes, and then the split in
    which that record starts.

    A split's lines that change nothing are left out of its sum. Between splits only its effect
    counts: it closes, opens or swaps the quotes, or leaves them.
    """
    changes = F.when(F.col("opens") | ~F.col("stays"), F.struct("id", "opens", "stays"))
    sums = lines.groupBy(*_SPLIT).agg(F.array_sort(F.collect_list(changes)).alias("changes"))
    start = F.struct(F.lit(False).alias("a"), F.lit(True).alias("b"), F.lit(False).alias("closes"))

    def step(acc: Column, line: Column) -> Column:
        def after(state: Column) -> Column:
            return F.when(state, line["stays"]).otherwise(line["opens"])

        b = after(acc["b"])
        return F.struct(after(acc["a"]).alias("a"), b.alias("b"), (acc["closes"] | ~b).alias("closes"))

    effect = sums.select(*_SPLIT, F.aggregate("changes", start, step).alias("e")).select(*_SPLIT, "e.*")
    order = Window.partitionBy("file").orderBy("block")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    swaps = effect.withColumn("swaps", F.count_if(F.col("a") & ~F.col("b")).over(upto))
    fixed = F.when(F.col("a") == F.col("b"), F.struct("a", "swaps"))
    last = swaps.withColumn("fixed", F.last(fixed, ignorenulls=True).over(before))
    since = F.coalesce(F.lag("swaps").over(order), F.lit(0)) - F.coalesce("fixed.swaps", F.lit(0))
    entered = last.withColumn("open", F.coalesce("fixed.a", F.lit(False)) != (since % 2 == 1))
    own = F.when(~F.col("open") | F.col("closes"), F.col("block"))
    return entered.select(*_SPLIT, "open", F.last(own, ignorenulls=True).over(before).alias("origin"))


def _csv_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each split, and the parts of those that begin or end in another one."""
    key: tuple[str, int] | None = None
    lines: list[str] = []  # of the record that goes on
    at = origin = row = 0
    head = headed = False

    def piece(whole: bool) -> tuple[Any, ...]:
        nonlocal row, headed, lines, head
        text = "\n".join(lines)
        blank = not text.strip("\n")
        named = key[1] == 0 and not head and not headed and not blank
        headed = headed or named
        out = (key[0], origin if head else key[1], -1 if head else row, key[1], text, named, whole and not head)
        row += not head
        lines, head = [], False
        return out

    def batch(out: list[tuple[Any, ...]]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
        names = ["file", "block", "row", "part", "value", "is_header", "whole"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    for whole in batches:
        out: list[tuple[Any, ...]] = []
        for now, part in _runs(whole):
            if now != key:
                if lines:
                    out.append(piece(False))
                key, row, headed = now, 0, False
                head = state = part.column("open")[0].as_py()
                origin = part.column("origin")[0].as_py()
            for text, opens, stays in zip(*(part.column(c).to_pylist() for c in ("value", "opens", "stays"))):
                lines.append(text)
                state = stays if state else opens
                if not state:
                    out.append(piece(True))
        if out:
            yield batch(out)
    if lines:
        yield batch([piece(False)])


_CSV_PIECE = "file string, block long, row long, part long, value string, is_header boolean, whole boolean"


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, row, value, is_header): every record's text, line breaks in quotes included.

    `block` and `row` give its place in the file. Lines may end in CR LF, also those inside
    quotes, which then break at LF alone as the whole-file reader has them. Blank lines between records are left out; a
    quote that is never closed makes the rest of its file one record.
    """
    lines = _csv_lines(spark, path)
    placed = _in_order(lines, csv_states(lines))
    columns = ["file", "block", "value", "opens", "stays", "open", "origin"]
    pieces = placed.select(*columns).mapInArrow(_csv_pieces, _CSV_PIECE)
    parts = pieces.where(~F.col("whole")).groupBy("file", "block").agg(
        F.max("row").alias("row"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "row", "value"))), lambda p: p["value"]), "\n").alias("value"),
        F.bool_or("is_header").alias("is_header"),
    )
    names = ["file", "block", "row", "value", "is_header"]
    found = pieces.where("whole").select(*names).unionByName(parts.select(*names))
    return found.where(F.col("value") != "")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files with a header each, as texts, with `__order`: file, split, row in it.

    As Spark's own reader with `multiLine`, which reads a file in one task, but in as many
    tasks as the files have splits. Names are those of the first file.
    """
    options = {"header": "true", "escape": '"', "multiLine": "true"}
    names = spark.read.options(**options).csv(path).columns
    quoted = ", ".join(f"`{n.replace('`', '``')}` STRING" for n in names)
    rows = csv_records(spark, path).where(~F.col("is_header"))
    parsed = F.from_csv("value", quoted, {"escape": '"', "multiLine": "true"})
    return rows.select(parsed.alias("r"), F.struct("file", "block", "row").alias("__order")).select("r.*", "__order")


# --------------------------------------------------------------------------------- JSON

_TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*+"|["\[\]{},]', re.S)
_STRING_END = re.compile(rb'(?:[^"\\]|\\.)*+"', re.S)
_AFTER_STRING = re.compile(rb"\s*+(?:[:,\]}]|\Z)")
_EMPTY = re.compile(rb"\[\s*+\]")
_QUOTE, _COMMA, _BRACKETS = ord('"'), ord(","), b"[{"
#: An object or list is known by a letter: O or L; R is the list under the wanted key, E that
#: list without items, P the object under it.
_CLOSES = {"O": "}", "P": "}", "L": "]", "R": "]", "E": "]"}


#: Longer texts outside strings are read token by token.
_SHAPE = 4096
_DIGITS = bytes.maketrans(b"123456789", b"000000000")


@lru_cache(4096)
def _shape(outside: bytes) -> tuple[tuple[int, ...], tuple[tuple[int, int, int], ...], tuple[int, ...]] | None:
    """What a segment opens, from its text outside strings, where a quote stands for each string.

    (commas of the level at its start and of each object it opens; for each object the number of
    strings before it, its place in the text after these, and the string that names it or -1; the
    level of each string that another follows with no token between, else -1). None where the
    segment has lists or is not sound.
    """
    gaps = outside.split(b'"')
    after = [*(gap + b'"' for gap in gaps[1:-1]), *gaps[1:][-1:]]
    if b"[" in outside or b"]" in outside or not all(map(_AFTER_STRING.match, after)):
        return None
    commas, opens, keys = [0], [], []
    for k, gap in enumerate(gaps):
        free = True  # no token in this gap yet
        for at, c in enumerate(gap):
            if c == _COMMA:
                commas[-1] += 1
                free = False
            elif c == _BRACKETS[1]:
                opens.append((k, at, k - 1 if free else -1))
                commas.append(0)
                free = False
        keys.append(len(commas) - 1 if free else -1)
    return tuple(commas), tuple(opens), tuple(keys[1:-1])


class _Tokens:
    """Reads segments of JSON text that were cut at, and have lost, closing braces."""

    def __init__(self, key: str, in_string: bool) -> None:
        self.key = key.encode()
        self.in_string = in_string
        self.sound = True
        self.last: bytes | None = None  # the string before this place, if nothing came between

    def feed(self, text: bytes) -> None:
        at = 0
        if self.in_string:
            end = _STRING_END.match(text)
            if end is None:
                self.goes_on(text + b"}")  # the brace is part of the string
                return
            self.ends(text[: end.end()])
            at, self.in_string, self.last = end.end(), False, b""
            if _AFTER_STRING.match(text, at) is None:
                self.sound = False
                return
        for token in _TOKEN.finditer(text, at):
            start, end = token.span()
            c = text[start]
            if c == _QUOTE:
                if end == start + 1:
                    self.starts(text[start:] + b"}")
                    self.in_string = True
                    return
                if _AFTER_STRING.match(text, end) is None:
                    self.sound = False
                    return
                self.string(text[start:end])
            elif c == _COMMA:
                self.comma()
                self.last = None
            elif c in _BRACKETS:
                self.open(self.label(text, start), start)
                self.last = None
            else:
                self.close(chr(c), text, start)
                self.last = None
            if not self.sound:
                return
        self.close("}", text, len(text))
        self.last = None

    def label(self, text: bytes, at: int) -> str:
        wanted = self.last is not None and self.named(self.key)
        if text[at] == ord("{"):
            return "P" if wanted else "O"
        return ("E" if _EMPTY.match(text, at) else "R") if wanted else "L"

    def named(self, key: bytes) -> bool:
        name = (self.last or b'""')[1:-1]
        return name == key or (b"\\" in name and json.loads(b'"' + name + b'"').encode() == key)

    def string(self, token: bytes) -> None:
        self.last = token

    # Parts of a string that does not end in the segment in which it starts.
    def starts(self, part: bytes) -> None: ...
    def goes_on(self, part: bytes) -> None: ...
    def ends(self, part: bytes) -> None: ...

    def comma(self) -> None: ...
    def open(self, label: str, at: int) -> None: ...
    def close(self, bracket: str, text: bytes, at: int) -> None: ...


class _Level:
    """What is known of one open bracket, or of the text outside all."""

    def __init__(
        self, label: str, commas: int = 0, model: str | None = None, kids: str = "", inner: Any = (None, False), place: Any = None
    ) -> None:
        self.label, self.commas, self.model = label, commas, model
        #: Segment, and byte in it, where the bracket opens; of what a split closes, where it does.
        self.place = place
        #: Letters of the brackets right inside, the first two and each R, and what the last of
        #: them to close knew: its `model`, and whether it had an R.
        self.kids, self.inner = kids, tuple(inner)

    def opens(self, label: str, place: tuple[int, int]) -> _Level:
        if len(self.kids) < 2 or (label == "R" and "R" not in self.kids):
            self.kids += label
        return _Level(label, place=place)

    def closes(self, child: _Level) -> None:
        self.inner = child.model, "R" in child.kids

    def goes_on(self, later: _Level) -> None:
        """Take in what a later split knows of the same bracket."""
        self.commas += later.commas
        self.model = later.model or self.model
        self.kids += later.kids
        if later.kids:
            self.inner = later.inner

    def row(self) -> list[Any]:
        return [self.label, self.commas, self.model, self.kids, self.inner, self.place]


class _Effect(_Tokens):
    """What a split does to the brackets that are open at its start.

    `levels` has an entry for the innermost of these and one more, with the closing bracket as
    its label, for each that the split closes; `open_` are those that it opens and leaves open.
    `head` is the rest of the string that is open at its start, `pending` the begin of a
    `model` at its end.
    """

    def __init__(self, key: str, in_string: bool) -> None:
        super().__init__(key, in_string)
        self.levels = [_Level("")]
        self.open_: list[_Level] = []
        self.at_start, self.head = in_string, b""
        self.pending: bytes | None = None
        self.id = 0  # of the segment that is read

    def _top(self) -> _Level:
        return (self.open_ or self.levels)[-1]

    def segment(self, id_: int, text: bytes, parts: list[bytes] | None) -> None:
        """Read a segment; `parts` are what its quotes part, if it has no escapes."""
        self.id = id_
        if self.in_string or parts is None or not self._step(text, parts):
            self.feed(text)

    def _step(self, text: bytes, parts: list[bytes]) -> bool:
        """As `feed`, without a step for each token, for texts that allow it."""
        outside = b'"'.join(parts[::2])
        shape = _shape(outside.translate(_DIGITS)) if len(outside) <= _SHAPE else None
        if shape is None:
            return False
        commas, opens, keys = shape
        strings = parts[1::2]
        model = -1
        if b'"model"' in text and b"model" in strings:
            model = strings.index(b"model")
            if strings.count(b"model") > 1 or any(name == model + 1 for *_, name in opens):
                return False
        named = keys[model] if 0 <= model < len(keys) else -1
        for level in range(len(commas)):
            if level:
                k, at, name = opens[level - 1]
                at += sum(map(len, parts[: 2 * k])) + 2 * k
                self.open("P" if name >= 0 and strings[name] == self.key else "O", at)
            top = self._top()
            top.commas += commas[level]
            if level == named:
                top.model = (b'"' + strings[model + 1] + b'"').decode("utf-8", "replace")
        self.close("}", text, len(text))
        return True

    def string(self, token: bytes) -> None:
        if self.last is not None and self.named(b"model"):
            self._top().model = token.decode("utf-8", "replace")
            token = b""
        self.last = token

    def starts(self, part: bytes) -> None:
        self.pending = part if self.last is not None and self.named(b"model") else None

    def goes_on(self, part: bytes) -> None:
        if self.at_start:
            self.head += part
        elif self.pending is not None:
            self.pending += part

    def ends(self, part: bytes) -> None:
        self.goes_on(part)
        if self.pending is not None:
            self._top().model, self.pending = self.pending.decode("utf-8", "replace"), None
        self.at_start = False

    def comma(self) -> None:
        self._top().commas += 1

    def open(self, label: str, at: int) -> None:
        self.open_.append(self._top().opens(label, (self.id, at)))

    def close(self, bracket: str, text: bytes, at: int) -> None:
        if not self.open_:
            self.levels.append(_Level(bracket, place=(self.id, at)))
            return
        child = self.open_.pop()
        self._top().closes(child)
        if _CLOSES[child.label] != bracket:
            self.sound = False

    def result(self) -> str | None:
        if not self.sound:
            return None
        rows = {"levels": self.levels, "opens": self.open_}
        head, pending = (x and x.decode("utf-8", "replace") for x in (self.head, self.pending))
        known = {"in": self.in_string, "head": head or "", "ended": not self.at_start, "pending": pending}
        return json.dumps(known | {n: [x.row() for x in held] for n, held in rows.items()})


def _parts(text: bytes) -> list[bytes] | None:
    """Text outside and inside strings by turns, if it has no escapes and ends no string that it
    does not start."""
    if b"\\" in text:
        return None
    parts = text.split(b'"')
    return parts if len(parts) % 2 else None


def _effects(key: str):
    """(file, block, size, length, outside, inside): a split's effect if it starts outside or
    inside a string. Read with the wrong start, text after a quote soon shows it, and that
    reading ends."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[str, int] | None = None
        both: list[_Effect] = []
        size = length = 0

        def done() -> pa.RecordBatch:
            outside, inside = (e.result() for e in both)
            row = {"file": at[0], "block": at[1], "size": size, "length": length, "outside": outside, "inside": inside}
            return pa.RecordBatch.from_pylist([row], schema=_EFFECT)

        for batch in batches:
            for now, part in _runs(batch):
                if now != at:
                    if at is not None:
                        yield done()
                    at, size, length = now, part.column("size")[0].as_py(), 0
                    both = [_Effect(key, False), _Effect(key, True)]
                for id_, text in zip(part.column("id").to_pylist(), part.column("value").to_pylist()):
                    length += len(text) + 1
                    parts = _parts(text)
                    for effect in both:
                        if effect.sound:
                            effect.segment(id_, text, parts)
        if at is not None:
            yield done()

    return rows


_EFFECT = pa.schema(
    [("file", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("length", pa.int64()), ("outside", pa.string()), ("inside", pa.string())]
)
#: head_to and tail_from: the last and first segment of objects that begin or end in another split.
_ENDS = {n: pa.int64() for n in ("head_to", "head_pos", "tail_from", "tail_at", "tail_pos")} | {"head_items": pa.bool_(), "tail_items": pa.bool_()}
_STATE = (
    "file string, block long, in_string boolean, stack string, head_to long, head_pos long, tail_from long, tail_at long, tail_pos long, "
    "head_items boolean, tail_items boolean, model string, is_list boolean, has_items boolean, fault boolean"
)
_ITEMS, _MAP = ("LO", "ORO", "LP", "ORP"), ("OP",)
_NO_END = (1 << 63) - 1


class _File:
    """State between the splits of a file."""

    def __init__(self) -> None:
        self.in_string = self.fault = False
        self.root = _Level("")
        self.stack: list[_Level] = []
        self.pending: str | None = None
        self.excess = self.length = self.size = 0

    def _target(self) -> tuple[int, int, bool] | None:
        """Of the object to be cut out that is open: its depth, its place among the items, and
        whether it is one of them."""
        opened = "".join(x.label for x in self.stack[:3])
        found = next((t for t in _ITEMS + _MAP if opened.startswith(t)), None)
        return found and (len(found), self.stack[len(found) - 2].commas, found in _ITEMS)

    def take(self, size: int, length: int, outside: str | None, inside: str | None) -> tuple[Any, ...]:
        """Go on by a split; what it has of objects that begin or end in another, as _ENDS."""
        self.size, self.length = size, self.length + length
        none = (None,) * len(_ENDS)
        found = inside if self.in_string else outside
        if found is None or self.fault:
            self.fault = True
            return none
        effect = json.loads(found)
        head, before = self._target(), len(self.stack)
        self.in_string = effect["in"]
        if self.pending is not None:
            self.pending += effect["head"]
            if effect["ended"]:
                self._top().model, self.pending = self.pending, None
        if self.pending is None:
            self.pending = effect["pending"]
        for k, row in enumerate(effect["levels"]):
            level = _Level(*row)
            if k and not self.stack:
                self.excess += 1
            elif k:
                child = self.stack.pop()
                self._top().closes(child)
                self.fault = self.fault or _CLOSES[child.label] != level.label
            self._top().goes_on(level)
        left = len(self.stack)
        self.stack += [_Level(*row) for row in effect["opens"]]
        head_to = head_pos = head_items = None
        if head:
            depth, head_pos, head_items = head
            closing = before - depth + 1
            if closing >= len(effect["levels"]):
                return (_NO_END, head_pos, None, None, None, head_items, None)
            head_to = effect["levels"][closing][-1][0]
        tail = self._target()
        if tail is None or tail[0] <= left:
            return (head_to, head_pos, None, None, None, head_items, None)
        return (head_to, head_pos, *self.stack[tail[0] - 1].place, tail[1], head_items, tail[2])

    def _top(self) -> _Level:
        return self.stack[-1] if self.stack else self.root

    def ended(self) -> bool:
        """Whether the text is one complete value. Where it has no brace at its end, one too many
        was read."""
        assumed = self.length - self.size
        closed = not self.in_string and not self.stack and self.excess == assumed
        return closed and not self.fault and len(self.root.kids) == 1


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """State at the start of each split, from effects sorted by file and block. A file's last
    row also has what is known at its end."""
    names = ["file", "block", "in_string", "stack", *_ENDS, "model", "is_list", "has_items", "fault"]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.string(), *_ENDS.values(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]

    def out(rows: list[tuple[Any, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    file: str | None = None
    state = _File()
    last: tuple[Any, ...] = ()

    def end() -> tuple[Any, ...]:
        model, has_items = state.root.inner
        return *last, model, state.root.kids == "L", has_items, not state.ended()

    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if last:
                rows.append(end() if r["file"] != file else (*last, None, None, None, None))
            if r["file"] != file:
                file, state = r["file"], _File()
            last = (r["file"], r["block"], state.in_string, json.dumps([[x.label, x.commas] for x in state.stack]))
            last += state.take(r["size"], r["length"], r["outside"], r["inside"])
        if rows:
            yield out(rows)
    if last:
        yield out([end()])


class _Cut(_Tokens):
    """Cuts out the objects that are items, or the one object under the wanted key, of those that
    begin and end in one split. Pieces are (place among the items, text)."""

    def __init__(self, key: str, items: bool, in_string: bool, stack: list[list[Any]]) -> None:
        super().__init__(key, in_string)
        self.targets = _ITEMS if items else _MAP
        self.labels = [label for label, _ in stack]
        self.commas = [commas for _, commas in stack]
        self.pieces: list[tuple[int, bytes]] = []
        self.parts: list[bytes] = []
        opened = "".join(self.labels)
        inner = next((t for t in self.targets if opened.startswith(t)), None)
        # Depth of the object being cut out, and where it starts in this segment.
        self.depth = len(inner) if inner else 0
        self.begin = 0
        self.whole = False

    def segment(self, text: bytes) -> None:
        if not self._step(text):
            self.feed(text)
        if self.depth:
            if self.whole:
                self.parts.append(text[self.begin :] + b"}")
            self.begin = 0

    def _step(self, text: bytes) -> bool:
        """As `feed`, without a step for each token, where nothing but braces and whole strings
        matters: inside an object that is cut out, or from commas before one to its end."""
        if self.in_string or b"\\" in text or b"[" in text or b"]" in text:
            return False
        parts = text.split(b"{")
        if any(part.count(b'"') % 2 for part in parts):
            return False  # a brace in a string, or a string that goes on
        if not self.depth:
            if len(parts) == 1 or parts[0].strip(b", \t\r\n") or "".join(self.labels) + "O" not in self.targets:
                return False
            self.commas[-1] += parts[0].count(b",")
            self.open("O", len(parts[0]))
            parts = parts[1:]
        deeper = len(parts) - 1
        self.labels += ["O"] * deeper
        self.commas += [0] * deeper
        self.close("}", text, len(text))
        return True

    def comma(self) -> None:
        if self.commas:
            self.commas[-1] += 1

    def open(self, label: str, at: int) -> None:
        self.labels.append(label)
        self.commas.append(0)
        if not self.depth and len(self.labels) <= 3 and "".join(self.labels) in self.targets:
            self.depth, self.begin, self.whole = len(self.labels), at, True

    def close(self, bracket: str, text: bytes, at: int) -> None:
        if not self.labels:
            return  # the brace that was read at the end of a file without one
        if self.depth == len(self.labels):
            if self.whole:
                self.parts.append(text[self.begin : at] + b"}")
                self.pieces.append((self.commas[self.depth - 2], b"".join(self.parts)))
            self.parts, self.depth = [], 0
        self.labels.pop()
        self.commas.pop()


def _objects(key: str, items: bool):
    """(file, pos, value) of the objects that lie in one split."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[str, int] | None = None
        cut: _Cut | None = None
        for batch in batches:
            for now, part in _runs(batch):
                if now != at:
                    at = now
                    cut = _Cut(key, items, part.column("in_string")[0].as_py(), json.loads(part.column("stack")[0].as_py()))
                for text in part.column("value").to_pylist():
                    cut.segment(text)
                if cut.pieces:
                    pos, texts = zip(*cut.pieces)
                    columns = [pa.array([at[0]] * len(pos), pa.string()), pa.array(pos, pa.int64()), pa.array(texts, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["file", "pos", "value"])
                    cut.pieces = []

    return rows


class JsonFiles:
    """JSON files that hold a list of objects, or an object with such a list under a key.

    Brackets, strings and every object are checked; commas between values are not, and a file
    that holds neither a list nor an object is taken as no JSON. Texts are read three times:
    once for the states, and once each for objects within a split and those across splits.
    The states, one small row a split, are written once to the shared folder, so no reading
    finds them anew, and Spark sees by their size whether to join the texts without a shuffle.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "results") -> None:
        self.key = key
        texts = _segments(spark, path, "}")
        self._segments = texts.withColumn("value", F.col("value").cast("binary"))
        effects = self._segments.mapInArrow(
            _effects(key), "file string, block long, size long, length long, outside string, inside string"
        )
        dealt = effects.repartition("file").sortWithinPartitions(*_SPLIT)
        states = dealt.mapInArrow(_states, _STATE)
        file = Window.partitionBy("file")
        known = {n: F.max(n).over(file) for n in ("model", "is_list", "has_items", "fault")}
        bad = F.raise_error(F.concat(F.lit("Invalid JSON in "), F.col("file")))
        checked = states.withColumns(known).withColumn("in_string", F.when(F.col("fault"), bad).otherwise(F.col("in_string")))
        model = F.from_json(F.concat(F.lit('{"v":'), F.col("model"), F.lit("}")), "v STRING")["v"]
        found = checked.select(*_SPLIT, "in_string", "stack", *_ENDS, "is_list", "has_items", F.when(~F.col("is_list"), model).alias("file_model"))
        place = scratch(spark, "states")
        found.write.parquet(place)
        self._states = spark.read.schema(found.schema).parquet(place)

    def files(self) -> DataFrame:
        """(file, file_model, is_list, has_items): one row a file; `file_model` is the `model` text
        of an object itself, and `has_items` tells of an object whether its list has any."""
        first = self._states.where(F.col("block") == 0)
        return first.select("file", "file_model", "is_list", "has_items")

    def objects(self, items: bool = True) -> DataFrame:
        """(file, pos, value): texts of the list's objects by their place in it, or of the one
        object under the key."""
        placed = _in_order(self._segments, self._states.select(*_SPLIT, "in_string", "stack"))
        within = placed.select(*_SPLIT, "value", "in_string", "stack").mapInArrow(
            _objects(self.key, items), "file string, pos long, value binary"
        )
        both = within.unionByName(self._across(items))
        text = F.col("value").cast("string")
        sound = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v STRING")["v"].isNotNull()
        bad = F.raise_error(F.concat(F.lit("Invalid JSON in "), F.col("file")))
        return both.select("file", F.col("pos").cast("int").alias("pos"), F.when(sound, text).otherwise(bad).alias("value"))

    def _across(self, items: bool) -> DataFrame:
        """Objects that begin in one split and end in another: their segments, each with the brace
        that it was cut at, put together in order."""
        ends = self._states.select(
            *_SPLIT,
            F.when(F.col("head_items") == items, F.col("head_to")).alias("head_to"),
            F.when(F.col("tail_items") == items, F.col("tail_from")).alias("tail_from"),
            "head_pos",
            "tail_at",
            "tail_pos",
        ).where("head_to is not null or tail_from is not null")
        first = F.expr("substring(value, cast(tail_at + 1 AS int))")
        value = F.when(F.col("id") == F.col("tail_from"), first).otherwise(F.col("value"))
        parts = self._segments.join(ends, list(_SPLIT)).where("id <= head_to or id >= tail_from").select(
            "file",
            F.when(F.col("id") <= F.col("head_to"), F.col("head_pos")).otherwise(F.col("tail_pos")).alias("pos"),
            F.struct("block", "id", F.concat(value, F.lit(b"}")).alias("value")).alias("part"),
        )
        joined = F.aggregate(F.array_sort(F.collect_list("part")), F.lit(b""), lambda text, p: F.concat(text, p["value"]))
        return parts.groupBy("file", "pos").agg(joined.alias("value"))
