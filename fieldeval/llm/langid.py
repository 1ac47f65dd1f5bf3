"""Language identification with a byte convolutional network trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldeval.llm.common import records, set_aside, with_fields

UNDETERMINED = "und"
WINDOW = 256
#: Widest first: the filters that reach offset k are then the first ones.
WIDTHS = (5, 4, 3, 2)
FILTERS = 8
EMBEDDING = 8
#: Bounds of the training sample: documents for each language, windows for each document.
DOCS_PER_LANG = 500
WINDOWS_PER_DOC = 6
EPOCHS = 6
BATCH = 64
RATE = 0.01
SEED = 7
_CHUNK_WINDOWS = 48
_LETTER = regex.compile(r"\p{L}")
#: ASCII that is no letter reads as a space; lower case is done before.
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_POSITIONS = WINDOW - max(WIDTHS) + 1


def folded(text: str) -> bytes:
    """Lower-case bytes with runs of anything but letters and non-ASCII as one space."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_FOLD).split())


def windows(data: bytes) -> np.ndarray:
    """All of the bytes as rows of WINDOW, the last one filled up with spaces."""
    rows = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(rows * WINDOW), np.uint8).reshape(rows, WINDOW)


def _reach(offset: int) -> int:
    return FILTERS * sum(width > offset for width in WIDTHS)


@dataclass
class ByteConvNet:
    """Embedding, filters of several widths, max pooling over a window, softmax."""

    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]  # for each offset: (reached filters, embedding)
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    tables: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def fresh(cls, langs: list[str], rng: np.random.Generator) -> ByteConvNet:
        n = FILTERS * len(WIDTHS)
        return cls(
            langs,
            rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
            [rng.normal(0, 0.4, (_reach(k), EMBEDDING)).astype(np.float32) for k in range(max(WIDTHS))],
            np.zeros(n, np.float32),
            rng.normal(0, 0.3, (n, len(langs))).astype(np.float32),
            np.zeros(len(langs), np.float32),
        )

    def tabulate(self) -> None:
        """What each byte adds at each offset: convolution then is a sum of table rows."""
        self.tables = [np.ascontiguousarray(self.embed @ w.T) for w in self.filters]

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each window, and where it is."""
        index = x.astype(np.intp)
        total = self.tables[0][index[:, :_POSITIONS]]
        for k, table in enumerate(self.tables[1:], 1):
            total[:, :, : table.shape[1]] += table[index[:, k : k + _POSITIONS]]
        return total.max(axis=1) + self.bias, total

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """One row of class probabilities for each window."""
        parts = []
        for at in range(0, len(x), _CHUNK_WINDOWS):
            top, _ = self.pooled(x[at : at + _CHUNK_WINDOWS])
            parts.append(_softmax(np.tanh(top) @ self.dense + self.dense_bias))
        return np.concatenate(parts)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.bias, self.dense, self.dense_bias]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Cross-entropy gradients; pooling passes them on at the largest response alone."""
        top, total = self.pooled(x)
        where = total.argmax(axis=1)
        act = np.tanh(top)
        delta = _softmax(act @ self.dense + self.dense_bias)
        delta[np.arange(len(y)), y] -= 1
        delta /= len(y)
        d_top = (delta @ self.dense.T) * (1 - act * act)
        d_embed = np.zeros_like(self.embed)
        d_filters = []
        rows = np.arange(len(x))[:, None]
        for k, w in enumerate(self.filters):
            n = len(w)
            seen = x[rows, where[:, :n] + k]
            g = d_top[:, :n, None]
            d_filters.append((g * self.embed[seen]).sum(axis=0))
            np.add.at(d_embed, seen.ravel(), (g * w).reshape(-1, EMBEDDING))
        return [d_embed, *d_filters, d_top.sum(axis=0), act.T @ delta, delta.sum(axis=0)]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, langs: list[str]) -> ByteConvNet:
    """The network trained with Adam; each language weighs as much as its windows."""
    rng = np.random.default_rng(SEED)
    net = ByteConvNet.fresh(langs, rng)
    mean = [np.zeros_like(p) for p in net.parameters()]
    square = [np.zeros_like(p) for p in net.parameters()]
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            step += 1
            net.tabulate()
            take = order[at : at + BATCH]
            for p, m, s, g in zip(net.parameters(), mean, square, net.gradients(x[take], y[take])):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    net.tabulate()
    return net


def _training_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for lang, rank, text in records(iter([batch])):
            rows = windows(folded(text))
            picked = np.unique(np.linspace(0, len(rows) - 1, WINDOWS_PER_DOC).astype(int))
            out.append((lang, rank, rows[picked].tobytes()))
        langs, ranks, data = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(ranks, pa.float64()), pa.array(data, pa.binary())],
            ["lang", "rank", "data"],
        )


def in_fold() -> Column:
    """True for rows held out of training."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return F.coalesce(fold == 0, F.lit(False))


def train(docs: DataFrame) -> ByteConvNet | None:
    """The network fitted on documents outside the held-out fold; None without any.

    At most DOCS_PER_LANG documents of each language, those with the smallest hash of their
    id, and WINDOWS_PER_DOC windows of each come to the driver.
    """
    known = docs.where(~in_fold() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select("doc_id", "text", "lang")
    counts = {row["lang"]: row["count"] for row in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    langs = sorted(counts)
    # About twice the bound passes the hash test; the exact bound is taken from these.
    shares = F.create_map(*[F.lit(v) for k in langs for v in (k, min(1.0, 2.0 * DOCS_PER_LANG / counts[k]))])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) / float(1 << 32)
    some = known.withColumn("rank", place / shares[F.col("lang")]).where("rank < 1")
    found = some.select("lang", "rank", "text").mapInArrow(_training_windows, "lang string, rank double, data binary")
    rows = found.orderBy("rank", "lang", "data").limit(4 * DOCS_PER_LANG * len(langs)).collect()
    taken = dict.fromkeys(langs, 0)
    x, y = [], []
    for lang, _, data in rows:
        if taken[lang] < DOCS_PER_LANG:
            taken[lang] += 1
            part = np.frombuffer(data, np.uint8).reshape(-1, WINDOW)
            x.append(part)
            y += [langs.index(lang)] * len(part)
    return fit(np.concatenate(x), np.array(y), langs)


def predict(texts: list[str | None], net: ByteConvNet | None) -> list[tuple[str, float]]:
    """(language, score) of each whole text: window probabilities averaged by their bytes."""
    out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
    if net is None:
        return out
    kept = [i for i, text in enumerate(texts) if text is not None and _LETTER.search(text)]
    if not kept:
        return out
    data = [folded(texts[i]) for i in kept]
    rows = [windows(d) for d in data]
    starts = np.cumsum([0, *(len(r) for r in rows)])
    weight = np.full(starts[-1], float(WINDOW))
    weight[starts[1:] - 1] = [max(1, len(d) - WINDOW * (len(r) - 1)) for d, r in zip(data, rows)]
    p = net.probabilities(np.concatenate(rows)) * weight[:, None]
    p = np.add.reduceat(p, starts[:-1], axis=0) / np.add.reduceat(weight, starts[:-1])[:, None]
    for i, best, score in zip(kept, p.argmax(axis=1), p.max(axis=1)):
        out[i] = (net.langs[best], min(1.0, float(score)))
    return out


def identify(docs: DataFrame, net: ByteConvNet | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All rows and columns of docs with language and score beside them under `names`
    (columns of those names are replaced). Null texts and texts without a letter are `und`
    with score 0, and so is everything where nothing was learnt. Ties go to the first
    language in order.
    """
    docs = docs.drop(*names)
    schema = with_fields(docs, (names[0], T.StringType()), (names[1], T.DoubleType()))
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                found = predict(part.column(at).to_pylist(), net)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array([lang for lang, _ in found], pa.string()),
                        pa.array([score for _, score in found], pa.float64()),
                    ],
                    [*part.schema.names, *names],
                )

    return docs.mapInArrow(rows, schema)


def kept_languages(docs: DataFrame, above_chance: float = 1.1) -> DataFrame:
    """The documents whose language is found, unchanged.

    Rejected are texts that are null or have no letter, and those whose best score is not
    above chance: under `above_chance` times the share that each of the learned languages has
    if none is told from the others. A text in several languages has shares of each and stays.
    Repeated rows are decided alike; an empty table gives no rows.
    """
    names = ("found_language", "found_score")
    docs, back = set_aside(docs, *names)
    net = train(docs)
    least = above_chance / len(net.langs) if net is not None and len(net.langs) > 1 else 0.0
    found = identify(docs, net, names)
    kept = found.where((F.col(names[0]) != UNDETERMINED) & (F.col(names[1]) >= least))
    return kept.select(docs.columns).withColumnsRenamed(back)
