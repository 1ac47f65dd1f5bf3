"""Quality classifier: heuristic labellers, their accuracies by EM, a hashed linear scorer."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldeval.llm.common import records, utf8

GOOD, BAD, ABSTAIN = 1, -1, 0
#: Documents that the scorer is fitted on at most: those with the smallest hash of doc_id.
SAMPLE = 6000
BUCKETS = 1 << 18
ROUNDS = 50
EPOCHS = 12
RATE = 0.5
RIDGE = 1e-6
SEED = 3
_UPPER = bytes(range(65, 91))
_NOT_LETTER = bytes(b for b in range(128) if not chr(b).isalpha())
_SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~"
_SENTENCE = re.compile(rb"[.!?\n]+")
#: Letters, capitals, digits, anything else as it is.
_SHAPE = bytes(
    97 if b >= 128 or chr(b).islower() else 65 if chr(b).isupper() else 48 if chr(b).isdigit() else b for b in range(256)
)
# Frequent words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    word.encode()
    for word in (
        "the of and to in a is that it for was on are as with be by at this from or an have not but"
        " der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an"
        " de la le et les des en un une du que est pour dans qui par sur pas au plus"
        " el los las y del se por con para una su al lo como más"
    ).split()
)


@dataclass
class Measures:
    """What the labellers look at."""

    words: int
    capitals: float
    symbols: float
    word_length: float
    function_words: float
    ended_lines: float
    bars: float
    repeated: float


def measure(text: bytes) -> Measures:
    """Shares of a whole text."""
    words = text.split()
    n = max(1, len(words))
    letters = max(1, len(text.translate(None, _NOT_LETTER)))
    dense = max(1, sum(map(len, words)))
    lines = [line for line in map(bytes.rstrip, text.split(b"\n")) if line]
    sentences = [s for s in map(bytes.strip, _SENTENCE.split(text)) if len(s) > 3]
    size = max(1, sum(map(len, sentences)))
    return Measures(
        words=len(words),
        capitals=(len(text) - len(text.translate(None, _UPPER))) / letters,
        symbols=(len(text) - len(text.translate(None, _SYMBOLS))) / dense,
        word_length=dense / n,
        function_words=sum(map(FUNCTION_WORDS.__contains__, text.lower().split())) / n,
        ended_lines=sum(line.endswith((b".", b"!", b"?", b'"')) for line in lines) / max(1, len(lines)),
        bars=words.count(b"|") / n,
        repeated=max(1 - sum(map(len, set(sentences))) / size, sum(map(bytes.__eq__, words, words[1:])) / n),
    )


def _vote(value: float, good: Callable[[float], bool], bad: Callable[[float], bool]) -> int:
    return GOOD if good(value) else BAD if bad(value) else ABSTAIN


LABELLERS: dict[str, Callable[[Measures], int]] = {
    "capitals": lambda m: _vote(m.capitals, lambda x: x < 0.15, lambda x: x > 0.4),
    "symbols": lambda m: _vote(m.symbols, lambda x: x < 0.02, lambda x: x > 0.08),
    "word_length": lambda m: _vote(m.word_length, lambda x: 2.5 < x < 9, lambda x: x < 2 or x > 14),
    "function_words": lambda m: (
        ABSTAIN if m.words < 20 else _vote(m.function_words, lambda x: x > 0.08, lambda x: x < 0.03)
    ),
    "ended_lines": lambda m: _vote(m.ended_lines, lambda x: x > 0.7, lambda x: x < 0.3),
    "bars": lambda m: ABSTAIN if m.words < 5 else _vote(m.bars, lambda x: x == 0, lambda x: x > 0.1),
    "repeated": lambda m: ABSTAIN if m.words < 20 else _vote(m.repeated, lambda x: x < 0.1, lambda x: x > 0.3),
}


def votes(text: bytes) -> list[int]:
    m = measure(text)
    return [label(m) for label in LABELLERS.values()]


@dataclass
class LabelModel:
    """Prior of good, and how often each labeller, where it votes, votes good in each class."""

    prior: float
    good_votes: np.ndarray  # (bad or good class, labeller)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes; who abstains says nothing."""
        praise = np.log(self.good_votes[1] / self.good_votes[0])
        blame = np.log((1 - self.good_votes[1]) / (1 - self.good_votes[0]))
        logit = (patterns == GOOD) @ praise + (patterns == BAD) @ blame + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def accuracy(self) -> np.ndarray:
        """How often each labeller is right where it votes."""
        return (1 - self.prior) * (1 - self.good_votes[0]) + self.prior * self.good_votes[1]


def estimate(patterns: np.ndarray, counts: np.ndarray) -> LabelModel:
    """Expectation-maximisation over vote patterns and how often each occurs.

    The first guess takes a text with any bad vote for bad: junk of one kind is noticed by
    few labellers, and the others' good votes must not outvote them before their accuracies
    are known.
    """
    good = np.where((patterns == BAD).any(axis=1), 0.2, 0.95)
    for _ in range(ROUNDS):
        share = np.stack([1 - good, good]) * counts
        praise, blame = share @ (patterns == GOOD), share @ (patterns == BAD)
        # Half an imagined vote each way keeps the rates off 0 and 1.
        rates = (praise + 0.5) / (praise + blame + 1)
        prior = (float(good @ counts) + 1) / (float(counts.sum()) + 2)
        model = LabelModel(prior, rates)
        good = model.posterior(patterns)
    return model


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, weight) of a whole text: its words, the shapes of their ends and
    their stutter, each a share."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    half = BUCKETS // 2
    hashed = np.fromiter(map(crc32, words), np.int64, len(words)) % half
    bucket, count = np.unique(hashed, return_counts=True)
    shapes = Counter(word[-4:] for word in text.translate(_SHAPE).split())
    shapes[b" "] = sum(map(bytes.__eq__, words, words[1:]))  # words that repeat the one before
    of_shape = np.fromiter((half + crc32(s) % half for s in shapes), np.int64, len(shapes))
    shape_count = np.fromiter(shapes.values(), np.float64, len(shapes))
    return np.concatenate([bucket, of_shape]), np.concatenate([count, shape_count]) / len(words)


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, text: bytes) -> float:
        bucket, value = features(text)
        return float(1 / (1 + np.exp(-np.clip(self.weights[bucket] @ value + self.bias, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray) -> Scorer:
    """Logistic regression on soft labels, by adaptive steps in a seeded order."""
    rng = np.random.default_rng(SEED)
    weights, seen = np.zeros(BUCKETS), np.full(BUCKETS, 1e-3)
    bias, bias_seen = 0.0, 1e-3
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)).tolist():
            bucket, value = rows[k]
            z = np.clip(weights[bucket] @ value + bias, -30, 30)
            error = 1 / (1 + np.exp(-z)) - target[k]
            slope = error * value + RIDGE * weights[bucket]
            seen[bucket] += slope * slope
            weights[bucket] -= RATE * slope / np.sqrt(seen[bucket])
            bias_seen += error * error
            bias -= RATE * error / np.sqrt(bias_seen)
    return Scorer(weights, float(bias))


_VOTE = "v string"


def _vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = ["".join("-0+"[v + 1] for v in votes(text)) for text in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["v"])


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for rank, text in records(iter([batch])):
            bucket, value = features(text)
            out.append((rank, bytes(v + 1 for v in votes(text)), bucket.astype("<i4").tobytes(), value.astype("<f4").tobytes()))
        columns = zip(*out) if out else [()] * 4
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)], ["rank", "votes", "bucket", "value"]
        )


def train(docs: DataFrame) -> tuple[LabelModel, Scorer]:
    """The label model over all texts, and the scorer on the posterior labels of a sample.

    What comes to the driver is bounded: at most 3 ** len(LABELLERS) patterns with counts,
    and the features of SAMPLE documents.
    """
    texts = docs.select(F.xxhash64("doc_id").alias("rank"), utf8("text").alias("text"))
    found = texts.select("text").mapInArrow(_vote_rows, _VOTE).groupBy("v").count().orderBy("v").collect()
    patterns = np.array([["-0+".index(c) - 1 for c in row["v"]] for row in found]).reshape(-1, len(LABELLERS))
    model = estimate(patterns, np.array([row["count"] for row in found], float))
    # The bound of the rank that lets about SAMPLE rows pass is known from their number.
    number = sum(row["count"] for row in found)
    share = min(1.0, 1.2 * SAMPLE / max(1, number))
    some = texts.where(F.pmod("rank", F.lit(1 << 30)) < share * (1 << 30))
    rows = some.mapInArrow(_sample_rows, "rank long, votes binary, bucket binary, value binary")
    rows = rows.orderBy("rank", "bucket", "value").limit(SAMPLE).collect()
    sparse = [
        (np.frombuffer(row["bucket"], "<i4").astype(np.int64), np.frombuffer(row["value"], "<f4").astype(np.float64))
        for row in rows
    ]
    seen = np.array([[v - 1 for v in row["votes"]] for row in rows]).reshape(-1, len(LABELLERS))
    return model, fit(sparse, model.posterior(seen))


def scored(docs: DataFrame, scorer: Scorer, least: float = 0.5) -> DataFrame:
    """(doc_id, score, keep) for every row: score is the probability of good quality, keep is
    whether it reaches `least`. Null texts count as empty; texts without words have the score
    of the bias alone. Repeated rows repeat; an empty table gives no rows."""
    held = docs.sparkSession.sparkContext.broadcast(scorer)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value.score(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.float64()), pa.array([s >= least for s in found], pa.bool_())],
                ["doc_id", "score", "keep"],
            )

    return docs.select(F.col("doc_id").cast("long"), utf8("text").alias("text")).mapInArrow(
        rows, "doc_id long, score double, keep boolean"
    )
