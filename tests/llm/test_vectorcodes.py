"""Vector codes against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest

from fieldeval.llm import vectorcodes

SCHEMA = "vec_id long, embedding array<float>, label int, code int, vector string"


def brute(rows, parts=16, entries=64, rounds=2):
    """Codes by the definition, with Python integers alone."""
    out = []
    sound = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    for size in {len(r[1]) for r in sound}:
        own = [(k, [math.floor(256 * float(np.float32(x))) for x in v], label) for k, v, label in sound if len(v) == size]
        own.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        cuts = [(k * size // parts, (k + 1) * size // parts) for k in range(parts)]
        books = [[v[a:b] for _, v, _ in own[:entries]] for a, b in cuts]

        def best(part, x):
            return min((sum((p - q) ** 2 for p, q in zip(x, e)), k) for k, e in enumerate(books[part]))

        for _ in range(rounds):
            new = [list(b) for b in books]
            for part, (a, b) in enumerate(cuts):
                groups = {}
                for _, v, _ in own:
                    groups.setdefault(best(part, v[a:b])[1], []).append(v[a:b])
                for e, vs in groups.items():
                    new[part][e] = [sum(c) // len(c) for c in zip(*vs)]
            books = new
        text = ",".join(str(x) for book in books for e in book for x in e)
        sha = hashlib.sha256(text.encode()).hexdigest()
        for key, v, label in own:
            found = [best(part, v[a:b]) for part, (a, b) in enumerate(cuts)]
            out.append((key, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label, sha))
    totals = {}
    for *_, error, label, _ in out:
        totals[label] = totals.get(label, 0) + error

    def long(x):
        return x if x < 2**63 else None

    return sorted(((k, c, long(e), long(totals[label]), s) for k, c, e, label, s in out), key=repr)


def check(spark, rows):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    assert sorted((tuple(r) for r in vectorcodes.codes(table).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("spread, size", [(0.3, 32), (3000.0, 32), (0.01, 19), (1e6, 16)])
def test_against_brute_force(spark, spread, size):
    rnd = random.Random(size)
    rows = [(k, [float(np.float32(rnd.gauss(0, spread))) for _ in range(size)], rnd.choice([0, 0, 1, 2, None])) for k in range(150)]
    rows += [(300 + k, rows[0][1], 5) for k in range(40)]  # ties and copies
    rows += [rows[3], rows[3], (None, rows[9][1], None), (-5, rows[7][1], 1)]
    rows += [(400, None, 0), (401, [None] * size, 0), (402, [math.nan] * size, 0), (403, [-math.inf] + [0.0] * (size - 1), 0)]
    check(spark, rows)


def test_lengths_and_few_rows(spark):
    rnd = random.Random(2)
    rows = [(k, [rnd.gauss(0, 1) for _ in range(16 + 16 * (k % 2))], k % 3) for k in range(21)]
    rows += [(50, [], 1), (51, [0.5, -0.5], 1), (52, [0.25, 3.0], None)]
    check(spark, [(k, [float(np.float32(x)) for x in v], label) for k, v, label in rows])


def test_empty_table_and_no_label(spark):
    assert vectorcodes.codes(spark.createDataFrame([], SCHEMA)).count() == 0
    plain = spark.createDataFrame([(1, [1.0] * 16), (2, [2.0] * 16)], "vec_id int, embedding array<double>")
    assert [tuple(r)[:4] for r in vectorcodes.codes(plain).orderBy("vec_id").collect()] == [(1, "00" * 16, 0, 0), (2, "01" * 16, 0, 0)]


def test_huge_components_have_no_long_error(spark):
    rows = [(k, [1e30 * k * ((-1) ** j) for j in range(16)]) for k in range(70)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in vectorcodes.codes(table).collect()}
    assert len(got) == 70 and got[0]["error"] == 0 and got[69]["error"] is None


def test_decode_names_the_entries():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-200, 200, (300, 48))
    book = vectors[:64]
    found = vectorcodes.assign(vectors, book)
    for row, code, error in zip(vectors, found.codes, found.errors):
        near = vectorcodes.decode(bytes(code.astype(np.uint8)).hex(), book)
        assert ((row - near) ** 2).sum() == error
    assert not found.errors[:64].any()
