"""Near-duplicate operators against brute force, and their odd cases."""

import random
from itertools import combinations, permutations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldeval.llm import linededup, simhash
from fieldeval.llm.common import components

DOCS = "doc_id long, text string"


def roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def plain_simhash(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_is_the_plain_one():
    for text in ("", "  \n", "One", "a B", "É b c", "a b c d e f g a b c", "x " * 500):
        assert simhash.simhash(text.encode()) == plain_simhash(text)


@pytest.mark.parametrize("pairwise", [2, 64])
def test_links_join_all_near_pairs(spark, monkeypatch, pairwise):
    """Clusters of flips, with buckets small and split: components as from all pairs."""
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rng = random.Random(4)
    prints = {0, (1 << 64) - 1}
    for _ in range(12):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(25):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
        low = rng.choice([0, 21, 42])  # all flips inside one block
        prints.add(base ^ sum(1 << b for b in rng.sample(range(low, low + 21), 3)))
    near = [(a, b) for a, b in combinations(sorted(prints), 2) if (a ^ b).bit_count() <= 3]
    rows = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    edges = [(u % (1 << 64), v % (1 << 64)) for u, v in simhash.links(rows).collect()]
    assert all((u ^ v).bit_count() <= 3 for u, v in edges)
    assert roots(prints, edges) == roots(prints, near)


def test_components(spark):
    chain = [(k, k + 1) for k in range(60)]
    edges = spark.createDataFrame([*chain, (5, 5), (100, 200), (200, 100)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 200: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(spark):
    long = " ".join(f"w{k}" for k in range(300))
    rows = [(3, long, "c"), (9, long, "c"), (5, None, None), (7, "", "c"), (1, "other words here", "c"), (None, long, "c"), (5, None, None)]
    docs = spark.createDataFrame(rows, DOCS + ", fp string")
    got = sorted((r["doc_id"] or -1, r["component_id"], r["fingerprint"]) for r in simhash.near_duplicates(docs).collect())
    assert [(a, b) for a, b, _ in got] == [(-1, 3), (1, 1), (3, 3), (5, 5), (5, 5), (7, 5), (9, 3)]
    assert got[1][2] == f"{plain_simhash('other words here'):016x}" and got[3][2] == "0" * 16
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5]
    empty = docs.where("false")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def plain_lines(rows):
    """Texts less the lines that match any earlier one: all lines against all."""
    seen, out = [], {}
    for doc_id, text in sorted(rows):
        kept = []
        for line in text.split("\n"):
            words = frozenset(line.encode().split())
            if words and any(5 * len(words & s) >= 4 * len(words | s) for s in seen):
                seen.append(words)
                continue
            if words:
                seen.append(words)
            kept.append(line)
        out[doc_id] = "\n".join(kept)
    return out


def made_lines(seed, docs=40):
    rng = random.Random(seed)
    vocabulary = [f"t{k}" for k in range(60)]
    base = [rng.choices(vocabulary, k=rng.randint(1, 30)) for _ in range(25)]
    rows = []
    for doc_id in range(docs):
        lines = []
        for _ in range(rng.randint(0, 6)):
            words = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            lines.append(" ".join(words))
        rows.append((doc_id, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("hot, long, few", [(16_384, 96, 16), (3, 8, 16), (50, 8, 1)])
def test_lines_as_from_all_pairs(spark, monkeypatch, hot, long, few):
    monkeypatch.setattr(linededup, "HOT", hot)
    monkeypatch.setattr(linededup, "LONG", long)
    monkeypatch.setattr(linededup, "FEW", few)
    rows = made_lines(1)
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == plain_lines(rows)


def test_line_cases(spark):
    rows = [
        (1, "a b c d e\n\n  \na b c d e", 7, "x"),
        (2, None, 7, "x"),
        (3, "", 7, "x"),
        (4, "e d c b a\nnew line", 7, "x"),
        (4, "e d c b a\nnew line", 7, "x"),
        (5, "word " * 30_000, None, None),
        (6, "a b c d e", 7, "x"),
    ]
    docs = spark.createDataFrame(rows, DOCS + ", n_lines int, kept string")
    got = sorted((r["doc_id"], r["text"], r["n_lines"], r["n_removed"], r["kept"]) for r in linededup.dedup_lines(docs).collect())
    assert got[0] == (1, "a b c d e\n\n  ", 4, 1, "x")
    assert got[1] == (2, None, 0, 0, "x") and got[2] == (3, "", 1, 0, "x")
    assert got[3] == got[4] == (4, "new line", 2, 1, "x")
    assert got[5][1] == "word " * 30_000 and got[6] == (6, "", 1, 1, "x")
    kept = linededup.without_copied_lines(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 4, 5]
    assert {r["n_lines"] for r in kept.collect()} == {7, None}
    assert linededup.dedup_lines(docs.where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=90), max_size=6))
def test_words_hash_alike_wherever_they_stand(parts):
    import numpy as np

    data = b"\n".join(parts)
    hashes, _ = linededup.word_hashes(data)
    words = data.split()
    assert len(hashes) == len(words)
    assert len(set(hashes.tolist())) == len(set(words))


def test_words_hash_alike_in_any_text(monkeypatch):
    """The same word has the same hash wherever it is, in texts of any length; others differ."""
    monkeypatch.setattr(linededup, "_SPAN", 64)
    rng = random.Random(8)
    words = ["".join(rng.choices("abé", k=rng.choice((1, 2, 5, 20, 62, 63, 64, 65, 127, 128, 129, 300)))).encode() for _ in range(400)]
    seen = {}
    for low in range(0, 400, 9):
        held = words[low : low + 9]
        rng.shuffle(held)
        text = b"".join(w + rng.choice([b" ", b"\n", b" \t "]) for w in held)
        hashes, starts = linededup.word_hashes(rng.choice([b"", b"  "]) + text)
        assert len(hashes) == len(held)
        for word, found in zip(held, hashes.tolist()):
            assert seen.setdefault(word, found) == found
            assert linededup.word_hashes(b" x\n" + word)[0].tolist()[1] == found
    assert len(set(seen.values())) == len(seen)
    anagrams = ["".join(p) for p in set(permutations("aabbcdd"))]
    assert len(set(linededup.word_hashes(" ".join(anagrams).encode())[0].tolist())) == len(anagrams)


def test_postings_of_some_keys_alone(spark):
    """op3: the second round made the postings of all keys to join them with a few."""
    docs = spark.createDataFrame(made_lines(3), DOCS)
    keyed = linededup._once(linededup._keyed(docs))
    scan = linededup.written(linededup._texts(keyed).mapInArrow(linededup._scan_rows, linededup._SCAN), "scan")
    codes = spark.sparkContext.broadcast(linededup.rarity(scan))
    sets = linededup.first_lines(scan)
    every = {tuple(r) for r in linededup.postings(sets, keyed, codes).collect()}
    keys = np.unique(np.array([r[0] for r in every], np.int64).view(np.uint64))[::3]
    some = {tuple(r) for r in linededup.postings(sets, keyed, codes, spark.sparkContext.broadcast(keys)).collect()}
    assert some == {r for r in every if r[0] % (1 << 64) in set(keys.tolist())} and 0 < len(some) < len(every)
