"""Benchmark decontamination against brute force."""

import hashlib
import random
import re

import pytest

from fieldeval.llm import decontaminate

DOCS = "doc_id long, text string, key int, spans string, n_words int"
ITEMS = "item_id long, text string, word string"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, window=10):
    own = words(text)
    hit, found = set(), set()
    for key, item in items:
        held = words(item)
        size = min(window, len(held))
        grams = {tuple(held[k : k + size]) for k in range(len(held) - size + 1)} if size else set()
        for k in range(len(own) - size + 1):
            if tuple(own[k : k + size]) in grams:
                hit |= set(range(k, k + size))
                found.add("" if key is None else str(key))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(own), len(hit), len(found), digest, bool(hit), hit


def made(seed, n_docs=120, n_items=40, letters="abc"):
    rnd = random.Random(seed)

    def text(low, high):
        return rnd.choice(" .,-").join(rnd.choice(letters) * rnd.choice((1, 1, 2)) for _ in range(rnd.randint(low, high)))

    items = [(k, text(1, 40)) for k in range(n_items)] + [(7, text(12, 30)), (None, text(11, 20)), (90, None), (91, " .,")]
    items += [(100 + k, items[3][1]) for k in range(30)]
    docs = [(k, text(0, 120)) for k in range(n_docs)]
    docs += [(500 + k, f"x{k} {items[rnd.randrange(n_items)][1].upper()} É y") for k in range(40)]
    docs += [(600, None), (601, ""), (602, "?!"), (None, items[5][1]), docs[3], docs[3]]
    return docs, items


@pytest.mark.parametrize("letters", ["abc", "abcdefghijklmnopqrstuvwxyzéß"])
@pytest.mark.parametrize("block, piece, size", [(500_000, 20_000, 1 << 20), (150, 20, 64)])
def test_against_brute_force(spark, monkeypatch, letters, block, piece, size):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", piece)
    monkeypatch.setattr(decontaminate, "PIECE_BYTES", size)
    docs, items = made(len(letters) + block, letters=letters)
    if letters != "abc":
        items = [x for x in items if len(words(x[1])) >= 8]
    table = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], DOCS).repartition(3)
    bench = spark.createDataFrame([(*i, "x") for i in items], ITEMS)
    got = sorted((tuple(r) for r in decontaminate.contamination(table, bench).collect()), key=repr)
    assert got == sorted(((k, *brute(t, items)[:5]) for k, t in docs), key=repr)


def test_long_text_and_many_copies(spark):
    rnd = random.Random(5)
    item = " ".join(f"w{rnd.randrange(300)}" for _ in range(60))
    filler = " ".join(f"w{rnd.randrange(300)}" for _ in range(400_000))
    docs = [(0, f"{filler} {item} {filler}"), (1, "a" * 3_000_000 + " " + item)] + [(2 + k, item) for k in range(300)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(k, item) for k in range(200)], "item_id int, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(table, bench).collect()}
    assert len(got) == 302 and all(r["n_items"] == 200 and r["n_hit"] == 60 for r in got.values())
    assert got[0]["n_words"] == 800_060 and got[1]["n_words"] == 61


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    no_items = spark.createDataFrame([], ITEMS)
    assert decontaminate.contamination(none, no_items).count() == 0
    got = decontaminate.contamination(docs, no_items).first()
    assert tuple(got) == (1, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False)
    assert decontaminate.without_leaks(none, no_items).count() == 0


@pytest.mark.parametrize("block", [500_000, 150])
def test_spans_are_cut(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    docs, items = made(9)
    items = [x for x in items if len(words(x[1])) >= 10]
    docs += [(700, "Fine start, " + "own words here " * 30 + items[0][1] + "; fine end"), (701, items[0][1])]
    table = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], DOCS)
    bench = spark.createDataFrame([(*i, "x") for i in items], ITEMS)
    out = decontaminate.without_leaks(table, bench)
    assert out.columns == table.columns
    want = []
    for key, text in docs:
        n, n_hit, *_, hit = brute(text, items)
        if n_hit <= 0.5 * n or not n_hit:
            want.append((key, [w for k, w in enumerate(words(text)) if k not in hit]))
    got = [(r["doc_id"], words(r["text"])) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    assert kept[600] is None and kept[601] == "" and 701 not in kept
    assert kept[700] == "Fine start, " + "own words here " * 30 + "; fine end"
