"""Divergence of sources against plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldeval.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, digest long, n string"


def brute(docs, least=3, most=200):
    groups, langs, dfs = {}, {}, {}
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups.setdefault((lang, source), Counter()).update(terms)
        langs.setdefault(lang, Counter()).update(terms)
        dfs.setdefault(lang, Counter()).update(set(terms))
    out = []
    for (lang, source), counts in groups.items():
        kept = [t for t, d in dfs[lang].items() if d >= least]

        def p(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        own, whole = p(counts), p(langs[lang])
        pairs = []
        for (lang2, other), theirs in groups.items():
            if lang2 == lang and other != source:
                q = p(theirs)
                pairs.append((-sum((own[t] - q[t]) ** 2 // q[t] for t in kept), other))
        tops = [(-((own[t] - whole[t]) ** 2 // whole[t]), t) for t in kept if counts[t] and own[t] > whole[t]]
        for part, found in (("pair", pairs), ("term", tops)):
            found.sort(key=lambda x: (x[0], x[1].encode()))
            for k, (value, item) in enumerate(found if part == "pair" else found[:most], 1):
                out.append((lang, source, part, item, -value, k))
    return sorted(out)


def made(seed, n=150, n_sources=9):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 4))) for _ in range(120)]
    docs = []
    for _ in range(n):
        source = rnd.choice(["hot", "hot", "hot", *(f"s{k}" for k in range(n_sources))])
        words = [rnd.choice(vocabulary[: 120 if source == "hot" else 40]) for _ in range(rnd.randint(0, 60))]
        docs.append((rnd.choice(" .,1_").join(words).upper() if rnd.random() < 0.2 else " ".join(words), rnd.choice(["en", "de", None]), source))
    docs += [(None, "en", "none"), ("", "fr", "a"), ("?! 12", "fr", "b"), ("one two", "it", None), ("x", None, None)]
    return docs + [docs[0]] * 5


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, docs):
    return spark.createDataFrame([(k, *d, 1, "x") for k, d in enumerate(docs)], SCHEMA).repartition(3)


@pytest.mark.parametrize("held, piece, cells, block, bucket", [(200_000, 1 << 20, 1 << 18, 256, 2000), (50, 16, 30, 4, 10)])
def test_against_plain_python(spark, monkeypatch, held, piece, cells, block, bucket):
    names = ("HELD_TERMS", "PIECE_BYTES", "CELLS", "SOURCE_BLOCK", "BUCKET_TERMS")
    for name, value in zip(names, (held, piece, cells, block, bucket)):
        monkeypatch.setattr(divergence, name, value)
    docs = made(held)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, 10_000 if held > 50 else 5)
    try:
        assert rows(divergence.audit(frame(spark, docs))) == brute(docs)
    finally:
        spark.conf.unset(size)


@pytest.mark.parametrize("bits", [0, 3, 7])
def test_colliding_digests_are_split(spark, bits):
    docs = made(4)
    assert rows(divergence.audit(frame(spark, docs), digest_bits=bits)) == brute(docs)


def test_colliding_groups_get_another_seed(spark, monkeypatch):
    plain = divergence._group_ids
    seeds = []

    def ids(seed):
        seeds.append(seed)
        found = plain(seed)
        return found if seed > 1 else {name: F.lit(1).cast("long") for name in found}

    monkeypatch.setattr(divergence, "_group_ids", ids)
    docs = made(5, n=40)
    assert rows(divergence.audit(frame(spark, docs))) == brute(docs) and seeds == [0, 1, 2]


def test_ties_beyond_the_last_rank(spark):
    """Many terms of equal value around the last rank: the smallest items rank."""
    words = [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrstuvw"]
    docs = [(" ".join(words), "en", "one")] * 3 + [("other words here", "en", "two")] * 3
    docs += [(" ".join(words[:7] * 3), "en", "one")]
    assert rows(divergence.audit(frame(spark, docs))) == brute(docs)


def test_empty_table_and_long_text(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    rnd = random.Random(3)
    long = " ".join(rnd.choice(["aa", "bb", "cc", "dd"]) for _ in range(900_000))
    docs = [(long, "en", "a"), ("aa bb", "en", "b"), ("aa bb dd", "en", "b"), ("z" * 2_000_000, "en", "c")]
    assert rows(divergence.audit(frame(spark, docs), 2)) == brute(docs, 2)
