"""The pipeline: every stage on the rows before it, against plain Python."""

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from pyspark.sql import functions as F

import corpus_pipeline
from fieldeval.llm import langid, mixing
from test_dedup import plain_lines, plain_simhash, roots
from test_search import plain_targets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LANGUAGES = {
    "en": "the and of to in that with for was not this from which there their been water house river stone".split(),
    "de": "der und die das nicht mit für auf eine sich auch nach wird über wasser haus fluss stein straße".split(),
    "fr": "le et les des que dans pour pas une avec être cette sont mais eau maison rivière pierre forêt".split(),
}


def made(seed):
    rnd = random.Random(seed)

    def line(lang, n=None):
        return " ".join(rnd.choices(LANGUAGES[lang], k=n or rnd.randint(8, 16)))

    shared = {lang: line(lang, 14) for lang in LANGUAGES}
    rows = []
    for k in range(150):
        lang = rnd.choice(list(LANGUAGES))
        lines = [line(lang) for _ in range(rnd.randint(2, 6))]
        if rnd.random() < 0.4:
            lines.insert(rnd.randrange(len(lines)), shared[lang])
        rows.append((k, "\n".join(lines), lang, rnd.choice(["hot", "hot", "b", "c", "d"])))
    for k in range(150, 170):  # copies with one line of their own
        _, text, lang, source = rows[rnd.randrange(150)]
        rows.append((k, text + "\n" + line(lang), lang, source))
    rows += [(300, None, "en", "b"), (301, "", "en", "b"), (302, "12 34 ++ 77", None, "c"), (303, "!", "fr", None)]
    rows += [rows[5], (None, line("en") + "\n" + line("en"), "en", "d"), (400, "\n".join(line("de") for _ in range(900)), "de", "d")]
    return [(k, t, lang, s, None if t is None else len(t)) for k, t, lang, s in rows]


@pytest.fixture(scope="module")
def stages(spark):
    """(name, rows before, rows after) of every stage, each on what the one before it kept."""
    docs = spark.createDataFrame(made(3), DOCS).repartition(4)
    out = []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.written(stage(spark, docs, ""), name)
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_and_columns(stages):
    assert list(stages) == ["language_id", "line_dedup", "simhash_near_dedup", "source_mixing", "best_fit_packing"]
    assert all(after.columns == DOCS_NAMES for name, (_, after) in stages.items() if name != "best_fit_packing")


DOCS_NAMES = [part.split()[0] for part in DOCS.split(", ")]


def test_language(stages):
    """Kept are rows whose best mean probability over all windows is above chance, unchanged."""
    before, after = stages["language_id"]
    net = langid.train(before)
    found = dict(zip(range(10_000), before.collect()))
    scores = langid.predict([r["text"] for r in found.values()], net)
    want = [tuple(r) for r, (lang, score) in zip(found.values(), scores) if lang != langid.UNDETERMINED and score >= 1.1 / 3]
    assert rows(after) == sorted(want, key=repr)
    kept = {r[0] for r in want}
    assert not kept & {300, 301, 302, 303} and len(kept & set(range(170))) >= 168


def test_language_keeps_clean_documents(spark):
    """All labelled documents with letters stay, those of several languages as well."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.col("text").rlike("[a-z]"))
    mixed = docs.where("length(text) > 400").groupBy((F.col("doc_id") % 20).alias("doc_id")).agg(
        F.array_join(F.collect_list(F.substring("text", 1, 400)), " ").alias("text"),
        F.first("lang").alias("lang"), F.first("source").alias("source"), F.lit(0).cast("long").alias("n_chars"),
    )
    both = docs.unionByName(mixed)
    assert langid.kept_languages(both).count() == both.count()


def test_lines(stages):
    """Lines that match an earlier one go, and documents that lost every line with words."""
    before, after = stages["line_dedup"]
    texts = {(-1 if r["doc_id"] is None else r["doc_id"]): r["text"] for r in before.collect()}
    left = plain_lines(list(texts.items()))
    want = {k: t for k, t in left.items() if t == texts[k] or t.split()}
    got = {(-1 if r["doc_id"] is None else r["doc_id"]): r for r in after.collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    # Rows alike are one document and lose the same lines, so row 5 is there twice.
    assert after.where("doc_id = 5").count() == before.where("doc_id = 5").count() == 2
    assert any(t != texts[k] for k, t in want.items())


def test_near_duplicates(stages):
    before, after = stages["simhash_near_dedup"]
    held = {(math.inf if r["doc_id"] is None else r["doc_id"]): tuple(r) for r in before.collect()}
    prints = {k: plain_simhash(r[1]) for k, r in held.items()}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    first = set(roots(prints, near).values())
    assert rows(after) == sorted((held[k] for k in first), key=repr)


def test_mix(stages):
    before, after = stages["source_mixing"]
    sizes, texts = {}, {}
    for r in before.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
        texts[tuple(r)] = r["source"]
    aims = plain_targets(sizes)
    taken = {}
    for r in after.collect():
        taken[tuple(r)] = taken.get(tuple(r), 0) + 1
    assert set(taken) <= set(texts)
    for row, source in texts.items():
        rate = aims[source] / sizes[source]
        assert math.floor(rate) <= taken.get(row, 0) <= math.ceil(rate)


def test_pack(stages):
    before, after = stages["best_fit_packing"]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in before.collect():
        ids = np.array([*plain.encode(r["text"], add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        starts = [0, *range(first, len(ids), 2048)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want.append((r["doc_id"], k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    got = after.collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(places) <= -(-sum(w[3] for w in want) // 2048) + 1


def test_run_and_empty_table(spark, folder):
    spark.createDataFrame(made(3), DOCS).write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() > 0
    docs = spark.createDataFrame([], DOCS + ", found_language string, kept int, size int, copy int")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_null_ids_are_drawn_apart(spark):
    """Two sources of rows without an id: each comes near its target."""
    rows_ = [(None, f"{'w ' * 9}{s}{k}", s) for s in "ab" for k in range(500)]
    table = spark.createDataFrame(rows_, "doc_id long, text string, source string")
    found = mixing.shares(table).groupBy("target").agg(F.sum("taken").alias("taken")).collect()
    assert sorted(round(r["target"]) for r in found) == [3333, 6667]
    assert all(abs(r["taken"] - r["target"]) < 500 for r in found)
