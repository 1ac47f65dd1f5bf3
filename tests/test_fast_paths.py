"""Shorter ways through the hot steps of scoring give what the plain ways give."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from fieldeval.functions import parse, text
from fieldeval.functions.base import SPACE_CHARS, SPACE_RUN, strip, strip_value, words
from fieldeval.operators import accuracy, align, profile, rates
from fieldeval.operators.shredded import shred
from fieldeval.plans.derive import SPEC, Inputs
from fieldeval.schema import COMMON_WORDS, FREE_WORDS, WORD_PUNCTUATION, FieldSpec

SMALL_DIR = "/root/testdata/sf0.001"


def test_strip_and_words_agree_with_the_plain_forms(spark):
    texts = [None, "", " ", "a", "é", "　a ", "a b", "a\nb  c\n", "\x0ba\x0b", "a b", "\x1fa", "a\x7f", " a", "a "]
    texts += [c + "x y" + c for c in SPACE_CHARS] + ["x" + c + "y" for c in SPACE_CHARS]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.filter(F.split("t", SPACE_RUN), lambda w: w != "")
    for fast, slow in ((strip_value(F.col("t")), strip(F.col("t"))), (words(F.col("t")), plain)):
        found = rows.select("t", fast.alias("f"), slow.alias("s")).collect()
        assert [r for r in found if r.f != r.s] == []


def test_documents_are_summed_up_in_their_rows(spark):
    """Equal documents of a model are still one row, and no field is unrolled on the way."""
    spec = FieldSpec.of(("SUPPLIER", "TOTAL", "PAYER_ADDRESS"))
    rows = [
        ("a", "m", {"SUPPLIER": " Shop ", "TOTAL": "n/a", "PAYER_ADDRESS": "1 High Street"}),
        ("a", "m", {"TOTAL": "."}),
        ("b", "m", {}),
        ("c", "m", None),
    ]
    truth = [("a", {"SUPPLIER": "shop", "TOTAL": "$2.00", "PAYER_ADDRESS": "1 High Street"}), ("b", {"SUPPLIER": " N/A "})]
    results = spark.createDataFrame(rows, "doc_id string, model string, extracted_fields map<string,string>")
    known = spark.createDataFrame(truth, "doc_id string, truth_fields map<string,string>")
    long = align.aligned_scores(results, known, spec)
    pairs = (
        (accuracy.evaluated_documents(results, known, spec), accuracy.document_evaluation(long)),
        (accuracy.truth_match_documents(results, known, spec), accuracy.truth_match_report(accuracy.match_fields(results, known, spec))),
    )
    for short, plain in pairs:
        assert short.schema.names == plain.schema.names
        assert [f.dataType for f in short.schema] == [f.dataType for f in plain.schema]
        assert sorted(short.collect()) == sorted(plain.collect())
        assert "Generate" not in short._jdf.queryExecution().optimizedPlan().toString()


def test_inputs_with_a_column_for_each_field_are_the_shredded_maps(spark):
    i = Inputs(spark, SMALL_DIR)
    results, truth = i.shredded()
    for found, rows, fields in ((results, i.results(), "extracted_fields"), (truth, i.truth(), "truth_fields")):
        wanted = shred(rows, SPEC, fields).select(*found.columns)
        assert found.count() == wanted.count() > 0
        text = [F.to_json(F.struct(F.col(fields))).alias("fields"), *(c for c in found.columns if c != fields)]
        assert found.select(*text).exceptAll(wanted.select(*text)).count() == 0


def _optimized(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_unrolled_scores_are_not_filtered_by_themselves(spark):
    """A filter that the unrolled scores are not empty would work them out twice, and what Spark derives
    from it doubles with every field: planning a filter on field figures never ended."""
    rows = [("a", "m", {"TOTAL": "1"}), ("b", "m", None)]
    results = spark.createDataFrame(rows, "doc_id string, model string, extracted_fields map<string,string>")
    known = spark.createDataFrame([("a", {"TOTAL": "1.00"})], "doc_id string, truth_fields map<string,string>")
    long = align.aligned_scores(results, known, FieldSpec.of(("SUPPLIER", "TOTAL")))
    assert "Generate" in _optimized(long)
    assert "size(" not in _optimized(accuracy.field_accuracy(long).where(F.col("accuracy") < 0.9))
    assert long.count() == 4


def test_accuracy_by_type_joins_truth_once(spark):
    """Types come with the scored rows; results that failed count nowhere, a type without any has no row."""
    rows = [("a", "m", True, 1.0, {"T": "x"}), ("b", "m", True, 1.0, {}), ("c", "m", False, 1.0, {}), ("d", "m", True, 1.0, {"T": "z"})]
    types = "doc_id string, model string, successful boolean, processing_time double, extracted_fields map<string,string>"
    truth = [("a", {"T": "x"}), ("b", {"T": "x"}), ("c", {"T": "y"})]
    known = spark.createDataFrame(truth, "doc_id string, truth_fields map<string,string>")
    spec = FieldSpec.of(("T",))
    docs = accuracy.document_accuracy(spark.createDataFrame(rows, types), known, spec, type_field="T")
    found = accuracy.accuracy_by_type(docs)
    assert sorted(map(tuple, found.collect()), key=str) == [("m", "x", 2, 0.5), ("m", None, 1, 0.0)]
    assert _optimized(found).count("Join") == 1


def test_models_are_summed_up_without_their_fields(spark):
    """`run_models` has the model rows of `run_profile`, from maps and from columns, and unrolls no field."""
    spec = FieldSpec.of(("SUPPLIER", "TOTAL"))
    rows = [
        ("m", True, 1.0, {"SUPPLIER": " n/a ", "TOTAL": "2", "MORE": "x"}),
        ("m", None, None, {"TOTAL": "", "MORE": "N/A"}),
        ("m", False, 2.0, None),
        ("n", False, 3.0, None),
    ]
    kind = "model string, successful boolean, processing_time double, extracted_fields map<string,string>"
    maps = spark.createDataFrame(rows, kind)
    wanted = profile.model_profile(profile.run_profile(maps, spec)).collect()
    for results in (maps, shred(maps, spec)):
        run = profile.run_models(results)
        assert "Generate" not in _optimized(run)
        assert sorted(profile.model_profile(run).collect()) == sorted(wanted)
    assert {r.model: r.non_na_fields for r in wanted} == {"m": 1.0, "n": None}


def _method(t):
    """Label of a response, line by line and word by word."""
    ls = [x.strip(SPACE_CHARS) for x in t.split("\n")]
    total, pairs = sum(x != "" for x in ls), sum(":" in x and x[0] not in "#*" for x in ls)
    ws = [w for w in re.split(f"[{re.escape(SPACE_CHARS)}]+", t.lower()) if w]
    repeated = any(n > 3 and w not in COMMON_WORDS for w, n in Counter(ws).items())
    markdown = any(x[:1] in tuple("#*-|") or "**" in x or (re.search("_[^_]*_", x) and ":" not in x) for x in ls)
    if total and pairs / total > 0.8:
        return "clean_with_markdown" if markdown else "clean_with_repetition" if repeated else "clean_extraction"
    return "repetition_control" if repeated else "markdown_fallback" if markdown else "complex_parsing"


def test_methods_by_patterns_are_those_of_lines_and_words(spark):
    rng = random.Random(7)
    bits = ["a:", "b", "N/A", "the", "**", "*", "#", "-", "|", "_x_", "_", ":", "\n", "\n", " ", "\t", "\x1f", "\x85", " "]
    bits += ["\r", "é", "A", "K: v\n", "zz: 3\n", "q: 4\n", "w: 5\n", "of", "a."]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["", "\n", " ", "x " * 50_000, "the " * 50_000, "a: " + "\n\n" * 20_000, "_" * 50_000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.extraction_method("t").alias("m"))
    assert [(r.t[:80], r.m, _method(r.t)) for r in rows.collect() if r.m != _method(r.t)] == []


def test_methods_are_counted_in_one_scan(spark, folder):
    rows = [("x", True), ("x", False), ("y", True), ("x", None)]
    spark.createDataFrame(rows, "extraction_method string, successful boolean").write.parquet(f"{folder}/labelled")
    found = rates.method_distribution(spark.read.parquet(f"{folder}/labelled"))
    assert sorted(map(tuple, found.collect())) == [("x", 3, 1 / 3, 0.75), ("y", 1, 1.0, 0.25)]
    assert _optimized(found).count("Relation [") == 1


def _capped(t, cap, free):
    ws = [w for w in re.split(f"[{re.escape(SPACE_CHARS)}]+", t) if w]
    seen, kept = Counter(), []
    for w in ws:
        key = w.lower().strip(WORD_PUNCTUATION)
        seen[key] += 1
        if seen[key] <= cap or key in free:
            kept.append(w)
    return t if len(ws) < 3 else " ".join(kept)


def test_words_are_capped_alike_by_places_and_by_sorting(spark):
    rng = random.Random(8)
    bits = ["a", "A.", "b:", "::", "c,d", "...", "the", "é", "N/A", "É!", "x\ty", "!a!!b!"] + [f"w{i}" for i in range(9)]
    texts = [" ".join(rng.choice(bits[: rng.randint(1, 21)]) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    many = [f"v{i}" for i in range(text._FEW + 1)]
    texts += ["", " . ", "a a", " ".join(many * 4), " ".join(many[1:] * 4), "x " * 100_000, "a" + "!" * 50_000 + "b c d"]
    texts += [" ".join(f"u{i % 30_000}" for i in range(120_000))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for cap, free in ((2, FREE_WORDS), (1, ()), (3, ("", "a"))):
        found = rows.select("t", text.cap_word_repeats("t", cap, free).alias("c")).collect()
        assert [(r.t[:80], r.c[:80]) for r in found if r.c != _capped(r.t, cap, free)] == []


def test_plain_texts_are_parsed_as_all_texts(spark):
    """An asterisk at the end, which no value keeps, sends a text the long way."""
    rng = random.Random(9)
    bits = ["TOTAL: 5", "GST: n/a", "1. ABN: 7", "PAYER_NAME: x y", "NOTE: q", " Note: q", "# A: b", "A B: 4", "AB:", "b", "é_b: 2", "12: 4"]
    texts = [rng.choice(["\n", " "]).join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts = [t for t in texts if not 190 < len(t) < 210]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    short, long = (F.to_json(parse.parse_kv_lines(c)) for c in (F.col("t"), F.concat("t", F.lit(" *"))))
    assert [tuple(r) for r in rows.select("t", short.alias("s"), long.alias("l")).where("s <> l").collect()] == []
    quoted = spark.createDataFrame([("TOTAL: '5'\n**GST:** 2\nexample: 3\nABN:\x1f7\x85\nBSB: 4",)], "t string")
    assert quoted.select(parse.parse_kv_lines("t")).first()[0] == {"TOTAL": "5", "GST": "2", "ABN": "7", "BSB": "4"}
