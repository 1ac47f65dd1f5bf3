"""Text and parsing operators against hand cases and small brute-force restatements."""

import random
from collections import Counter

from pyspark.sql import functions as F

from fieldeval import schema as S
from fieldeval.functions import parse, text
from fieldeval.schema import DEFAULT_SPEC


def run(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["x"] for r in rows.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def random_texts(n, seed):
    rng = random.Random(seed)
    pool = ["the", "The,", "TOTAL:", "GST:", "N/A", "n/a", "foo", "Foo!", "bar", "a:b", ":", "x", "\n", "*", "5"]
    return [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def brute_cap(t):
    seen, out = Counter(), []
    if len(t.split()) < 3:
        return t
    for w in t.split():
        key = w.lower().strip(S.WORD_PUNCTUATION)
        seen[key] += 1
        if seen[key] <= 2 or key in S.FREE_WORDS:
            out.append(w)
    return " ".join(out)


def brute_tokens(t):
    ws = t.split()
    marks = [i for i, w in enumerate(ws) if w.endswith(":")]
    pairs = {}
    for a, b in zip(marks, marks[1:] + [len(ws)]):
        if a < len(ws) - 1:
            pairs[ws[a][:-1]] = " ".join(ws[a + 1 : b]) or "N/A"
    return pairs


def brute_rates(t):
    ws = t.split()
    if len(ws) < 3:
        return 0.0, 0.0
    words = Counter(w.lower().strip(S.WORD_PUNCTUATION) for w in ws)
    pairs = Counter(f"{a} {b}".lower() for a, b in zip(ws, ws[1:]))
    return (
        sum(n >= 3 for n in words.values()) / len(words),
        sum(n >= 2 for n in pairs.values()) / len(pairs),
    )


def test_random_texts_match_brute_force(spark):
    texts = random_texts(400, 7)
    assert run(spark, texts, text.cap_word_repeats) == [brute_cap(t) for t in texts]
    assert run(spark, texts, parse.parse_kv_tokens) == [brute_tokens(t) for t in texts]
    got = run(spark, texts, lambda c: F.struct(text.word_repetition(c), text.phrase_repetition(c)))
    assert [tuple(g) for g in got] == [brute_rates(t) for t in texts]


def test_cleaning_cases(spark):
    assert run(spark, ["", "  ", None], text.clean_response) == ["", "", ""]
    assert run(spark, ["a N/A n/a N/A b"], text.collapse_na_runs) == ["a N/Ab"]
    assert run(spark, ["N/A " * 50_000], text.collapse_na_runs) == [" N/A"]
    assert run(spark, ["x N/A N/A y"], text.collapse_na_runs) == ["x N/A N/A y"]
    assert run(spark, ["a\n\n a \nb"], text.drop_repeated_lines) == ["a\nb"]
    assert run(spark, ["a  b\tc"], text.squeeze_space) == ["a b c"]
    assert run(spark, ["abcdef"], lambda c: text.clip_text(c, 3)) == ["abc..."]
    assert run(spark, ["<|reserved_special_token_7|>x</s>"], text.strip_special_tokens) == ["7|>x"]
    assert run(spark, ["word " * 2000], lambda c: text.clean_response(c)) == ["word word"]


def test_preparation_and_lines(spark):
    assert run(spark, ["**A:** 1\n```\nB: 2"], text.strip_markdown) == ["A: 1"]
    assert run(spark, ["x **Answer:** A: 1 **Answer:** B: 2"], text.strip_markdown) == ["A: 1"]
    assert run(spark, ["a NOTE: b Note: c"], text.cut_at_marker) == ["a NOTE: b"]
    assert run(spark, ["keep " + "N/A " * 10 + "x"], text.cut_at_na_run) == ["keep"]
    assert run(spark, ["keep " + "N/A " * 9 + "x"], text.cut_at_na_run) == ["keep " + "N/A " * 9 + "x"]
    lines = "1. total: \"5\"\n# A: no\nNote: no\nout format: x\nBank Name: 'B'\nTOTAL: *6*\nX: 1\nG5T: 2\nÄB: z"
    assert run(spark, [lines], parse.parse_kv_lines) == [{"TOTAL": "6", "BANK_NAME": "B", "ÄB": "z"}]
    one = "TOTAL: 5 GST: 1 " + "SUPPLIER: " + "y" * 200
    assert run(spark, [one], parse.parse_kv_lines)[0]["GST"] == "1"
    assert run(spark, [one], lambda c: F.size(parse.split_single_line(c, DEFAULT_SPEC))) == [3]
    assert run(spark, ["A_B: 1\nC: 2\nD: 3\n1: 4"], parse.has_kv) == [True]
    assert run(spark, ["A: 1\nB:\n: c"], parse.count_kv_lines) == [1]


def test_methods_and_classes(spark):
    texts = ["A: 1\nB: 2", "**A:** 1", "A: x x x x", "plain words", "w w w w", "- item"]
    assert run(spark, texts, text.extraction_method) == [
        "clean_extraction",
        "markdown_fallback",
        "clean_with_repetition",
        "complex_parsing",
        "repetition_control",
        "markdown_fallback",
    ]
    kinds = run(spark, ["a Tax Invoice", "12.50 L of ULP", "plain invoice", "hello"], text.classify_document)
    assert [(k[0], k[2]) for k in kinds] == [
        ("tax_invoice", True),
        ("fuel_receipt", True),
        ("tax_invoice", False),
        ("unknown", False),
    ]
