"""Split reading of CSV and JSON against readers that take a file whole."""

import json
import os
import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from fieldeval.sources import readers as R
from fieldeval.sources import splits
from fieldeval.sources.splits import JsonFiles, csv_records, read_csv


@contextmanager
def splits_of(spark, size):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def put(folder, name, body):
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(body if isinstance(body, bytes) else body.encode())
    return path


def csv_text(seed, n=60, end="\n"):
    rnd = random.Random(seed)

    def cell():
        kind = rnd.random()
        if kind < 0.3:
            return "".join(rnd.choice("ab é7") for _ in range(rnd.randint(0, 6)))
        if kind < 0.4:
            return 'in"side' + rnd.choice(("", '"'))
        body = "".join(rnd.choice(("a", "b", ",", end, '""', " ", "é", "{")) for _ in range(rnd.randint(0, 14)))
        return f'"{body}"'

    rows = [f"k{k % 40},{cell()},{cell()}" for k in range(n)]
    rows.insert(7, "")
    rows.insert(9, "short")
    return end.join(["image_file,TOTAL,GST", *rows]) + (end if seed % 2 else "")


@pytest.mark.parametrize("seed", range(6))
def test_csv_as_the_whole_file_reader(spark, folder, seed):
    end = "\r\n" if seed == 5 else "\n"
    for k in range(2):
        put(folder, f"{k}.csv", csv_text(10 * k + seed, end=end))
    put(folder, "2.csv", "image_file,TOTAL,GST" + end)
    put(folder, "3.csv", "")
    whole = spark.read.options(header=True, escape='"', multiLine=True).csv(folder)
    want = sorted(map(tuple, whole.collect()), key=repr)
    for size in (23, 150, 1 << 20):
        with splits_of(spark, size):
            got = read_csv(spark, folder)
            assert got.columns[:-1] == whole.columns
            assert sorted((tuple(r)[:-1] for r in got.collect()), key=repr) == want


def test_csv_keeps_order_in_many_tasks(spark, folder):
    body = "image_file,TOTAL\n" + "".join(f'k{k % 50},"{k}\n,"""\n' for k in range(3000))
    path = put(folder, "t.csv", body)
    with splits_of(spark, 1000):
        assert read_csv(spark, path).rdd.getNumPartitions() > 1
        blocks = csv_records(spark, path).select("block").distinct().count()
        truth = {r["doc_id"]: r["truth_fields"] for r in R.read_truth_csv(spark, path, numeric_fields=()).collect()}
        first = R.first_truth(R.lookup_truth(spark, path, key_col="image_file", order_col="row"), "image_file", "row")
        firsts = {r["image_file"]: r["TOTAL"] for r in first.collect()}
    assert blocks > 20
    assert truth == {f"k{k % 50}": {"TOTAL": f'{k}\n,"'} for k in range(2950, 3000)}
    assert firsts == {f"k{k}": f'{k}\n,"' for k in range(50)}


def test_csv_record_over_many_splits(spark, folder):
    long = "\n".join(f"line {k}, {{" for k in range(400))
    path = put(folder, "t.csv", f'a,b\n1,"{long}"\n2,x\n3,"{long}"')
    with splits_of(spark, 100):
        got = sorted(tuple(r)[:2] for r in read_csv(spark, path).collect())
    assert got == [("1", long), ("2", "x"), ("3", long)]


def json_item(rnd):
    text = "".join(rnd.choice(("a", "é", "}", "{", "]", "[", '"', "\\", ",", "\n", ":", "results")) for _ in range(rnd.randint(0, 12)))
    fields = {rnd.choice("ABC"): text for _ in range(rnd.randint(0, 3))}
    return {
        "filename": text + ".png",
        "model": rnd.choice((None, "m1", "}{")),
        "extracted_fields": fields,
        "processing_time": rnd.random(),
        "extra": [{"results": [1, {"x": [text]}]}, text],
    }


def json_files(seed):
    rnd = random.Random(seed)
    items = [rnd.choice((json_item(rnd), json_item(rnd), "a{b", 5, None, [1, {"y": 2}], {})) for _ in range(rnd.randint(1, 25))]
    indent = rnd.choice((None, 1))
    failed = [{"image": "x}", "error": "results"}]
    yield json.dumps(items, indent=indent) + rnd.choice(("", "\n "))
    yield json.dumps({"failed_images": failed, "results": items, "model": "be}ta", "n": {"model": "no"}}, indent=indent, ensure_ascii=False)
    yield json.dumps({"model": "be\"ta\\", "results": [], "config": {"results": items, "model": "no"}}) + "\n"
    yield json.dumps({"other": items, "model": "top"})
    yield json.dumps(rnd.choice(([], {}, [5], {"results": {"a": {}}}, {"results": 7, "model": "m"})))


def expected(text):
    whole = json.loads(text)
    is_list = isinstance(whole, list)
    held = whole if is_list else whole.get("results")
    held = held if isinstance(held, list) else []
    model = None if is_list else whole.get("model")
    return is_list, model, [(k, x) for k, x in enumerate(held) if isinstance(x, dict)], len(held) > 0


@pytest.mark.parametrize("seed", range(5))
def test_json_as_read_whole(spark, folder, seed):
    texts = list(json_files(seed))
    for k, text in enumerate(texts):
        put(folder, f"{k}.json", text)
    for size in (31, 400, 1 << 20):
        with splits_of(spark, size):
            files = JsonFiles(spark, folder)
            got = {r["file"][-6]: r for r in files.files().collect()}
            found = {}
            for r in files.objects().collect():
                found.setdefault(r["file"][-6], []).append((r["pos"], json.loads(r["value"])))
        assert len(got) == len(texts)
        for k, text in enumerate(texts):
            is_list, model, items, any_items = expected(text)
            row = got[str(k)]
            assert (row["is_list"], row["file_model"]) == (is_list, model)
            assert is_list or row["has_items"] == any_items
            assert sorted(found.get(str(k), []), key=lambda x: x[0]) == items


def test_batches_from_files_as_from_texts(spark, folder):
    for k, text in enumerate(json_files(11)):
        put(folder, f"{k}.json", text)
    texts = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    parsed = R.parse_batches(texts)

    def rows(df):
        return sorted((str(r) for r in df.collect()))

    with splits_of(spark, 50):
        assert rows(R.read_batch_results(spark, folder)) == rows(R.batch_rows(parsed))
        assert rows(R.detect_model(spark, folder)) == rows(R.model_of(parsed))


def test_large_list_is_read_in_many_tasks(spark, folder):
    rnd = random.Random(1)
    items = [json_item(rnd) for _ in range(2000)]
    path = put(folder, "one_line.json", json.dumps({"results": items}))
    with splits_of(spark, 5000):
        files = JsonFiles(spark, path)
        assert files._segments.select("block").distinct().count() > 50
        got = sorted((r["pos"], json.loads(r["value"])) for r in files.objects().collect())
    assert [x for _, x in got] == items and [p for p, _ in got] == list(range(2000))


@pytest.mark.parametrize(
    "text", ["{not json", '[{"a": 1}', '[{"a": 1]', '{"results": [{"a": "x}]', "[{}] [{}]", '{"results": [{"a" 1}]}', "  ", "[}", '{"results": [{}]'],
)
def test_broken_json_is_an_error(spark, folder, text):
    path = put(folder, "bad.json", text)
    for size in (5, 1 << 20):
        with splits_of(spark, size), pytest.raises(Exception, match="Invalid JSON"):
            assert R.read_batch_results(spark, path).count() and R.detect_model(spark, path).count()


@pytest.mark.parametrize("size", [20, 1 << 20])
def test_map_of_a_comparison_file(spark, folder, size):
    values = {f"model }}{k}": {"n": [k, {"x": "}"}]} if k % 3 else "te]xt" for k in range(30)}
    whole = {"other": {"status": {"no": "no"}}, "status": values, "rows": [{"status": {"a": 1}}]}
    path = put(folder, "c.json", json.dumps(whole))
    with splits_of(spark, size):
        got = {r["model"]: r["value"] for r in R.read_comparison_results(spark, path, "status", numbers=False).collect()}
    assert {k: json.loads(v) if v[0] == "{" else v for k, v in got.items()} == values


def test_texts_are_tokenized_once_and_not_shuffled(spark, folder):
    """each use of the states read all texts again, and the joins with them shuffled texts."""
    put(folder, "a.json", json.dumps([{"filename": "a"}, {"filename": "b"}]))
    plan = R.read_batch_results(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "SortMergeJoin" not in plan


def test_segments_in_one_step_as_by_tokens():
    """What a segment does is the same with and without the step for each token, also where it is no JSON."""
    rnd = random.Random(5)
    bits = ['"model"', '"results"', '"a[{,"', '"x y"', ":", ",", "{", "[", "]", " ", "1.5", "null", '"', '\\"', '"k":"v",', '"model":"m",', ',"results":{']
    stepped = 0
    for _ in range(20000):
        texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(9))).encode() for _ in range(3)]
        one, other = splits._Effect("results", False), splits._Effect("results", False)
        for k, text in enumerate(texts):
            if one.sound:
                parts = splits._parts(text)
                stepped += parts is not None and not one.in_string and b"{" in text and b'"' in text
                one.segment(k, text, parts)
            if other.sound:
                other.segment(k, text, None)
        assert one.result() == other.result(), texts
    assert stepped > 500
