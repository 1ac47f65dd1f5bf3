import json
import os

import pytest

from fieldeval.operators import fields, rates
from fieldeval.schema import DEFAULT_SPEC
from fieldeval.sources import readers as R
from fieldeval.sources import writers as W


def put(folder, name, body):
    path = os.path.join(folder, name)
    with open(path, "wb" if isinstance(body, bytes) else "w") as f:
        f.write(body)
    return path


def test_truth_csv(spark, folder):
    path = put(folder, "t.csv", "image_file,TOTAL,GST,ABN\na.png,46.680,$1.00,\nb.png,0.0,x,7\na.png,1e3,5d,N/A\n")
    rows = {r["doc_id"]: r["truth_fields"] for r in R.read_truth_csv(spark, path).collect()}
    assert rows == {
        "a.png": {"TOTAL": "1000", "GST": "5d", "ABN": "N/A"},
        "b.png": {"TOTAL": "0", "GST": "x", "ABN": "7"},
    }
    assert R.lookup_truth(spark, path, "b.png", "image_file").count() == 1
    assert R.truth_long(R.read_truth_csv(spark, path)).count() == 6


def test_truth_csv_last_file_wins(spark, folder):
    put(folder, "a.csv", "image_file,TOTAL\nx,1\n")
    put(folder, "b.csv", "image_file,TOTAL\n" + "".join(f"y{k},7\n" for k in range(500)) + "x,2\n")
    for multi_line in (True, False):
        rows = R.read_truth_csv(spark, folder, multi_line=multi_line)
        assert rows.where("doc_id = 'x'").first()["truth_fields"] == {"TOTAL": "2"}
    first = R.first_truth(R.lookup_truth(spark, folder, "x", "image_file", "row"), "image_file")
    assert first.first()["TOTAL"] == "1"


def test_truth_csv_keeps_numbers(spark, folder):
    path = put(folder, "n.csv", "image_file,TOTAL\na,1e31\nb,1e-9\nc,0.10\n")
    rows = {r["doc_id"]: r["truth_fields"]["TOTAL"] for r in R.read_truth_csv(spark, path).collect()}
    assert rows == {"a": "1.0E31", "b": "1.0E-9", "c": "0.1"}


def test_quoted_line_break(spark, folder):
    path = put(folder, "q.csv", 'image_filename,v\na,"x\ny"\nb,z\n')
    assert R.lookup_truth(spark, path).count() == 2


def test_first_truth(spark):
    rows = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x")], "image_filename string, row int, v string")
    assert R.first_truth(rows).select("v").first()[0] == "x"


def test_batch_layouts(spark, folder):
    item = {"filename": "/x/llama_1.png", "extracted_fields": {"TOTAL": "N/A", "GST": "2"}, "extraction_method": "clean"}
    one = put(folder, "list.json", json.dumps([item, "skip me"]))
    two = put(folder, "obj.json", json.dumps({"model": "beta", "results": [{"image_name": "b.png", "model": "m2"}]}))
    other = put(folder, "none.json", json.dumps({"other": 1}))
    rows = R.read_batch_results(spark, one)
    assert rows.count() == 1
    wide = fields.batch_to_wide(R.batch_image(rows), DEFAULT_SPEC).first()
    assert (wide["image"], wide["TOTAL"], wide["GST"], wide["ABN"]) == ("llama_1.png", None, "2", None)
    assert R.detect_model(spark, one).first()["model"] == "llama"
    assert R.detect_model(spark, two).first()["model"] == "m2"
    top = put(folder, "top.json", json.dumps({"model": "beta"}))
    assert R.detect_model(spark, top).first()["model"] == "beta"
    with pytest.raises(Exception, match="Invalid JSON"):
        R.read_batch_results(spark, put(folder, "empty.json", "")).count()
    empty = R.read_batch_results(spark, other)
    assert empty.count() == 0 and "extracted_fields" in empty.columns
    bad = put(folder, "bad.json", "{not json")
    with pytest.raises(Exception, match="Invalid JSON"):
        R.read_batch_results(spark, bad).count()


def test_comparison_files(spark, folder):
    put(folder, "comparison_results_1.json", json.dumps({"model_estimated_vram": {"a": 1.5}}))
    new = put(folder, "comparison_results_2.json", json.dumps({"x": 1}))
    os.utime(new, (2e9, 2e9))
    assert R.latest_run(spark, folder).first()["path"].endswith("comparison_results_2.json")
    got = R.read_comparison_results(spark, f"{folder}/comparison_results_1.json").collect()
    assert [tuple(r) for r in got] == [("a", 1.5)]
    text = put(folder, "comparison_results_3.json", json.dumps({"status": {"a": "ok", "b": {"n": 1}}}))
    got = R.read_comparison_results(spark, text, "status", numbers=False).collect()
    assert [tuple(r) for r in got] == [("a", "ok"), ("b", '{"n":1}')]
    assert R.read_comparison_results(spark, new).count() == 0


def test_images(spark, folder):
    put(folder, "a.PNG", bytes.fromhex("89504E470D0A1A0A") + b"x")
    put(folder, "b.jpg", b"not an image")
    put(folder, "d.webp", b"RIFF....AVI LIST")
    put(folder, "c.txt", b"text")
    files = R.discover_images(spark, folder, content=True)
    assert {r["name"] for r in files.collect()} == {"a.PNG", "b.jpg", "d.webp"}
    assert R.discover_images(spark, folder, max_images=1).first()["name"] == "a.PNG"
    checked = {r["name"]: r["verified"] for r in R.verify_images(files).collect()}
    assert checked == {"a.PNG": True, "b.jpg": False, "d.webp": False}
    s = rates.dataset_summary(R.verify_images(files)).first()
    assert (s["expected"], s["found"], s["missing"], s["found_rate"]) == (3, 1, 2, 1 / 3)


def test_only_heads_of_images_are_read(spark, folder):
    """Files far larger than memory, one of them too large for a binary column, and a lost one."""
    for name, size in (("a.png", 8 << 30), ("b.PNG", 1 << 40)):
        with open(os.path.join(folder, name), "wb") as f:
            f.write(bytes.fromhex("89504E470D0A1A0A"))
            f.truncate(size)
    put(folder, "c.jpg", b"no")
    put(folder, "d e.bmp", b"BM")
    put(folder, "lost.png", b"x")
    files = R.discover_images(spark, folder)
    listed = spark.createDataFrame(files.collect(), files.schema)
    os.remove(os.path.join(folder, "lost.png"))
    checked = {r["name"]: r["verified"] for r in R.verify_images(R.with_heads(listed)).collect()}
    assert checked == {"a.png": True, "b.PNG": True, "c.jpg": False, "d e.bmp": True, "lost.png": False}
    assert R.verify_images(R.with_heads(listed.where("false"))).count() == 0


def test_writers(spark, folder):
    rows = spark.createDataFrame(
        [("a", "m1", True, None, 2.0, {"TOTAL": "1"}), ("b", "m2", False, "boom", 1.0, {})],
        "doc_id string, model string, successful boolean, error string, processing_time double, extracted_fields map<string,string>",
    )
    W.write_batch_results(rows, f"{folder}/batch")
    assert W.read_totals(spark, f"{folder}/batch").count() == 2
    assert W.read_failures(spark, f"{folder}/batch").first()["error"] == "boom"
    W.write_comparison_results(rows, f"{folder}/cmp")
    assert spark.read.json(f"{folder}/cmp").where("model = 'm1'").count() == 1
    wide = fields.to_wide(rows, DEFAULT_SPEC, "doc_id")
    W.write_wide_csv(wide, f"{folder}/wide")
    assert spark.read.option("header", True).csv(f"{folder}/wide").columns == wide.columns
    for _ in range(2):
        W.append_truth(wide, rows.select("doc_id", "processing_time"), f"{folder}/truth")
    assert spark.read.option("header", True).csv(f"{folder}/truth/truth").count() == 4
    with pytest.raises(ValueError):
        W.csv_path(folder, "batch", None)
