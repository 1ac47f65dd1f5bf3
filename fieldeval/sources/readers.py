"""Readers. Each takes a session and a path and returns a DataFrame."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldeval import schema as S
from fieldeval.functions.base import is_in
from fieldeval.sources.splits import JsonFiles, read_csv

# Plain numbers only: no exponent-free nan or inf, no type suffixes.
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("image", T.StringType()),
        T.StructField("image_path", T.StringType()),
        T.StructField("image_name", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("extracted_fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("processing_time", T.DoubleType()),
        T.StructField("model_confidence", T.DoubleType()),
        T.StructField("extraction_method", T.StringType()),
        T.StructField("success", T.BooleanType()),
    ]
)


def _numeric_text(value: Column) -> Column:
    """A castable number without trailing zeros; any other text as it is. Numbers too large
    or too small for that form keep the double's own text, so none turns into zero."""
    exact = value.try_cast("double")
    number = exact.try_cast("decimal(38,8)")
    text = number.cast("string")
    plain = F.regexp_replace(text, r"\.?0+$", "")
    kept = F.nullif(F.when(F.contains(text, F.lit(".")), plain).otherwise(text), F.lit(""))
    whole = number.cast("double") == exact
    shown = F.when(whole, F.coalesce(kept, F.lit("0"))).otherwise(exact.cast("string"))
    return F.when(value.rlike(_NUMBER), shown).otherwise(value)


def _csv(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """CSV rows with ``__order``: file path, start of the split, row in it.

    Large files are split. With ``multi_line`` quoted line breaks are read, which takes one scan
    more to tell where quotes are open.
    """
    if multi_line:
        return read_csv(spark, path)
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    place = F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    )
    return rows.select("*", place.alias("__order"))


def truth_map(
    rows: DataFrame, key_col: str, order_col: str, numeric_fields: Iterable[str] = S.NUMERIC_TRUTH_FIELDS
) -> DataFrame:
    """(doc_id, truth_fields MAP) from rows of texts; of rows with one key the last wins."""
    numeric = set(numeric_fields)
    cells = []
    for n in rows.columns:
        if n not in (key_col, order_col):
            cells += [F.lit(n), _numeric_text(F.col(n)) if n in numeric else F.coalesce(n, F.lit(""))]
    fields = F.map_filter(F.create_map(*cells), lambda k, v: v.isNotNull())
    last = F.max_by("truth_fields", "__order")
    kept = rows.select(F.col(key_col).alias("doc_id"), F.col(order_col).alias("__order"), fields.alias("truth_fields"))
    return kept.groupBy("doc_id").agg(last.alias("truth_fields"))


def read_truth_csv(
    spark: SparkSession,
    path: str,
    key_col: str = "image_file",
    numeric_fields: Iterable[str] = S.NUMERIC_TRUTH_FIELDS,
    order_col: str | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Truth as (doc_id, truth_fields MAP), one row per key.

    Of rows with the same key the last wins: last by ``order_col`` if there is one, else by
    file path and position in the file.
    """
    rows = _csv(spark, path, multi_line)
    if order_col:
        rows = rows.drop("__order")
    return truth_map(rows, key_col, order_col or "__order", numeric_fields)


def truth_long(truth: DataFrame) -> DataFrame:
    return truth.select("doc_id", F.explode("truth_fields").alias("field", "value"))


def lookup_truth(
    spark: SparkSession,
    path: str,
    key: str | None = None,
    key_col: str = "image_filename",
    order_col: str | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """All truth rows, or the rows of one document (the filter reaches the CSV scan). Their
    place in the files is added as ``order_col``, by which ``first_truth`` takes the first."""
    rows = _csv(spark, path, multi_line)
    rows = rows.withColumnRenamed("__order", order_col) if order_col else rows.drop("__order")
    return rows if key is None else rows.where(F.col(key_col) == key)


def first_truth(rows: DataFrame, key_col: str = "image_filename", order_col: str = "row") -> DataFrame:
    """One row per key: the first by ``order_col``."""
    rest = [c for c in rows.columns if c != key_col]
    first = F.min_by(F.struct(*rest), F.col(order_col))
    return rows.groupBy(key_col).agg(first.alias("r")).select(key_col, "r.*")


def _json_files(spark: SparkSession, path: str, key: str = "results") -> JsonFiles:
    """JSON files under a path. Spark's readers pass over empty ones, which are no JSON: they
    are told by their number, so no list of paths is held here."""
    files = spark.read.format("binaryFile").load(path).select("path")
    listed = len(files._jdf.inputFiles())
    if listed != files.count():
        raise ValueError(f"Invalid JSON in {path}: {listed - files.count()} empty file(s)")
    return JsonFiles(spark, path, key)


def parse_batches(texts: DataFrame) -> DataFrame:
    """(file, file_model, is_list, items) from rows (file, value) of JSON texts.

    Items are the list itself, or ``results`` of an object; any other object has none. A text
    that is not JSON, an empty one included, is an error.
    """
    bad = F.raise_error(F.concat(F.lit("Invalid JSON in "), F.col("file")))
    value = F.from_json(
        F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "v STRING", {"mode": "PERMISSIVE"}
    )["v"]
    checked = texts.select("file", F.coalesce(value, bad).alias("value"))
    is_list = F.ltrim("value").startswith("[")
    items = F.when(is_list, F.col("value")).otherwise(F.get_json_object("value", "$.results"))
    return checked.select(
        "file",
        F.when(~is_list, F.get_json_object("value", "$.model")).alias("file_model"),
        is_list.alias("is_list"),
        F.coalesce(F.from_json(items, "array<string>"), F.array().cast("array<string>")).alias("items"),
    )


def _typed(items: DataFrame) -> DataFrame:
    """Items' texts (item) replaced by their columns."""
    return items.withColumn("r", F.from_json("item", RESULT_SCHEMA)).select("file", "file_model", "is_list", "pos", "r.*")


def batch_rows(parsed: DataFrame) -> DataFrame:
    """A row for each item of parsed batches that is an object."""
    rows = parsed.select("file", "file_model", "is_list", F.posexplode("items").alias("pos", "item"))
    return _typed(rows.where(F.ltrim("item").startswith("{")))


def read_batch_results(spark: SparkSession, path: str) -> DataFrame:
    """Result rows from JSON files holding a list, or an object with ``results``.

    Any other object gives no rows, items that are not objects are skipped, and a file that
    is not JSON, an empty one included, is an error. A large file is read in many tasks.
    """
    batches = _json_files(spark, path)
    items = batches.objects().withColumnRenamed("value", "item").join(batches.files(), "file")
    return _typed(items)


def batch_image(rows: DataFrame) -> DataFrame:
    """Unify the four name columns into ``filename``."""
    return rows.withColumn(
        "filename", F.coalesce("filename", "image", "image_name", "image_path")
    )


def model_of(parsed: DataFrame) -> DataFrame:
    """(file, model) of parsed batches: from the first item alone.

    A list may name the model in that item, its method or its file name; an object in that
    item or, where it has no items, at the top level.
    """
    first = F.get("items", F.lit(0))
    return _model_of(parsed.select("file", "file_model", "is_list", first.alias("item"), (F.size("items") > 0).alias("has_items")))


def _model_of(files: DataFrame) -> DataFrame:
    """The same of files with their first item's text."""

    def named(c: Column) -> Column:
        low = F.lower(c)
        return F.when(F.contains(low, F.lit("llama")), "llama").when(
            F.contains(low, F.lit("internvl")), "internvl"
        )

    item = files.withColumn("r", F.from_json("item", RESULT_SCHEMA))
    guess = F.when(
        F.col("is_list"), F.coalesce("r.model", named(F.col("r.extraction_method")), named(F.col("r.filename")))
    ).otherwise(F.when(F.col("has_items"), F.col("r.model")).otherwise(F.col("file_model")))
    return item.select("file", guess.alias("model"))


def detect_model(spark: SparkSession, path: str) -> DataFrame:
    """Model of each batch file, null where it is not named."""
    batches = _json_files(spark, path)
    first = batches.objects().where(F.col("pos") == 0).select("file", F.col("value").alias("item"))
    return _model_of(batches.files().join(first, "file", "left"))


def comparison_map(texts: DataFrame, part: str) -> DataFrame:
    """(model, value) rows of one per-model map in rows (value) of JSON texts, values as text
    (JSON where they are no scalars); none where the map is absent."""
    found = F.from_json(F.get_json_object("value", f"$.{part}"), "map<string,string>")
    return texts.select(F.explode(found).alias("model", "value"))


def read_comparison_results(
    spark: SparkSession, path: str, part: str = "model_estimated_vram", numbers: bool = True
) -> DataFrame:
    """(model, value) rows of one per-model map of comparison files, as numbers or as text."""
    objects = _json_files(spark, path, part).objects(items=False)
    found = objects.select(F.explode(F.from_json("value", "map<string,string>")).alias("model", "value"))
    return found.withColumn("value", F.col("value").try_cast("double")) if numbers else found


def latest_of(files: DataFrame) -> DataFrame:
    """Path of the most recently modified of rows (path, modificationTime), none for none."""
    newest = F.max_by("path", F.struct("modificationTime", "path"))
    return files.agg(newest.alias("path")).where(F.col("path").isNotNull())


def latest_run(spark: SparkSession, directory: str, pattern: str = "comparison_results_*.json") -> DataFrame:
    """Path of the most recently modified file; file contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
    return latest_of(files.select("path", "modificationTime"))


def images_of(files: DataFrame, extensions: Iterable[str] = S.IMAGE_EXTENSIONS) -> DataFrame:
    """Files (path, ...) with ``name`` and ``extension``, by extension in any case."""
    name = F.substring_index("path", "/", -1)
    ext = F.lower(F.substring_index(name, ".", -1))
    return files.select("*", name.alias("name"), ext.alias("extension")).where(
        F.contains("name", F.lit(".")) & is_in(F.col("extension"), extensions)
    )


def discover_images(
    spark: SparkSession,
    directory: str,
    extensions: Iterable[str] = S.IMAGE_EXTENSIONS,
    max_images: int | None = None,
    content: bool = False,
) -> DataFrame:
    """Files of a directory (not below it) by extension in any case, optionally the first few
    by path."""
    files = spark.read.format("binaryFile").load(directory)
    held = ("path", "length", "modificationTime") + (("content",) if content else ())
    found = images_of(files.select(*held), extensions)
    return found if max_images is None else found.orderBy("path").limit(max_images)


# Leading bytes of the supported image formats, in hexadecimal.
_SIGNATURES = {
    "png": "89504E470D0A1A0A",
    "jpg": "FFD8FF",
    "jpeg": "FFD8FF",
    "bmp": "424D",
}


#: Bytes at the start of a file that tell its format.
HEAD_BYTES = 12


def with_heads(files: DataFrame, length: int = HEAD_BYTES) -> DataFrame:
    """Files (path, ...) with ``head``: the first bytes of each, null where it can't be read.

    Tasks read that range of each file and no more, so size does not matter. It needs a store
    that Arrow opens by its address (local, HDFS, S3, GCS); for any other discover images with
    ``content``, which Spark reads whole.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [_head(path, length) for path in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.binary())], [*batch.schema.names, "head"])

    schema = T.StructType([*files.schema.fields, T.StructField("head", T.BinaryType())])
    return files.mapInArrow(rows, schema)


#: Scheme, authority and path; Spark does not escape what an address would.
_ADDRESS = re.compile(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/]*))?(.*)", re.S)


def _head(path: str, length: int) -> bytes | None:
    scheme, authority, place = _ADDRESS.match(path).groups()
    if scheme in (None, "file"):
        store, root = fs.LocalFileSystem(), ""
    else:
        store, root = fs.FileSystem.from_uri(f"{scheme}://{authority or ''}")
    try:
        with store.open_input_file(root.rstrip("/") + place) as file:
            return file.read_at(min(length, file.size()), 0)
    except OSError:
        return None


def verify_images(files: DataFrame) -> DataFrame:
    """Add ``verified``: whether the leading bytes, of ``head`` or else of ``content``, are those
    of the format."""
    first = F.col("head") if "head" in files.columns else F.substring("content", 1, HEAD_BYTES)
    head = F.hex(first)
    test = F.when(
        F.col("extension") == "tiff", head.startswith("49492A00") | head.startswith("4D4D002A")
    ).when(F.col("extension") == "webp", head.rlike("^52494646.{8}57454250"))
    for ext, magic in _SIGNATURES.items():
        test = test.when(F.col("extension") == ext, head.startswith(magic))
    return files.withColumn("verified", F.coalesce(test, F.lit(False))).drop("content", "head")
