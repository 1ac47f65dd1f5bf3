"""Mixing sources to target weights by repeating documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldeval.llm.common import set_aside, written

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix"
#: A source is never repeated more often than this.
MOST = 3
#: Up to so many sources the table of rates is broadcast; beyond it is joined by shuffle.
BROADCAST_SOURCES = 20_000


def word_count() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def draw() -> Column:
    """A number from 0 to 1 that depends on doc_id and text alone, so that rows with one id, or
    with none, are still drawn apart."""
    doc_id, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text"))
    key = F.concat(F.lit(f"{SEED}:"), doc_id, F.lit(":"), text)
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / float(1 << 32)


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with their number in code point order, null last; no single task sorts them."""
    ordered = written(
        sources.withColumn("last", F.col("source").isNull()).orderBy("last", "source").withColumn("part", F.spark_partition_id()),
        "sources",
    )
    place = F.row_number().over(Window.partitionBy("part").orderBy("last", "source"))
    before = ordered.groupBy("part").count().collect()  # one row for each sorted range
    offset, run = {}, 0
    for row in sorted(before, key=lambda r: r["part"]):
        offset[row["part"]], run = run, run + row["count"]
    if not offset:
        return ordered.withColumn("number", F.lit(0).cast("long"))
    start = F.create_map(*[F.lit(v) for item in offset.items() for v in item])[F.col("part")]
    return ordered.withColumn("number", (start + place - 1).cast("long"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Weights 1, 2, 3 repeat over the sources in code point order, null last. Targets share
    the total by weight; a source above MOST times its size is held there and what it leaves
    is shared again by weight, until none is above. Every round is one small aggregate with
    whole numbers, so reruns give the same doubles.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = written(
        _ranked(totals).select("source", "source_size", (F.col("number") % 3 + 1).alias("weight")), "weights"
    )
    most = MOST * F.col("source_size")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        above = most <= F.lit(level) * F.col("weight")
        held, free = ranked.agg(F.sum(F.when(above, most)), F.sum(F.when(~above, F.col("weight")))).first()
        if not free:
            break
        found = (total - (held or 0)) / free
        if found <= level:
            break
        level = found
    return ranked.select(
        "source", "source_size", F.least(most.cast("double"), F.lit(level) * F.col("weight")).alias("target")
    )


def with_copies(docs: DataFrame) -> DataFrame:
    """docs with size, source_size, target and copies (columns of those names are replaced).

    size: words of the text, null 0. copies: floor(target / source_size) plus one where the
    document's draw is below the fraction. A source without words has rate 0. Every row is
    decided by its doc_id and text alone; repeated rows repeat, an empty table stays empty.
    """
    docs = docs.drop("size", "source_size", "target", "copies", "rate", "aim").withColumn("size", word_count())
    aims = written(targets(docs.select("source", "size")), "targets")
    if aims.count() <= BROADCAST_SOURCES:
        side = F.broadcast(aims.withColumnRenamed("source", "aim"))
    else:
        side = aims.withColumnRenamed("source", "aim")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = docs.join(side, docs.source.eqNullSafe(F.col("aim")), "left").drop("aim")
    copies = F.floor("rate") + (draw() < F.col("rate") - F.floor("rate")).cast("long")
    return joined.withColumn("rate", F.least(rate, F.lit(float(MOST)))).withColumn("copies", copies).drop("rate")


def shares(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row: taken is size times copies."""
    narrow = docs.select("doc_id", "text", "source")
    return with_copies(narrow).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The rows and columns of docs, each row as often as the mix takes it."""
    docs, back = set_aside(docs, "size", "source_size", "target", "copies", "rate", "aim", "copy")
    taken = with_copies(docs).where("copies > 0")
    repeated = taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(docs.columns).withColumnsRenamed(back)


#: DuckDB: rows of `shares`.
SHARES_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM totals
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY {MOST} * source_size / weight, weight, source NULLS LAST) AS place,
    sum({MOST} * source_size) OVER (ORDER BY {MOST} * source_size / weight, weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS held,
    sum(weight) OVER (ORDER BY {MOST} * source_size / weight DESC, weight DESC, source DESC NULLS FIRST ROWS UNBOUNDED PRECEDING) - weight AS free
  FROM weighed
), levels AS (
  SELECT 0 AS place, CAST(sum(source_size) AS BIGINT) / CAST(sum(weight) AS BIGINT) AS level FROM weighed
  UNION ALL
  SELECT place, CAST((SELECT sum(source_size) FROM weighed) - held AS BIGINT) / CAST(free AS BIGINT) FROM ordered WHERE free > 0
), chosen AS (
  SELECT max(level) AS level FROM levels
), aims AS (
  SELECT source, source_size, least(CAST({MOST} * source_size AS DOUBLE), level * weight) AS target
  FROM weighed CROSS JOIN chosen
), rated AS (
  SELECT s.doc_id, s.size, a.source_size, a.target,
    CASE WHEN a.source_size > 0 THEN least(a.target / a.source_size, {MOST}.0) ELSE 0.0 END AS rate,
    CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(s.doc_id AS VARCHAR), '') || ':' || coalesce(s.text, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS draw
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source
)
SELECT doc_id, size, source_size, target,
  size * CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM rated
"""
