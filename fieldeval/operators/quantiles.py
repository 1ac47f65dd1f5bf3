"""Exact quantiles of numbers with few decimal places, by histograms that get finer.

Values are counted as whole units of the last place. A first histogram of wide bins tells in
which bin each wanted rank lies; a second one, of the values in those bins alone, tells the
value. Windows see one row a bin, so a group's values, however many and however different, are
never gathered or sorted in one task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units in one bin of the first histogram, which is also the most values of a second one.
BIN = 10_000


def counted_values(rows: DataFrame, by: str, value: str, places: int = 8) -> DataFrame:
    """(g, u, n): how often each value, in units of the last place, occurs in each group; nulls
    do not count."""
    units = F.round(F.col(value) * 10**places).cast("long")
    known = rows.where(F.col(value).isNotNull())
    return known.groupBy(F.col(by).alias("g"), units.alias("u")).agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(
    counted: DataFrame, by: str, shares: Iterable[float], places: int = 8, width: int = BIN
) -> DataFrame:
    """(by, share, quantile) from `counted_values`: between the two nearest ranks values are
    interpolated. A group of nulls has no row; the group's column must not be null.
    """
    unit = 10**places
    bins = counted.groupBy("g", F.expr(f"floor(u / {width})").alias("bin")).agg(F.sum("n").alias("n"))
    placed = _with_ranks(bins, Window.partitionBy("g"), "bin").withColumn("total", F.sum("n").over(Window.partitionBy("g")))
    wanted = placed.select("*", F.explode(F.array(*map(F.lit, shares))).alias("share"))
    at = (F.col("total") - 1) * F.col("share")
    ranks = wanted.select("*", F.inline(F.array(*(F.struct(f(at).cast("long").alias("rank"), F.lit(k).alias("side")) for k, f in enumerate((F.floor, F.ceil))))))
    holds = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))
    targets = ranks.where(holds).select("g", "bin", "share", "side", "rank", "total", F.col("before").alias("base"))
    # The bins that hold a rank, once each, with their values.
    inside = counted.withColumn("bin", F.expr(f"floor(u / {width})")).join(targets.select("g", "bin", "base").distinct(), ["g", "bin"])
    values = _with_ranks(inside, Window.partitionBy("g", "bin"), "u").withColumn("before", F.col("before") + F.col("base"))
    found = values.drop("base").join(targets, ["g", "bin"]).where(holds)
    low, high = (F.max(F.when(F.col("side") == k, F.col("u"))) for k in (0, 1))
    share = (F.max("total") - 1) * F.col("share")
    part = share - F.floor(share)
    ends = found.groupBy("g", "share").agg(low.alias("low"), high.alias("high"), part.alias("part"))
    quantile = (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")) / unit
    return ends.select(F.col("g").alias(by), "share", quantile.alias("quantile"))


def _with_ranks(counts: DataFrame, group: Window, order: str) -> DataFrame:
    """Counts with `before`: how many come earlier in their group."""
    running = F.sum("n").over(group.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counts.withColumn("before", running - F.col("n"))


def as_columns(quantiles: DataFrame, by: str, names: dict[float, str]) -> DataFrame:
    """One row a group, one column a share."""
    cells: list[Column] = [F.max(F.when(F.col("share") == s, F.col("quantile"))).alias(n) for s, n in names.items()]
    return quantiles.groupBy(by).agg(*cells)
