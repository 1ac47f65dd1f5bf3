"""Field maps stored in columns of their own.

A result carries its fields as MAP<STRING,STRING>. Shredded, the map becomes a struct with one
column for each field of a spec, so a stored table lets a query on three fields read three
columns, and a value is found by its place instead of by a search through the map. Nothing is
lost: keys outside the spec, and keys whose value is null, stay in a map beside the columns.

Operators read either form through `Fields`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldeval.functions.base import is_in
from fieldeval.schema import FieldSpec

#: Parts of the struct besides the fields: other entries as a map, the number of all keys.
REST, COUNT = "__rest", "__count"


def shred(rows: DataFrame, spec: FieldSpec, fields: str = "extracted_fields") -> DataFrame:
    """Rows with the map replaced by a struct of the spec's fields; a null map stays null."""
    held = F.col(fields)
    rest = F.map_filter(held, lambda k, v: v.isNull() | ~is_in(k, spec.names))
    cells = [F.try_element_at(held, F.lit(n)).alias(n) for n in spec.names]
    struct = F.struct(*cells, rest.alias(REST), F.size(held).alias(COUNT))
    return rows.withColumn(fields, F.when(held.isNotNull(), struct))


def unshred(rows: DataFrame, fields: str = "extracted_fields") -> DataFrame:
    """Rows with the struct turned back into the map, in the order of the fields."""
    return rows.withColumn(fields, Fields(rows, fields).as_map())


class Fields:
    """The fields of a row, whichever form the column has."""

    def __init__(self, rows: DataFrame, column: str = "extracted_fields") -> None:
        self.column = column
        kind = rows.schema[column].dataType
        self.shredded = isinstance(kind, T.StructType)
        self.names = [n for n in kind.names if n not in (REST, COUNT)] if self.shredded else []

    def _part(self, name: str) -> Column:
        return F.col(f"`{self.column}`.`{name}`")

    def _entries(self) -> Column:
        """(key, value) of the fields that have a column, in order, absent ones with null."""
        return F.array(*(F.struct(F.lit(n).alias("key"), self._part(n).alias("value")) for n in self.names))

    def get(self, name: str) -> Column:
        """Value of a key or null."""
        if name in self.names:
            return self._part(name)
        return F.try_element_at(self._part(REST) if self.shredded else F.col(self.column), F.lit(name))

    def count(self) -> Column:
        """Number of keys; null where there is no map."""
        return self._part(COUNT) if self.shredded else F.size(self.column)

    def count_of(self, names: Iterable[str]) -> Column:
        """How many of the keys are there, with a value or without; null where there is no map."""
        wanted = list(names)
        if not self.shredded:
            return F.size(F.map_filter(self.column, lambda k, v: is_in(k, wanted)))
        own = [self._part(n).isNotNull().cast("int") for n in self.names if n in wanted]
        other = F.size(F.map_filter(self._part(REST), lambda k, v: is_in(k, wanted)))
        return sum(own, other)

    def searched_keys(self) -> Column:
        """Keys of fields without a column of their own."""
        return F.map_keys(self._part(REST) if self.shredded else F.col(self.column))

    def keys(self) -> Column:
        if not self.shredded:
            return F.map_keys(self.column)
        own = F.transform(F.filter(self._entries(), lambda e: e["value"].isNotNull()), lambda e: e["key"])
        return F.concat(own, self.searched_keys())

    def values(self) -> Column:
        if not self.shredded:
            return F.map_values(self.column)
        return F.concat(F.array_compact(F.array(*map(self._part, self.names))), F.map_values(self._part(REST)))

    def count_where(self, test: Callable[[Column], Column]) -> Column:
        """Number of values that hold ``test``, null where there is no map; columns are tested as they
        stand, not in a lambda."""
        if not self.shredded:
            return F.size(F.filter(self.values(), test))
        own = [F.coalesce(test(self._part(n)), F.lit(False)).cast("int") for n in self.names]
        return sum(own, F.size(F.filter(F.map_values(self._part(REST)), test)))

    def as_map(self) -> Column:
        if not self.shredded:
            return F.col(self.column)
        own = F.map_from_entries(F.filter(self._entries(), lambda e: e["value"].isNotNull()))
        return F.when(F.col(self.column).isNotNull(), F.map_concat(own, self._part(REST)))

    def only(self, names: Iterable[str]) -> Column:
        """The column, in its form, with these keys alone."""
        wanted = list(names)
        if not self.shredded:
            return F.map_filter(self.column, lambda k, v: is_in(k, wanted))
        cells = [self._part(n).alias(n) for n in self.names if n in wanted]
        rest = F.map_filter(self._part(REST), lambda k, v: is_in(k, wanted))
        struct = F.struct(*cells, rest.alias(REST), self.count_of(wanted).alias(COUNT))
        return F.when(F.col(self.column).isNotNull(), struct)


def save_by_document(
    rows: DataFrame, name: str, path: str, buckets: int, key: str = "doc_id", mode: str = "errorifexists"
) -> DataFrame:
    """Store rows as a table in buckets of their document, one file each, and return the table.

    Tables stored alike join on the document, and aggregate by it, without an exchange. Rows are
    dealt by the hash that buckets are made by, so a task writes the file of one bucket; choose
    buckets so that one holds about 128 MB.
    """
    dealt = rows.repartition(buckets, key).sortWithinPartitions(key)
    dealt.write.mode(mode).bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    return rows.sparkSession.table(name)
