"""Key orders.  A key's order also defines its identity: keys that sort equal are one key."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest key accepted by default, in bytes, as in a store with 4 KiB pages.
MAX_KEY_BYTES = 512


@dataclass(frozen=True)
class KeySpec:
    """Key columns and an order-preserving ``sort_key`` made of them.

    ``name`` identifies the order in a table's manifest, so that a table can't be opened
    with another one.  Everything groups, filters and sorts by ``sort_key``.
    """

    name: str
    columns: tuple[str, ...]
    order: Callable[..., Column]
    printer: Callable[..., Column] | None = None

    @staticmethod
    def lex(column: str) -> KeySpec:
        """The column's own order: bytewise for strings and binary, by value for numbers."""
        return KeySpec(f"lex({column})", (column,), lambda c: c)

    @staticmethod
    def composite(*columns: str) -> KeySpec:
        """By the first column, then the second, and so on."""
        return KeySpec(f"composite({','.join(columns)})", columns, lambda *cs: F.struct(*[c.alias(f"_{i}") for i, c in enumerate(cs)]))

    @staticmethod
    def ipv4(column: str) -> KeySpec:
        """Dotted quads by their numeric value."""

        def value(c: Column) -> Column:
            part = F.split(c, "\\.")
            terms = [part[i].cast("long") * (1 << 8 * (3 - i)) for i in range(4)]
            return terms[0] + terms[1] + terms[2] + terms[3]

        return KeySpec(f"ipv4({column})", (column,), value)

    @staticmethod
    def custom(name: str, columns: tuple[str, ...], order: Callable[..., Column], printer: Callable[..., Column] | None = None) -> KeySpec:
        """Any expression of the columns whose order is the keys' order."""
        return KeySpec(name, columns, order, printer)

    def to_string(self) -> Column:
        """A key for people: by the spec's printer, or its columns with commas between."""
        columns = [F.col(c) for c in self.columns]
        return F.concat_ws(",", *[c.cast("string") for c in columns]) if self.printer is None else self.printer(*columns)

    def sort_key(self) -> Column:
        return self.order(*[F.col(c) for c in self.columns])

    def sort_value(self, spark, *values):
        """The sort key of literal key values, computed by Spark itself."""
        row = spark.range(1).select(self.order(*[F.lit(v) for v in values]).alias("k")).first()
        return row["k"]

    def hash(self) -> Column:
        """A hash that agrees with the order: equal keys hash alike."""
        return F.xxhash64(self.sort_key())

    def with_sort_key(self, df: DataFrame) -> DataFrame:
        return df.withColumn("sort_key", self.sort_key())


def to_hex(column: str | Column) -> Column:
    """A key's or value's bytes in hexadecimal, for people."""
    return F.hex(F.col(column) if isinstance(column, str) else column)


def oversize(columns: tuple[str, ...], most: int = MAX_KEY_BYTES) -> Column:
    """Whether the key's string and binary columns hold more than ``most`` bytes together."""
    return sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(0)) > most
