"""Merge rules: what an UPDATE does to the value below it.

Rules must be associative, as histories are combined piece by piece, in any grouping.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

INSERT, UPDATE, DELETE = "INSERT", "UPDATE", "DELETE"


def wrap_int8(x: Column) -> Column:
    """The value modulo 256, from -128 to 127."""
    return F.pmod(x + 128, F.lit(256)) - 128


@dataclass(frozen=True)
class MergeSpec:
    """How updates combine.

    ``total`` aggregates the updates of a key in one go, where their order doesn't matter;
    ``pair`` combines an older and a newer value.  ``zero_deletes``: an insert or a finished
    update whose value is 0 after merging is a deletion.  ``final`` turns the updates of a key
    with nothing below them into its value.  ``total`` must also combine its own results.
    ``printer`` shows a value to people.  Without ``pair``, updates are not allowed and the last
    write wins.
    """

    name: str
    pair: Callable[[Column, Column], Column] | None = None
    total: Callable[[Column], Column] | None = None
    shape: Callable[[Column], Column] = lambda c: c
    zero_deletes: bool = False
    final: Callable[[Column], Column] | None = None
    printer: Callable[[Column], Column] | None = None

    @staticmethod
    def last_write_wins() -> MergeSpec:
        return MergeSpec("last_write_wins")

    @staticmethod
    def sum() -> MergeSpec:
        return MergeSpec("sum", lambda old, new: old + new, F.sum)

    @staticmethod
    def counter_int8() -> MergeSpec:
        """A counter that wraps at eight bits and disappears at 0."""
        return MergeSpec("counter_int8", lambda old, new: wrap_int8(old + new), F.sum, wrap_int8, True)

    @staticmethod
    def maximum() -> MergeSpec:
        return MergeSpec("maximum", lambda old, new: F.greatest(old, new), F.max)

    @staticmethod
    def minimum() -> MergeSpec:
        return MergeSpec("minimum", lambda old, new: F.least(old, new), F.min)

    @staticmethod
    def append(separator: str = "") -> MergeSpec:
        """Strings, the newer after the older."""
        return MergeSpec(f"append({separator!r})", lambda old, new: F.concat(old, F.lit(separator), new))

    @staticmethod
    def custom(
        name: str, pair: Callable[[Column, Column], Column], zero_deletes: bool = False,
        final: Callable[[Column], Column] | None = None, printer: Callable[[Column], Column] | None = None,
    ) -> MergeSpec:
        """Any associative expression of an older and a newer value."""
        return MergeSpec(name, pair, None, lambda c: c, zero_deletes, final, printer)

    def alone(self, updates: Column) -> Column:
        """The value of updates with nothing below them."""
        value = self.shape(updates)
        return value if self.final is None else self.final(value)

    def to_string(self, value: str | Column = "value") -> Column:
        """A value for people: by the rule's printer, or as Spark casts it."""
        value = F.col(value) if isinstance(value, str) else value
        return value.cast("string") if self.printer is None else self.printer(value)

    def insert_or_delete(self, value: Column, merged: Column) -> Column:
        """The op of a value: DELETE if this rule makes a merged 0 disappear, else INSERT."""
        if not self.zero_deletes:
            return F.lit(INSERT)
        return F.when(merged & (value == 0), DELETE).otherwise(INSERT)
