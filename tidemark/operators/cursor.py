"""A cursor over an ordered DataFrame that can step and turn, fetching pages by key."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidemark.operators.scan import GE, GT, LE, LT, Bounds, compare


class Cursor:
    """Stands on a row, before the first or after the last one.

    Forward starts (>, >=) take the first row within the bounds that satisfies the
    comparison, else stand after the last; backward starts (<, <=) the last such row, else
    before the first.  Each page is one top-k job; a page is kept in memory, nothing else.
    Works as a context manager; a cursor never blocks another.
    """

    def __init__(self, rows: DataFrame, bounds: Bounds = Bounds(), start_cmp: str = GE, start: Any = None, page: int = 256, key: str = "sort_key"):
        self._rows, self._key, self._page = rows.where(bounds.where(F.col(key))), key, page
        self._up = start_cmp in (GT, GE)
        self._buffer: list[Row] = []
        self._at = 0
        self._state = "on"
        where = None if start is None else compare(F.col(key), start_cmp, start)
        self._fill(where, self._up)
        if not self._buffer:
            self._state = "after" if self._up else "before"

    def _fill(self, where, up: bool) -> bool:
        """Fetch the page in the given direction; False if there is nothing."""
        found = self._rows if where is None else self._rows.where(where)
        order = F.col(self._key).asc() if up else F.col(self._key).desc()
        page = found.orderBy(order).limit(self._page).collect()
        if not page:
            return False
        self._buffer = page if up else page[::-1]
        self._at = 0 if up else len(page) - 1
        return True

    def valid(self) -> bool:
        """Whether the cursor stands on a row."""
        return self._state == "on"

    def can_next(self) -> bool:
        """Whether ``next`` is allowed: on a row, or before the first with rows to come."""
        return self._state != "after" and (self.valid() or self._any())

    def can_prev(self) -> bool:
        return self._state != "before" and (self.valid() or self._any())

    def _any(self) -> bool:
        return bool(self._buffer) or not self._rows.isEmpty()

    def current(self) -> Row:
        if not self.valid():
            raise ValueError("the cursor stands on no row")
        return self._buffer[self._at]

    def next(self) -> None:
        if self._state == "after":
            raise ValueError("nothing follows")
        if self._state == "before":
            self._state = "on" if self._fill(None, True) else "after"
        elif self._at + 1 < len(self._buffer):
            self._at += 1
        elif not self._fill(F.col(self._key) > self.current()[self._key], True):
            self._state = "after"

    def prev(self) -> None:
        if self._state == "before":
            raise ValueError("nothing precedes")
        if self._state == "after":
            self._state = "on" if self._fill(None, False) else "before"
        elif self._at:
            self._at -= 1
        elif not self._fill(F.col(self._key) < self.current()[self._key], False):
            self._state = "before"

    def status(self) -> None:
        """None: the end of a range is no error, and a failed job raises where it fails."""

    def __enter__(self) -> Cursor:
        return self

    def __exit__(self, *_: object) -> None:
        self._buffer = []


__all__ = ["GE", "GT", "LE", "LT", "Bounds", "Cursor"]
