"""Column functions for counts, histograms and estimates."""

from __future__ import annotations

import bisect

from pyspark.sql import Column
from pyspark.sql import functions as F


def histogram_bucket(value: Column, limits: list[float]) -> Column:
    """Index of the first limit that is at least the value; ``len(limits)`` beyond the last."""
    out = F.lit(len(limits))
    for i in range(len(limits) - 1, -1, -1):
        out = F.when(value <= limits[i], i).otherwise(out)
    return out


def unique_from_collisions(distinct: Column, universe: int = 1 << 26) -> Column:
    """Estimated keys behind so many distinct hashes of a universe: the collector's sum, inverted."""
    u = F.lit(float(universe))
    return F.when(distinct >= universe, u * F.log(u)).otherwise(u * F.log(u / (u - distinct)))


def readable_size(n: int) -> str:
    """Bytes in the largest binary unit that leaves 1 or more."""
    units = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]
    i = max(0, min(bisect.bisect_right([1 << 10 * k for k in range(len(units))], n) - 1, len(units) - 1))
    return f"{n / (1 << 10 * i):.2f} {units[i]}"


def parse_size(text: str) -> int:
    """Bytes of a number with an optional unit: ``512``, ``4 KiB``, ``1.5g``."""
    number = text.strip().lower().removesuffix("b").removesuffix("i")
    scale = "kmgtp".find(number[-1:]) + 1 if number[-1:] else 0
    value = float(number[:-1] if scale else number) * (1 << 10 * scale)
    if value < 0 or value != int(value):
        raise ValueError(f"not a size: {text!r}")
    return int(value)
