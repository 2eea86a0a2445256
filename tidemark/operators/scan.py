"""Reads over resolved rows: points, ranges in either direction, neighbours, counts, splits.

Rows here have a ``sort_key`` column.  Predicates on keys may be applied before resolution
(they select whole histories); predicates on values only after it.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LT, LE, GT, GE = "<", "<=", ">", ">="
#: Most ranges that keys are dealt into for ranks and nearest keys, rows that one of them should hold, and
#: sampled keys a range.  What is known of each range is joined by broadcast: at most so many rows.
RANGES, SHARE, SAMPLED = 1024, 50_000, 20


@dataclass(frozen=True)
class Bounds:
    """A key range; None is no bound.  ``low_cmp`` is > or >=, ``high_cmp`` < or <=."""

    low: Any = None
    high: Any = None
    low_cmp: str = GE
    high_cmp: str = LT

    def __post_init__(self):
        if self.low_cmp not in (GT, GE) or self.high_cmp not in (LT, LE):
            raise ValueError("a lower bound takes > or >=, an upper bound < or <=")

    def empty(self) -> bool:
        """Whether no key can lie within."""
        if self.low is None or self.high is None:
            return False
        return self.low > self.high or self.low == self.high and (self.low_cmp == GT or self.high_cmp == LT)

    def where(self, key: Column) -> Column:
        out = F.lit(True)
        if self.low is not None:
            out = out & compare(key, self.low_cmp, self.low)
        if self.high is not None:
            out = out & compare(key, self.high_cmp, self.high)
        return F.lit(False) if self.empty() else out


def literal(value: Any) -> Column:
    """A key value as a column; tuples are composite keys."""
    if isinstance(value, tuple | list):
        return F.struct(*[F.lit(v).alias(f"_{i}") for i, v in enumerate(value)])
    return F.lit(value)


def compare(key: Column, cmp: str, value: Any) -> Column:
    value = literal(value)
    return {LT: key < value, LE: key <= value, GT: key > value, GE: key >= value}[cmp]


def scan(
    rows: DataFrame, bounds: Bounds = Bounds(), start_cmp: str = GE, start: Any = None, limit: int | None = None, key: str = "sort_key"
) -> DataFrame:
    """Rows within ``bounds`` from the start position on, in the direction ``start_cmp`` gives.

    > and >= go up from the first row that satisfies the comparison, < and <= go down from
    the last one.  With a limit the plan is a distributed top-k.
    """
    found = rows.where(bounds.where(F.col(key)))
    if start is not None:
        found = found.where(compare(F.col(key), start_cmp, start))
    found = found.orderBy(F.col(key).asc() if start_cmp in (GT, GE) else F.col(key).desc())
    return found if limit is None else found.limit(limit)


def lookup(rows: DataFrame, value: Any, key: str = "sort_key") -> DataFrame:
    """The row of one key, or none."""
    return rows.where(F.col(key) == literal(value))


def multi_get(rows: DataFrame, probes: DataFrame, key: str = "sort_key", probe: str = "probe") -> DataFrame:
    """Every probe with ``found`` and its row; Spark broadcasts a side only if it is small."""
    there = rows.withColumn("__there", F.lit(True))
    return probes.join(there, probes[probe] == there[key], "left").withColumn("found", F.coalesce("__there", F.lit(False))).drop("__there")


def exists(rows: DataFrame, probes: DataFrame, key: str = "sort_key", probe: str = "probe") -> DataFrame:
    """Every probe with ``found``; values are never read."""
    keys = rows.select(F.col(key).alias("__key")).distinct().withColumn("__there", F.lit(True))
    return probes.join(keys, probes[probe] == keys["__key"], "left").select(*probes.columns, F.coalesce("__there", F.lit(False)).alias("found"))


def typed(value: Any, kind: T.DataType) -> Column:
    """A collected value as a literal of its own type, structs included."""
    if isinstance(kind, T.StructType) and value is not None:
        return F.struct(*[typed(value[i], f.dataType).alias(f.name) for i, f in enumerate(kind.fields)])
    return F.lit(value).cast(kind)


class Ranges:
    """Ranges of about equal numbers of rows, between quantiles of a sample of the keys.

    Works for every type that Spark can order.  Rows with a null key are a range of their own,
    below all others.  A key that fills several ranges is spread over them.
    """

    def __init__(self, rows: DataFrame, key: str, n: int | None = None):
        self.key, self.kind = key, rows.schema[key].dataType
        keys = rows.select(key).where(F.col(key).isNotNull())
        total = keys.count() if n is None or n > 1 else 0
        self.n = max(1, min(RANGES, -(-total // SHARE))) if n is None else n
        cuts: list = []
        if self.n > 1 and total:
            rate = min(1.0, 2 * SAMPLED * self.n / total)
            # no more than a small multiple of SAMPLED * RANGES keys
            drawn = (keys if rate == 1.0 else keys.sample(rate, seed=7)).orderBy(key).collect()
            cuts = [drawn[len(drawn) * i // self.n][0] for i in range(1, self.n)] if drawn else []
        self.cuts: list = []
        self.times: list[int] = []
        for c in cuts:
            if self.cuts and self.cuts[-1] == c:
                self.times[-1] += 1
            else:
                self.cuts.append(c)
                self.times.append(1)

    def of(self, key: Column, spread: Column | None = None, top: bool = False) -> Column:
        """The number of a key's range.  Where a key fills several, ``spread`` (a hash) picks one,
        else it is the first of them, or the last with ``top``."""
        if not self.cuts:
            return F.when(key.isNull(), -1).otherwise(0)
        cuts = F.array(*[typed(c, self.kind) for c in self.cuts])
        # how many cuts lie below the key, by halving: each step looks at one cut
        steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(self.cuts).bit_length()))])
        below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) < key, at + step).otherwise(at))
        below = F.coalesce(below, F.lit(0))  # never null, which a join's filter needn't find out by searching again
        if max(self.times) == 1:
            return F.when(key.isNull(), -1).otherwise(below)
        starts = [sum(self.times[:i]) for i in range(len(self.times) + 1)]
        first = F.get(F.array(*[F.lit(x) for x in starts]), below)
        times = F.when(F.get(cuts, below) == key, F.get(F.array(*[F.lit(x) for x in self.times]), below)).otherwise(1)
        more = F.pmod(spread, times).cast("int") if spread is not None else times - 1 if top else F.lit(0)
        return F.when(key.isNull(), -1).otherwise(first + more)


def _row_hash(rows: DataFrame) -> Column:
    """A hash that tells rows of one key apart as far as their columns do; the same however often they are read."""
    return F.xxhash64(*[c for c, t in rows.dtypes if "map<" not in t and "variant" not in t])


def positions(rows: DataFrame, key: str = "sort_key", descending: bool = False, name: str = "pos", ranges: int | None = None) -> DataFrame:
    """``rows`` with their 1-based place in key order, without one task that sorts everything.

    Places within a range of keys come from a window over that range; how many rows lie
    below it comes from the ranges' counts, of which there are at most ``RANGES`` + 1.  Rows of
    one key have places next to each other, in any order; null keys come before all others
    (after them when descending).
    """
    dealt = Ranges(rows, key, ranges)
    rows = rows.withColumn("__range", dealt.of(F.col(key), _row_hash(rows)))
    counts = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    rise = F.col("__range").desc() if descending else F.col("__range").asc()
    before = F.coalesce(F.sum("__n").over(Window.orderBy(rise).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = counts.select("__range", before.alias("__before"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(F.col(key).desc() if descending else F.col(key).asc()))
    placed = rows.withColumn("__in", within).join(F.broadcast(before), "__range")
    return placed.withColumn(name, F.col("__before") + F.col("__in")).drop("__range", "__in", "__before")


def neighbours(rows: DataFrame, key: str = "sort_key", ranges: int | None = None) -> DataFrame:
    """``rows`` with ``prev_key`` and ``next_key``, the keys a cursor would step to.

    Ranges of keys are windowed one by one; at their edges the nearest other range's
    smallest or largest key is taken.  A row without a key has no neighbours and is none.
    """
    dealt = Ranges(rows, key, ranges)
    rows = rows.withColumn("__range", dealt.of(F.col(key), _row_hash(rows)))
    # by the key itself: asked for their range, rows would be dealt again by each filter
    there = rows.where(F.col(key).isNotNull())
    ends = there.groupBy("__range").agg(F.min(key).alias("__min"), F.max(key).alias("__max"))
    beside = Window.orderBy("__range")
    ends = ends.select("__range", F.lag("__max").over(beside).alias("__below"), F.lead("__min").over(beside).alias("__above"))
    order = Window.partitionBy("__range").orderBy(key)
    # broadcast: at most RANGES rows
    found = there.withColumns({"__p": F.lag(key).over(order), "__n": F.lead(key).over(order)}).join(F.broadcast(ends), "__range")
    found = found.withColumns({"prev_key": F.coalesce("__p", "__below"), "next_key": F.coalesce("__n", "__above")})
    none = F.lit(None).cast(dealt.kind)
    absent = rows.where(F.col(key).isNull()).withColumns({"prev_key": none, "next_key": none})
    return found.drop("__p", "__n", "__below", "__above").unionByName(absent).drop("__range")


def seek_nearest(rows: DataFrame, probes: DataFrame, cmp: str = LE, key: str = "sort_key", probe: str = "probe", ranges: int | None = None) -> DataFrame:
    """Every probe with ``nearest``, the closest key that satisfies ``key cmp probe``; null for a null probe.

    Keys and probes are merged in order within ranges of keys; a probe that finds nothing in
    its range takes the nearest range's extreme key.  Keys are made unique first, and a probe
    asked very often is spread over several ranges.
    """
    kind = rows.schema[key].dataType
    down = cmp in (LT, LE)
    keys = rows.select(F.col(key).alias("__x")).where(F.col(key).isNotNull()).distinct().withColumns({"__key": F.col("__x"), "__ask": F.lit(False)})
    asks = probes.select(F.col(probe).cast(kind).alias("__x"), F.lit(None).cast(kind).alias("__key"), F.lit(True).alias("__ask"), F.col(probe))
    both = keys.withColumn(probe, F.lit(None).cast(probes.schema[probe].dataType)).unionByName(asks)
    dealt = Ranges(both.select("__x"), "__x", ranges)
    # a key stands before the probes that equal it, in the direction of the search, if it counts for them
    top = (not down) if cmp in (LE, GE) else down
    chosen = F.when(F.col("__ask"), dealt.of(F.col("__x"), F.monotonically_increasing_id())).otherwise(dealt.of(F.col("__x"), top=top))
    both = both.withColumn("__range", chosen)
    keys = keys.withColumn("__range", dealt.of(F.col("__x"), top=top))
    ends = keys.groupBy("__range").agg((F.max if down else F.min)("__key").alias("__end"))
    # every range, also those without keys, so that each finds the nearest other one's end
    ends = both.sparkSession.range(-1, RANGES + 1).select(F.col("id").cast("int").alias("__range")).join(F.broadcast(ends), "__range", "left")
    rise = F.col("__range").asc() if down else F.col("__range").desc()
    beyond = F.last("__end", True).over(Window.orderBy(rise).rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("__range", beyond.alias("__beyond"))
    tie = F.col("__ask").asc() if cmp in (LE, GE) else F.col("__ask").desc()
    order = Window.partitionBy("__range").orderBy(F.col("__x").asc() if down else F.col("__x").desc(), tie)
    seen = F.last("__key", True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # broadcast: RANGES + 2 rows
    placed = both.withColumn("__seen", seen).where("__ask").join(F.broadcast(ends), "__range")
    return placed.select(probe, F.when(F.col(probe).isNotNull(), F.coalesce("__seen", "__beyond")).alias("nearest"))


def count_in_range(messages: DataFrame, bounds: Bounds, key_bytes: Column, value_bytes: Column, key: str = "sort_key") -> DataFrame:
    """Exact number of physical messages in a range, and the bytes of their keys and values."""
    found = messages.where(bounds.where(F.col(key)))
    return found.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(key_bytes), F.lit(0)).cast("long").alias("key_bytes"),
        F.coalesce(F.sum(value_bytes), F.lit(0)).cast("long").alias("value_bytes"),
    )


def history(messages: DataFrame, value: Any, key: str = "sort_key") -> DataFrame:
    """All messages of one key, newest first."""
    return messages.where(F.col(key) == literal(value)).orderBy(F.col("seq").desc())


def split_points(rows: DataFrame, n: int, key: str = "sort_key", accuracy: int = 10_000) -> DataFrame:
    """About ``n`` - 1 keys that cut the rows into ``n`` parts of equal size."""
    shares = [i / n for i in range(1, n)]
    cuts = rows.agg(F.percentile_approx(key, F.array(*[F.lit(s) for s in shares]), accuracy).alias("cuts"))
    return cuts.select(F.posexplode("cuts").alias("part", "split_key"))
