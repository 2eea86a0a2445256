"""Bulk-synchronous best-fit packing of token sequences.

Pieces of documents and the gaps of open sequences are two tables of runs: so many pieces of
one length, so many sequences with one gap.  A round

1. opens as many new sequences as pieces longer than every gap need at least: by their number,
   as no sequence holds more than q of those longer than 1/(q + 1) of it, and by their volume;
2. deals both tables out by range of size and sorts each range;
3. sweeps every range in a task of its own: each gap run, the smallest first, takes the longest
   run of pieces that fits, as many side by side as fit, and goes on with what is left of it.
   Who goes where is settled by rank: the piece of rank r within its run goes to the r-th place;
4. writes placements, what is left of pieces, and the gaps at their new sizes.

Gaps that sink into another range meet its pieces in the next round.  Ranges are halved in
number every round, so that the last rounds see all sizes; the end comes when no piece is left.
A range holds about :data:`RUNS` runs, and there is one run of pieces a length, so the tables
follow the capacity and not the documents.

Rows are range-sorted once by length and key, which yields every rank with no group in one
task; rows and placements then meet by length and stretch of ranks.  Nothing but a few sums
reaches the driver.

Defined results: a null text is empty and has one token, the end mark.  Documents longer
than the capacity are cut; the first piece takes the remainder.  Repeated keys are packed as
separate pieces, told apart by their order.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bytebpe import load
from tidemark.llm.common import map_batches, materialize, ship


def pieces(df: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids_crc32): each document's tokens in pieces of at most ``capacity``."""
    kind = df.schema[key].dataType.simpleString()
    names = [key, "piece", "start", "length", "ids_crc32"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path)
        take, rows = [], []
        for i, x in enumerate(batch.column(1)):
            ids = np.append(bpe.encode(x.as_py() or ""), np.uint32(end_id)).astype("<u4")
            first = (len(ids) - 1) % capacity + 1
            bounds = [0, *range(first, len(ids) + 1, capacity)]
            for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                take.append(i)
                rows.append((k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
        columns = [batch.column(0).take(pa.array(take, pa.int64()))]
        columns += [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(df.select(key, text), run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


#: Runs that one range may hold, and ranks of a length that meet their placements in one task.
RUNS, STRETCH = 8192, 1 << 16

PIECES, GAPS, PLACED = 0, 1, 2
#: ``first`` is a run's first rank or sequence; placements put ``each`` pieces of length ``size`` from
#: ``rank`` on side by side at ``offset`` into each of ``count`` sequences.
RUN = "kind int, size long, first long, count long, rank long, offset long, each long"


def sweep(pieces: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], capacity: int) -> Iterator[tuple]:
    """Rows of :data:`RUN` after runs of gaps, each (size, first, count), took from runs of pieces."""
    left = {size: [first, count] for size, first, count in pieces}
    sizes = sorted(left)
    todo = sorted(gaps, reverse=True)
    while todo:
        gap, first, count = todo.pop()
        at = bisect.bisect_right(sizes, gap) - 1
        if at < 0:
            yield GAPS, gap, first, count, 0, 0, 0
            continue
        length = sizes[at]
        rank, n = left[length]
        each = min(gap // length, n)
        used = min(count, n // each)
        yield PLACED, length, first, used, rank, capacity - gap, each
        if n == used * each:
            del left[length], sizes[at]
        else:
            left[length] = [rank + used * each, n - used * each]
        # what is untouched waits below what goes on, so the sequence begun is finished first
        if count > used:
            todo.append((gap, first + used, count - used))
        if gap > each * length:
            todo.append((gap - each * length, first, used))
    for length, (rank, n) in left.items():
        yield PIECES, length, rank, n, 0, 0, 0


def rounds(runs: DataFrame, capacity: int, most: int = RUNS) -> tuple[list[DataFrame], int, int]:
    """Placements of all pieces of ``runs`` (length, n), the number of sequences, and of rounds."""
    zero = F.lit(0).cast("long")
    state = materialize(runs.select(
        F.lit(PIECES).alias("kind"), F.col("length").alias("size"), zero.alias("first"), F.col("n").alias("count"),
        zero.alias("rank"), zero.alias("offset"), zero.alias("each"),
    ))
    ship(runs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both: tuple[list, list] = ([], [])
        for batch in batches:
            for kind, *row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                both[kind].append(tuple(row))
        out = list(sweep(*both, capacity))
        kinds = [pa.int32(), *[pa.int64()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    names = state.columns
    placed, opened, turn, ranges = [], 0, 0, 0
    is_piece = F.col("kind") == PIECES
    while True:
        seen = state.agg(F.count_if(is_piece).alias("pieces"), F.max(F.when(~is_piece, F.col("size"))).alias("gap"), F.count(F.lit(1)).alias("runs")).first()
        if not seen["pieces"]:
            return placed, opened, turn
        stuck = state.where(is_piece & (F.col("size") > (seen["gap"] or 0))).groupBy(F.floor(F.lit(capacity) / F.col("size")).alias("q"))
        need = stuck.agg(F.sum("count").alias("n"), F.sum(F.col("size") * F.col("count")).alias("volume"))
        need = need.agg(F.min(F.struct("q", "n")).alias("largest"), F.sum("volume").alias("volume")).first()
        if need["largest"]:
            new = max(-(-need["largest"]["n"] // need["largest"]["q"]), -(-need["volume"] // capacity))
            more = runs.sparkSession.createDataFrame([(GAPS, capacity, opened, new, 0, 0, 0)], RUN)
            state, opened = state.unionByName(more), opened + new
        ranges = max(1, -(-seen["runs"] // most) if not turn else ranges // 2)
        dealt = state.repartitionByRange(ranges, "size") if ranges > 1 else state.coalesce(1)
        turn += 1
        after = materialize(dealt.mapInArrow(run, RUN))
        placed.append(after.where(F.col("kind") == PLACED))
        state = after.where(F.col("kind") != PLACED)


def ranks(parts: DataFrame, key: str) -> DataFrame:
    """``parts`` with ``__rank`` among the rows of the same length, in order of key and piece."""
    # dealing out by range reads its input twice, once for samples
    ordered = materialize(
        materialize(parts)
        .repartitionByRange(F.col("length"), F.col(key), F.col("piece"))
        .sortWithinPartitions("length", key, "piece")
        .withColumn("__at", F.monotonically_increasing_id())
    )
    part = F.shiftright("__at", 33).alias("__p")
    # one row for each partition and each border between lengths within it
    starts = ordered.groupBy(part, F.col("length").alias("__l")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__l").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select(F.col("__p").alias("__q"), "__l", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"))
    # broadcast: no more rows than partitions and lengths together
    met = ordered.withColumn("__p", part).join(F.broadcast(starts), (F.col("__p") == F.col("__q")) & (F.col("length") == F.col("__l")))
    return met.select(*parts.columns, (F.col("__at") + F.col("__shift")).alias("__rank"))


def pack(parts: DataFrame, capacity: int = 1024, key: str = "doc_id", most: int = RUNS, stretch: int = STRETCH) -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset``; sequences are full from 0 on without gaps.

    ``parts`` needs (key, piece, length) with lengths from 1 to ``capacity``; other columns stay.
    """
    columns = parts.columns
    ranked = materialize(ranks(parts, key))
    placed, _, _ = rounds(ranked.groupBy(F.col("length").cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n")), capacity, most)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields]
    if not placed:
        return ranked.select(*columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    plan = placed[0]
    for more in placed[1:]:
        plan = plan.unionByName(more)
    last = F.col("rank") + F.col("count") * F.col("each") - 1
    blocks = F.sequence(F.floor(F.col("rank") / stretch), F.floor(last / stretch))
    plan = plan.select(F.col("size").alias("__l"), F.explode(blocks).alias("__b"), "rank", "first", "offset", "each")
    rows = ranked.withColumns({"__l": F.col("length").cast("long"), "__b": F.floor(F.col("__rank") / stretch)})

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        rank = left.column("__rank").to_numpy()
        starts = right.column("rank").to_numpy()
        order = np.argsort(starts, kind="stable")
        row = order[np.searchsorted(starts[order], rank, side="right") - 1] if len(order) else np.zeros(0, dtype=int)
        first, offset, each = (right.column(c).to_numpy()[row] for c in ("first", "offset", "each"))
        turn = rank - starts[row]
        length = left.column("length").to_numpy()
        more = [pa.array(first + turn // each, pa.int64()), pa.array(offset + turn % each * length, pa.int64())]
        return pa.table([*(left.column(c) for c in columns), *more], names=[*columns, "sequence_id", "offset"])

    met = rows.groupBy("__l", "__b").cogroup(plan.groupBy("__l", "__b"))
    return met.applyInArrow(meet, ", ".join([*fields, "sequence_id long", "offset long"]))
