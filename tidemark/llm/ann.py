"""Approximate nearest neighbours by multiprobe p-stable hashing, Euclidean distance.

Index.  In each of ``tables`` tables a vector's bucket is the floor of ``depth`` random
projections over a width; the width is a multiple of the vectors' root mean square distance
from their mean, counted over all of them.  Identical vectors are one entry that carries
its smallest different ids, as many as an answer can need, each with the number of its rows.
Vectors travel as they are stored; distances are computed in double precision.

Search.  A query visits, in every table, its own bucket and then perturbed ones in order of
estimated success: a perturbation moves some projections to the neighbouring interval, and
its cost is the sum of squared distances to the boundaries crossed.  Rows and probes meet by
cell, a table and a part of its buckets; cells that hold more than ``cell`` rows on either
side are dealt out again over blocks of both, so a hot bucket never meets in one task.  In a
cell all candidates of a query are ranked at once by exact distance in double precision and
only its best go on; as distances are exact, merging these lists is merging all candidates.

Queries that found fewer than they asked for visit everything, in blocks, so a short answer
means that there are no more candidates.

Defined results: vectors that are null, zero, of another length than most, or hold nulls,
infinities or NaN take no part.  Ties go to the smaller id.  Rows that repeat an id are separate
candidates, each with a rank of its own, but no row is a neighbour of a query of the same id; of
several queries with one id and vector one is answered, and those with different vectors are
answered together.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, ship


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that take part."""
    v = F.col("v")
    held = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(held).alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: F.coalesce(bad(x), F.lit(True))))
    return rows.where(F.exists(v, lambda x: x != 0))


def directions(table: int, dim: int, depth: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """A table's projections and offsets, from its number alone."""
    rng = np.random.Generator(np.random.PCG64([17, table]))
    return rng.standard_normal((dim, depth)), rng.uniform(0, width, depth)


def keyed(slots: np.ndarray, table: int) -> np.ndarray:
    """A 64-bit name of each bucket, a row of slots."""
    h = np.full(len(slots), table + 1, dtype=np.uint64)
    for column in slots.T:
        h = (h ^ column.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def perturbations(low: np.ndarray, width: float, probes: int) -> list[list[tuple[int, int]]]:
    """The ``probes`` cheapest sets of moves, the empty one first.

    ``low`` has each projection's distance to its lower boundary.  Moves are sorted by cost;
    sets grow from a heap by shifting or adding their last move, so that they come in order.
    """
    depth = len(low)
    moves = sorted([(x * x, i, -1) for i, x in enumerate(low)] + [((width - x) ** 2, i, 1) for i, x in enumerate(low)])
    cost = [m[0] for m in moves]
    out: list[list[tuple[int, int]]] = [[]]
    heap: list[tuple[float, tuple[int, ...]]] = [(cost[0], (0,))] if depth else []
    while heap and len(out) < probes:
        total, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < len(moves):
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
        picked = [moves[c] for c in chosen]
        if len({m[1] for m in picked}) == len(picked):
            out.append([(m[1], m[2]) for m in picked])
    return out


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def nearest(
    query: np.ndarray, own: int, rows: np.ndarray, x: np.ndarray, ids: list[list[dict]], k: int
) -> list[tuple[int, float, int, int]]:
    """(id, distance, rows, entry) of the ``k`` nearest rows of ``x[rows]``, ties to smaller ids, without those of ``own``."""
    gap = x[rows] - query
    dist = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    if len(rows) > k + 1:
        # an entry has at least one id; one of the k + 1 nearest may hold only the query's own
        bound = np.partition(dist, k)[k]
        near = np.flatnonzero(dist <= bound)
    else:
        near = np.arange(len(rows))
    out, left = [], k
    for d, i, n, e in sorted((float(dist[j]), r["id"], r["n"], r["entry"]) for j in near for r in ids[rows[j]] if r["id"] != own):
        if left <= 0:
            break
        out.append((i, d, n, e))
        left -= n
    return out


def fitting_depth(x: np.ndarray, k: int, tables: int, width: float, probes: int, most: int, recall: float, asked: int = 40) -> int:
    """The largest depth, from ``most`` down to 3, at which ``asked`` of the vectors find the
    share ``recall`` of their ``k`` nearest among ``x``; neighbours in all the data are nearer,
    hence found more often."""
    if len(x) <= k:
        return most
    order = np.argsort(keyed(np.floor(x * 1e6), 0), kind="stable")[:asked]
    nearest_ = []
    for i in order:
        gap = ((x - x[i]) ** 2).sum(axis=1)
        gap[i] = np.inf
        nearest_.append(np.argpartition(gap, k)[:k])
    for depth in range(most, 3, -1):
        found = np.zeros((len(order), k), dtype=bool)
        for t in range(tables):
            a, b = directions(t, x.shape[1], depth, width)
            f = x @ a + b
            slots = np.floor(f / width)
            names = keyed(slots, t)
            for row, i in enumerate(order):
                sets = perturbations(f[i] - slots[i] * width, width, probes)
                near = np.tile(slots[i], (len(sets), 1))
                for n, moves in enumerate(sets):
                    for at, step in moves:
                        near[n, at] += step
                found[row] |= np.isin(names[nearest_[row]], keyed(near, t))
        if found.mean() >= recall:
            return depth
    return 3


def search(
    vectors: DataFrame,
    queries: Column,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    tables: int = 5,
    depth: int | None = None,
    width: float = 2.0,
    probes: int = 400,
    cell: int = 20_000,
    recall: float = 0.95,
    sample: int = 20_000,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of every row that ``queries`` (on ``id``) selects.

    ``depth`` defaults to the largest, up to three quarters of the binary logarithm of the
    number of vectors, that reaches ``recall`` on a sample (see :func:`fitting_depth`) of at
    most about ``sample`` vectors and two million components.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, key, vector)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], empty)
    dim, count = lengths[0]["d"], lengths[0]["n"]
    rows = rows.where(F.size("v") == dim)
    # identical vectors are one entry; rows are counted and a rank limit taken before rows meet, so hot vectors stay small
    by = F.row_number().over(_window("v", "id"))
    each = F.struct("id", F.least("n", F.lit(k).cast("long")).alias("n"), F.xxhash64("v").alias("entry"))
    entries = materialize(
        rows.groupBy("v", "id").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("r", by).where(F.col("r") <= k + 1)
        .groupBy("v").agg(F.array_sort(F.collect_list(each)).alias("ids"))
    )
    asked = rows.where(queries).select(F.col("id").alias("q"), F.col("v").alias("qv")).distinct()
    spread = rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.avg(F.col("x") * F.col("x")).alias("s"))
    var, size = spread.agg(F.sum(F.col("s") - F.col("m") * F.col("m")), F.sum("s")).first()
    scale = math.sqrt(var if var > 1e-24 * size else size)
    w, parts = width * scale, max(1, -(-count // cell))
    if depth is None:
        rate = min(1.0, min(sample, 2_000_000 // max(1, dim)) / count)
        drawn = entries.where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < rate * (1 << 20)).select("v")
        depth = fitting_depth(matrix(drawn.toArrow().column(0)), k, tables, w, probes, max(3, round(0.75 * math.log2(max(2, count)))), recall)

    def index(batches):
        for batch in batches:
            x = matrix(batch.column(0))
            if not len(x):
                continue
            for t in range(tables):
                a, b = directions(t, dim, depth, w)
                name = keyed(np.floor((x @ a + b) / w), t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), t, dtype=np.int32)), pa.array((name % parts).astype(np.int32)), pa.array(name), *batch.columns],
                    names=["t", "p", "bucket", "v", "ids"],
                )

    def probe(batches):
        for batch in batches:
            x, ids = matrix(batch.column(1)), batch.column(0).to_pylist()
            out: list[tuple] = []
            for t in range(tables):
                a, b = directions(t, dim, depth, w)
                f = x @ a + b
                slots = np.floor(f / w)
                for i, q in enumerate(ids):
                    near = np.tile(slots[i], (probes, 1))
                    sets = perturbations(f[i] - slots[i] * w, w, probes)
                    for n, moves in enumerate(sets):
                        for at, step in moves:
                            near[n, at] += step
                    names = keyed(near[: len(sets)], t)
                    where = names % parts
                    for p in np.unique(where):
                        out.append((t, int(p), q, names[where == p], i))
            columns = [
                pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.int64()),
                pa.array([r[3] for r in out], pa.list_(pa.int64())), batch.column(1).take(pa.array([r[4] for r in out], pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["t", "p", "q", "buckets", "qv"])

    held, kinds = (entries.schema[c].dataType.simpleString() for c in ("v", "ids"))
    stored = entries.mapInArrow(index, f"t int, p int, bucket long, v {held}, ids {kinds}")
    # drawing probes is the dear part: written once, as sizes are counted before rows are dealt
    probed = materialize(asked.mapInArrow(probe, f"t int, p int, q long, buckets array<long>, qv {held}"))
    stored, probed = _dealt(stored, probed, ["t", "p"], cell)

    def meet(_, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            bucket = left.column("bucket").to_numpy()
            order = np.argsort(bucket, kind="stable")
            sorted_ = bucket[order]
            x, ids = matrix(left.column("v")), left.column("ids").to_pylist()
            for q, qv, names in zip(right.column("q").to_pylist(), matrix(right.column("qv")), right.column("buckets")):
                names = names.values.to_numpy()
                lo, hi = np.searchsorted(sorted_, names, "left"), np.searchsorted(sorted_, names, "right")
                found = [order[a:b] for a, b in zip(lo, hi) if a < b]
                if found:
                    out += [(q, *r) for r in nearest(qv, q, np.concatenate(found), x, ids, k)]
        return _candidates(out)

    found = stored.groupBy("t", "p", "block").cogroup(probed.groupBy("t", "p", "block")).applyInArrow(meet, CANDIDATE)
    merged = materialize(_best(found, k))
    enough = merged.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k, count - 1))
    rest = asked.join(enough, asked["q"] == enough["query_id"], "left_anti")
    if count > 1 and not rest.isEmpty():
        merged = merged.join(rest.select(F.col("q").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(exact(entries, rest, k, cell))
    return merged.select("query_id", "rank", "vec_id", "score")


def exact(entries: DataFrame, asked: DataFrame, k: int = 10, cell: int = 20_000) -> DataFrame:
    """The ``k`` nearest of each query (q, qv) among all entries (v, ids): blocks of both meet by number."""
    n, m = max(1, -(-entries.count() // cell)), max(1, -(-asked.count() // cell))
    left = entries.withColumn("i", F.pmod(F.xxhash64("v"), F.lit(n))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    right = asked.withColumn("j", F.pmod(F.xxhash64("q"), F.lit(m))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    left, right = left.select("v", "ids", F.col("i").cast("int"), F.col("j").cast("int")), right.select("q", "qv", F.col("i").cast("int"), F.col("j").cast("int"))

    def meet(_, a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if a.num_rows and b.num_rows:
            x, ids, whole = matrix(a.column("v")), a.column("ids").to_pylist(), np.arange(a.num_rows)
            for q, qv in zip(b.column("q").to_pylist(), matrix(b.column("qv"))):
                out += [(q, *r) for r in nearest(qv, q, whole, x, ids, k)]
        return _candidates(out)

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, CANDIDATE)
    return _best(found, k)


def _window(by: str, order: str, *more: str):
    from pyspark.sql import Window

    return Window.partitionBy(by).orderBy(order, *more)


CANDIDATE = "query_id long, vec_id long, score double, n long, entry long"


def _candidates(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["query_id", "vec_id", "score", "n", "entry"])


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best candidate rows of each query, with their ranks.  A candidate that several tables
    found is one; its ``n`` rows of the same id and distance follow each other."""
    best = F.row_number().over(_window("query_id", "score", "vec_id", "entry"))
    once = found.distinct()
    few = once.withColumn("best", best).where(F.col("best") <= k)
    rows = few.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    rank = F.row_number().over(_window("query_id", "score", "vec_id", "entry", "turn")).cast("int")
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _dealt(left: DataFrame, right: DataFrame, by: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``block``: groups of over ``most`` rows on a side are split on that side, and
    the other side's rows go to each of its blocks."""
    size = lambda df, n: df.groupBy(*by).agg(F.count(F.lit(1)).alias(n))
    sizes = materialize(
        size(left, "nl").join(size(right, "nr"), by)
        .select(*by, F.ceil(F.col("nl") / most).cast("int").alias("a"), F.ceil(F.col("nr") / most).cast("int").alias("b"))
    )
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    i, j = F.pmod(F.xxhash64("v"), F.col("a")).cast("int"), F.pmod(F.xxhash64("q"), F.col("b")).cast("int")
    left = left.join(sizes, by).withColumn("block", F.explode(F.transform(every("b"), lambda n: i * F.col("b") + n))).drop("a", "b")
    right = right.join(sizes, by).withColumn("block", F.explode(F.transform(every("a"), lambda n: n * F.col("b") + j))).drop("a", "b")
    return left, right
