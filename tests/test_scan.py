import bisect
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import scan as reads
from tidemark.operators.cursor import Cursor
from tidemark.operators.scan import GE, GT, LE, LT, Bounds

# bounds, start comparison, start, the key it stands on, else the key one step back into the range
TRUTH = [
    (Bounds(3, 6), GE, 1, 3, None), (Bounds(3, 6, GT, LE), GE, 1, 4, None),
    (Bounds(3, 6), LE, 1, None, 3), (Bounds(3, 6, GT, LE), LE, 1, None, 4),
    (Bounds(3, 6, GT, LE), GE, 3, 4, None), (Bounds(3, 6, GT, LE), LE, 3, None, 4),
    (Bounds(3, 6), GE, 3, 3, None), (Bounds(3, 6), LE, 3, 3, None),
    (Bounds(3, 6), LE, 8, 5, None), (Bounds(3, 6, GE, LE), LE, 8, 6, None),
    (Bounds(3, 6), GE, 8, None, 5), (Bounds(3, 6, GE, LE), GE, 8, None, 6),
    (Bounds(3, 6), LE, 6, 5, None), (Bounds(3, 6), GE, 6, None, 5),
    (Bounds(3, 6, GE, LE), GE, 6, 6, None), (Bounds(3, 6, GE, LE), LE, 6, 6, None),
]


@pytest.fixture(scope="module")
def digits(spark):
    return spark.createDataFrame([(i,) for i in range(10)], "sort_key long").cache()


@pytest.mark.parametrize("bounds,cmp,start,on,step", TRUTH)
def test_cursor_starts(digits, bounds, cmp, start, on, step):
    c = Cursor(digits, bounds, cmp, start)
    if on is not None:
        assert c.valid() and c.current()["sort_key"] == on
        return
    assert not c.valid()
    if cmp in (GT, GE):
        assert c.can_prev() and not c.can_next()
        c.prev()
    else:
        assert c.can_next() and not c.can_prev()
        c.next()
    assert c.current()["sort_key"] == step


def test_cursor_walks_turns_and_comes_back(digits):
    with Cursor(digits, Bounds(2, 8), page=2) as c:
        seen = []
        while c.valid():
            seen.append(c.current()["sort_key"])
            c.next()
        assert seen == [2, 3, 4, 5, 6, 7] and not c.can_next() and c.can_prev()
        with pytest.raises(ValueError):
            c.next()
        back = []
        c.prev()
        while c.valid():
            back.append(c.current()["sort_key"])
            c.prev()
        assert back == seen[::-1]
        c.next()
        c.next()
        c.prev()
        assert c.current()["sort_key"] == 2 and c.status() is None
    empty = Cursor(digits, Bounds(6, 3))
    assert not empty.valid() and not empty.can_next() and not empty.can_prev()


def test_bounds():
    with pytest.raises(ValueError):
        Bounds(1, 2, LT, LE)
    with pytest.raises(ValueError):
        Bounds(1, 2, GT, GE)
    assert Bounds(5, 5).empty() and not Bounds(5, 5, GE, LE).empty() and Bounds(6, 5).empty() and not Bounds(None, 5).empty()


def test_scans_push_their_range_down(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id AS sort_key", "id AS value").write.parquet(path)
    rows = reads.scan(spark.read.parquet(path), Bounds(100, 200), LE, 150, limit=5)
    assert [r["sort_key"] for r in rows.collect()] == [150, 149, 148, 147, 146]
    plan = rows._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(sort_key,100)" in plan and "TakeOrderedAndProject" in plan


@pytest.mark.parametrize("kind", ["number", "string"])
def test_positions_neighbours_and_nearest(spark, kind):
    draw = random.Random(4)
    make = (lambda x: x) if kind == "number" else (lambda x: f"k{x:05d}"[: 2 + x % 5])
    keys = sorted({make(draw.randint(0, 3000)) for _ in range(400)})
    probes = sorted({make(draw.randint(-50, 3100) if kind == "number" else draw.randint(0, 3100)) for _ in range(300)})
    rows = spark.createDataFrame([(k,) for k in keys], f"sort_key {'long' if kind == 'number' else 'string'}")
    asks = spark.createDataFrame([(p,) for p in probes], f"probe {'long' if kind == 'number' else 'string'}")
    assert {r["sort_key"]: r["pos"] for r in reads.positions(rows).collect()} == {k: i + 1 for i, k in enumerate(keys)}
    assert {r["sort_key"]: r["pos"] for r in reads.positions(rows, descending=True).collect()} == {k: len(keys) - i for i, k in enumerate(keys)}
    beside = {r["sort_key"]: (r["prev_key"], r["next_key"]) for r in reads.neighbours(rows).collect()}
    assert beside == {k: (keys[i - 1] if i else None, keys[i + 1] if i + 1 < len(keys) else None) for i, k in enumerate(keys)}
    for cmp, ok, pick in ((LE, lambda k, p: k <= p, max), (LT, lambda k, p: k < p, max), (GE, lambda k, p: k >= p, min), (GT, lambda k, p: k > p, min)):
        got = {r["probe"]: r["nearest"] for r in reads.seek_nearest(rows, asks, cmp).collect()}
        assert got == {p: pick((k for k in keys if ok(k, p)), default=None) for p in probes}


def test_empty_input(spark):
    rows = spark.createDataFrame([], "sort_key long")
    assert reads.positions(rows).count() == reads.neighbours(rows).count() == 0
    assert reads.scan(rows, Bounds(1, 2)).count() == 0


def _kinds():
    from datetime import date, timedelta
    from decimal import Decimal

    day = lambda x: date(2020, 1, 1) + timedelta(days=x)
    return {
        "long": ("long", lambda x: x), "name": ("string", lambda x: f"Customer#{x:09d}"), "date": ("date", day),
        "decimal": ("decimal(12,3)", lambda x: Decimal(x) / 8), "binary": ("binary", lambda x: f"{x:05d}".encode()),
        "pair": ("struct<_0:int,_1:string>", lambda x: (x % 7, f"v{x:05d}")), "double": ("double", lambda x: 10.0 ** (x % 300)),
    }


@pytest.mark.parametrize("kind", sorted(_kinds()))
def test_ordered_reads_of_any_key_in_many_ranges(spark, kind):
    draw = random.Random(8)
    sql, make = _kinds()[kind]
    keys = sorted({make(draw.randint(0, 3000)) for _ in range(300)})
    hot = make(draw.randint(0, 3000))
    keys = sorted({*keys, hot})
    listed = [*keys, *[hot] * 200, None, None]
    draw.shuffle(listed)
    probes = [*{make(draw.randint(0, 3100)) for _ in range(150)}, *[hot] * 300, None]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(listed)], f"sort_key {sql}, i int").repartition(3)
    asks = spark.createDataFrame([(p, i) for i, p in enumerate(probes)], f"probe {sql}, j int").repartition(2)
    plain = lambda v: tuple(v) if isinstance(v, tuple) else bytes(v) if isinstance(v, bytearray) else v
    order = sorted((k for k in listed if k is not None))
    for n in (1, 40):
        up = sorted((r["pos"], plain(r["sort_key"])) for r in reads.positions(rows, ranges=n).collect())
        assert [p for p, _ in up] == list(range(1, len(listed) + 1)) and [k for _, k in up] == [None, None, *order]
        down = sorted((r["pos"], plain(r["sort_key"])) for r in reads.positions(rows, descending=True, ranges=n).collect())
        assert [k for _, k in down] == [*order[::-1], None, None]
        got = sorted((plain(r["sort_key"]), plain(r["prev_key"]), plain(r["next_key"])) for r in reads.neighbours(rows.where("i IS NOT NULL").dropDuplicates(["sort_key"]), ranges=n).collect() if r["sort_key"] is not None)
        assert got == [(k, keys[i - 1] if i else None, keys[i + 1] if i + 1 < len(keys) else None) for i, k in enumerate(keys)]
        for cmp, ok, pick in ((LE, lambda k, p: k <= p, max), (LT, lambda k, p: k < p, max), (GE, lambda k, p: k >= p, min), (GT, lambda k, p: k > p, min)):
            got = sorted(((plain(r["probe"]), plain(r["nearest"])) for r in reads.seek_nearest(rows, asks, cmp, ranges=n).collect()), key=repr)
            assert got == sorted(((p, None if p is None else pick((k for k in keys if ok(k, p)), default=None)) for p in probes), key=repr), (cmp, n)


def test_ranges_hold_their_share(spark):
    from pyspark.sql import functions as F

    rows = spark.range(20_000).selectExpr("format_string('Customer#%09d', id) AS sort_key", "id")
    rows = rows.unionByName(spark.range(10_000).selectExpr("'Customer#000000777' AS sort_key", "id + 100000 AS id"))
    dealt = reads.Ranges(rows, "sort_key", 16)
    sizes = [r["count"] for r in rows.groupBy(dealt.of(F.col("sort_key"), F.xxhash64("sort_key", "id")).alias("r")).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 30_000 / 16


def test_ranges_look_at_few_cuts(spark):
    """A key is dealt by halving, once a row: not compared with a stretch of cuts, nor dealt again by a filter."""
    rows = spark.range(4000).select(F.struct((F.col("id") % 50).alias("_0"), F.col("id").alias("_1")).alias("sort_key"))
    dealt = reads.Ranges(rows, "sort_key", 200)
    cuts = dealt.cuts
    got = rows.select("sort_key", dealt.of(F.col("sort_key")).alias("r")).collect()
    assert len(cuts) > 100 and all(r["r"] == bisect.bisect_left(cuts, r["sort_key"]) for r in got)
    plan = reads.neighbours(rows, ranges=200)._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    assert "filter(" not in text
    assert not [line for line in text.split("\n") if "Filter" in line and "aggregate(" in line]
