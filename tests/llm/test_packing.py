import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import packing


def best_fit(lengths, capacity):
    """Best fit over decreasing lengths, a piece at a time."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def check(rows, lengths, capacity):
    """Sequences are gapless and within capacity, and every piece is placed once; returns their number."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    assert Counter(r["length"] for r in rows) == Counter(lengths) and len({r["doc_id"] for r in rows}) == len(rows)
    return len(by)


def test_sweep_takes_the_longest_that_fits_and_goes_on():
    got = list(packing.sweep([(6, 0, 3), (4, 10, 1), (2, 20, 9)], [(10, 100, 4), (5, 50, 1), (1, 7, 2)], 10))
    assert got[0] == (packing.GAPS, 1, 7, 2, 0, 0, 0)
    assert got[1] == (packing.PLACED, 4, 50, 1, 10, 5, 1)  # 4 into the gap of 5, at its beginning
    assert (packing.PLACED, 6, 100, 3, 0, 0, 1) in got and (packing.PLACED, 2, 100, 3, 20, 6, 2) in got
    assert sum(r[3] * r[6] for r in got if r[0] == packing.PLACED) == 13 and not [r for r in got if r[0] == packing.PIECES]


@pytest.mark.parametrize("capacity,top,most", [(10, 10, 8192), (64, 64, 8), (1024, 700, 64), (65_536, 9_000, 256)])
def test_as_few_sequences_as_best_fit(spark, capacity, top, most):
    draw = random.Random(capacity)
    lengths = [min(capacity, 1 + int(draw.paretovariate(0.7))) if i % 3 else draw.randint(1, top) for i in range(1500)]
    parts = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "doc_id long, piece int, length long").repartition(5)
    rows = packing.pack(parts, capacity, most=most, stretch=16).collect()
    bound = -(-sum(lengths) // capacity)
    used = check(rows, lengths, capacity)
    assert bound <= used <= max(best_fit(lengths, capacity), bound + 1)


def test_rounds_are_few(spark):
    draw = random.Random(2)
    counts = Counter(min(65_536, 1 + int(draw.lognormvariate(6, 2))) for _ in range(200_000))
    runs = spark.createDataFrame(list(counts.items()), "length long, n long")
    placed, opened, turns = packing.rounds(runs, 65_536, most=2_000)
    volume = sum(n * c for n, c in counts.items())
    assert turns < 30 and -(-volume // 65_536) <= opened <= -(-volume // 65_536) * 1.02 + 1
    total = sum(p.agg(F.sum(F.col("count") * F.col("each"))).first()[0] or 0 for p in placed)
    assert total == 200_000


def test_a_length_that_a_third_shares(spark):
    lengths = [7] * 1000 + [1] * 900 + [n % 40 + 1 for n in range(1100)]
    parts = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "doc_id long, piece int, length long").repartition(5)
    rows = packing.pack(parts, 40, stretch=64).collect()
    assert check(rows, lengths, 40) <= best_fit(lengths, 40)
