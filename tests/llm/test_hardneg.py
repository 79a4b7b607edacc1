import math
import random

import numpy as np
from pyspark.sql import functions as F

from storeflow.llm import hardneg
from storeflow.llm.hardneg import Block, integers, mine, scan


def plain(rows, every=5, k=5, m=3):
    part = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        part.append((i, [math.floor(256 * x) for x in v], label))
    out = []
    for a, av, al in part:
        if a is None or a % every:
            continue
        score = lambda v: sum(x * y for x, y in zip(av, v))  # noqa: B023, E731
        key = lambda x: (-x[0], math.inf if x[1] is None else x[1])
        mates = sorted(((score(v), i) for i, v, label in part if label == al and i != a), key=key)[:k]
        others = sorted(((score(v), i) for i, v, label in part if label != al), key=key)
        for ps, p in mates:
            for rank, (ns, n) in enumerate([x for x in others if 50 * ps <= 100 * x[0] <= 95 * ps][:m], 1):
                out.append((a, p, rank, n, ps, ns))
    return sorted(out, key=repr)


def table(seed=4, n=160, d=20, spread=0.3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(d)] for _ in range(3)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in centres[rng.randrange(3)]], rng.randrange(4)) for i in range(n)]
    rows += [(n + 3, None, 1), (n + 4, [0.1] * d, None), (n + 5, [float("nan")] + [0.1] * (d - 1), 2), (n + 6, [None, *[0.1] * (d - 1)], 2), (n + 10, [float("inf")] * d, 1)]
    rows += [(10, rows[10][1], rows[10][2]), (11, rows[11][1], rows[11][2]), (None, [0.2] * d, 0), (n + 15, [], 1), (n + 20, [0.5] * 3, 2), (n + 25, [0.0] * d, 3), (n + 30, [0.4] * (d + 4), 3)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as id", "'x' as v", "2 as block").repartition(3)


def test_like_brute_force(spark):
    rows = table()
    want = plain(rows)
    assert len(want) > 100
    for limits in ({}, {"slice_bytes": 3000, "rows_per_block": 4}):
        got = mine(integers(frame(spark, rows)), F.col("id") % 5 == 0, **limits).collect()
        assert sorted((tuple(r) for r in got), key=repr) == want


def test_scores_beyond_doubles(spark):
    rows = [(i, None if v is None else [x if x is None else x * 2.0**20 for x in v], y) for i, v, y in table(n=40, d=6)]
    want = plain(rows)
    assert max(abs(r[4]) for r in want) > hardneg.EXACT
    assert sorted((tuple(r) for r in mine(integers(frame(spark, rows)), F.col("id") % 5 == 0).collect()), key=repr) == want
    ends = [(0, [1e300] * 6, 1), (1, [1e300] * 6, 1), (2, [-1e300] * 6, 2), (3, [1.0] * 6, 2)]
    got = mine(integers(frame(spark, ends)), F.col("id") == 0, low=0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 3, (1 << 63) - 1, (1 << 63) - 1)] or got == []


def test_no_rows_no_mates(spark):
    assert mine(integers(frame(spark, [])), F.col("id") % 5 == 0).count() == 0
    assert mine(integers(frame(spark, [(0, [1.0, 2.0], 1), (1, [1.0, 1.0], 2)])), F.col("id") % 5 == 0).count() == 0


def test_scan_gives_up_early():
    rng = np.random.Generator(np.random.PCG64(1))
    columns = rng.integers(-100, 100, (64, 2000))
    block = Block(np.arange(2000), np.zeros(2000, int), columns)
    anchor = rng.integers(-100, 100, 64)
    scores, seen = anchor @ block.columns, []

    def keep(low, high, alive):
        assert len(low) == len(alive)
        seen.append(int(alive.sum()))
        return high >= np.sort(scores)[-3]

    places, found = scan(anchor, block, slice(0, 2000), np.ones(2000, bool), keep)
    assert sorted(places) == sorted(np.argsort(scores)[-3:]) and set(found) == set(np.sort(scores)[-3:].astype(float))
    assert seen[-1] < 200 < seen[0]
    assert hardneg.STEP < 64
