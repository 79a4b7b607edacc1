"""Matching and areas against plain versions."""

import random

from pyspark.sql import functions as F

from storeflow.functions import geometry as g
from storeflow.operators import matching


def test_alerts_like_a_scan_of_all_events(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["alert", "event"]), i, (t := rng.randrange(300)), t + rng.randrange(1, 60)) for i in range(300) for k in [rng.randrange(3)]]
    got = matching.match_alerts(spark.createDataFrame(rows, "k int, side string, id long, start_ms long, end_ms long"), ["k"], 7)
    want = []
    for k in range(3):
        events = sorted((s, i, e) for q, side, i, s, e in rows if q == k and side == "event")
        used = set()
        for t, i in sorted((s, i) for q, side, i, s, _ in rows if q == k and side == "alert"):
            near = [x for x in events if x[0] - 7 <= t <= x[2] + 7]
            free = [x for x in near if x[1] not in used]
            if free:
                best = min(free, key=lambda x: (abs(x[0] - t), events.index(x)))
                used.add(best[1])
                want.append((k, i, "hit", best[1], t - best[0]))
            else:
                want.append((k, i, "duplicate" if near else "false", None, None))
        want += [(k, None, "missed", i, None) for _, i, _ in events if i not in used]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_candidates_like_a_scan_of_all_labels(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(3), rng.choice(["candidate", "label"]), rng.choice(["TAKE", "BROWSE"]), i, (t := rng.randrange(600)), t + rng.randrange(0, 12)) for i in range(300)]
    got = matching.match_candidates(spark.createDataFrame(rows, "k int, side string, kind string, id long, start_ms long, end_ms long"), ["k"])
    assert got.count() > 0
    want = []
    for k in range(3):
        labels = sorted((s, i, e, kind) for q, side, kind, i, s, e in rows if q == k and side == "label")
        used = set()
        for s, i, e in sorted((s, i, e) for q, side, _, i, s, e in rows if q == k and side == "candidate"):
            over = [x for x in labels if x[0] <= e and x[2] >= s]
            free = [x[1] for x in over if x[3] == "TAKE" and x[1] not in used]
            used |= set(free[:1])
            want.append((k, i, "tp" if free else "fp_browse" if any(x[3] == "BROWSE" for x in over) else "fp_other", free[0] if free else None))
        want += [(k, None, "fn", x[1]) for x in labels if x[3] == "TAKE" and x[1] not in used]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_maps_take_the_falling_order(spark):
    rng = random.Random(8)
    pairs = {(rng.randrange(2), rng.randrange(30), f"n{rng.randrange(30)}"): float(rng.randrange(6)) for _ in range(700)}
    rows = [(*k, s) for k, s in pairs.items()]
    rows += [(2, i, f"n{i + j}", 100.0 - 2 * i - j) for i in range(6) for j in (0, 1)]  # each pair waits for the one before
    d = spark.createDataFrame(rows, "k int, a long, b string, s double")
    want, used = [], set()
    for s, k, a, b in sorted((-s, k, a, b) for k, a, b, s in rows):
        if -s >= 1 and not {(k, "a", a), (k, "b", b)} & used:
            used |= {(k, "a", a), (k, "b", b)}
            want.append((k, a, b, -s))
    assert sorted(map(tuple, matching.greedy_map(d, ["k"], "a", "b", "s", 1.0).collect())) == sorted(want)
    assert matching.greedy_map(d.limit(0), ["k"], "a", "b", "s", 1.0).count() == 0


def test_labels_are_cut_only_where_no_pair_can_reach(spark):
    import numpy as np

    rng = random.Random(4)
    rows, t = [], {0: 0.0, 1: 0.0}
    for i in range(300):
        k = rng.randrange(2)
        t[k] += rng.choice([0.5, 1.0, 3.0, 8.0, 8.5, 20.0])
        rows.append((k, rng.choice(["label", "sensor"]), i, t[k]))
    got = matching.match_labels(spark.createDataFrame(rows, "k int, side string, id long, at double"), ["k"], 2.0, 8.0).collect()
    for k in range(2):
        a, b = (sorted((x, i) for q, s, i, x in rows if q == k and s == side) for side in ("label", "sensor"))
        pairs = matching.best_pairs(np.array([x for x, _ in a]), np.array([x for x, _ in b]), 2.0, 8.0)
        mine = [r for r in got if r.k == k and r.kind == "matched"]
        assert len(mine) == len(pairs) and abs(sum(abs(r.dt) for r in mine) - sum(abs(b[j][0] - a[i][0]) for i, j in pairs)) < 1e-9
        assert sum(r.k == k and r.kind == "missed" for r in got) == len(a) - len(pairs)


def test_shared_area_like_clipping(spark):
    rng = random.Random(5)
    shapes = [[(0, 0), (10, 0), (10, 10), (0, 10)], [(0, 0), (10, 0), (5, 9)], [(0, 0), (10, 0), (10, 10), (5, 3), (0, 10)], [(1, 1), (1, 9), (9, 9), (9, 1)], [(0, 5), (5, 0), (10, 5), (5, 10)]]
    boxes = []
    for _ in range(60):
        x, y = rng.choice([-3, 0, 2, 4.5, 9]), rng.choice([-3, 0, 2, 4.5, 9])
        boxes.append((float(x), float(y), x + rng.choice([0.5, 3.0, 20.0]), y + rng.choice([0.5, 3.0, 20.0])))
    df = spark.createDataFrame(boxes, "x1 double, y1 double, x2 double, y2 double").select(F.struct("*").alias("b"))
    for s in shapes:
        poly = g.points(*s)
        for r in df.select(g.overlap_area(poly, F.col("b")).alias("a"), g.polygon_area(g.clip_to_box(poly, F.col("b"))).alias("c")).collect():
            assert abs(r.a - (r.c or 0.0)) < 1e-9
