"""Lag search and identity maps between two recordings."""

import math
import random

from storeflow.operators import matching as mt
from storeflow.operators import sync as sy

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def test_identity_overlap(spark):
    box = lambda x: (float(x), 0.0, x + 10.0, 10.0)
    ref = [("r", f, 7, box(0)) for f in (0, 4, 8)] + [("r", f, 8, box(100)) for f in range(10)]
    new = [("r", f, 1, box(5)) for f in range(10)] + [("r", f, 2, box(100 + f)) for f in range(10)] + [("r", 50, 3, box(0)), ("q", 0, 1, box(0))]
    df = lambda rows: spark.createDataFrame(rows, f"run string, frame long, person long, box {BOX}")
    s = sy.identity_overlap(df(ref), df(new), ["run"], "frame", "person", "box")
    got = {(r.old_id, r.new_id): round(r.score, 6) for r in s.collect()}
    assert got[1, 7] == 5.0 and got[1, 8] == 0.0 and got[2, 7] == 0.0 and got[2, 8] == round(sum((10 - f) / 10 for f in range(10)), 6), got
    assert not {k for k in got if k[0] == 3}
    assert sorted((r.old_id, r.new_id) for r in mt.greedy_map(s, ["run"], "old_id", "new_id", "score", 1.0).collect()) == [(1, 7), (2, 8)]


def test_of_two_frames_as_near_the_earlier_counts(spark):
    df = lambda rows: spark.createDataFrame(rows, f"run string, frame long, person long, box {BOX}")
    s = sy.identity_overlap(df([("r", 4, 7, (0.0, 0.0, 10.0, 10.0)), ("r", 6, 7, (500.0, 0.0, 510.0, 10.0))]), df([("r", 5, 1, (0.0, 0.0, 10.0, 10.0))]), ["run"], "frame", "person", "box")
    assert [r.score for r in s.collect()] == [1.0]


def walk(seed, shift, n=200, step=100):
    rng, x, y, out = random.Random(seed), 0.0, 0.0, []
    for i in range(n):
        x, y = x + rng.gauss(0, 12), y + rng.gauss(0, 12)
        out.append((step * i + shift, i, x, y))
    return out


def test_floor_lag_finds_the_shift(spark):
    first, second = walk(1, 0), walk(1, 700)
    rows = lambda w, other: [("p", t, i, [(x, y), *other]) for t, i, x, y in w] + [("p", 10**6, 999, [])] + [("far", t, i, [(x, y)]) for t, i, x, y in walk(9 if other else 5, 0, 60)]
    df = lambda r: spark.createDataFrame(r, "pair string, t long, i long, points array<struct<x:double,y:double>>")
    a, b = df(rows(first, [])), df(rows(second, [(900.0, 900.0)]))
    lags = list(range(-2000, 2001, 100))
    curve = sy.floor_lags(a, b, ["pair"], "t", "i", "points", lags, tolerance=25)
    got = {r.pair: r for r in sy.best_lag(curve, ["pair"], 100).collect()}
    assert abs(got["p"].offset_ms - 700) < 60 and got["p"].pairs == 200 and got["p"].cost < 60 and got["p"].sharpness > 1.2 and got["p"].ok
    assert not got["far"].ok and got["far"].reasons
    assert abs(got["p"].second_ms - 700) > 500
    one = {(r.pair, r.lag_ms): r for r in curve.collect()}["p", 700]
    assert math.isclose(one.cost, 150 / 3, rel_tol=1e-9), "two points on one side, one on the other, the extra one capped"
    assert sy.floor_lags(a.where("i < 10"), b, ["pair"], "t", "i", "points", lags).count() == 0, "too few pairs"


def test_correlation_lag_and_fallback(spark):
    def course(pair, seed, shift, n, flip=1):
        return [(pair, t, i, flip * x) for t, i, x, _ in walk(seed, shift, n)]

    a = course("a", 1, 0, 200) + course("b", 2, 0, 200) + course("short", 3, 0, 40) + course("still", 4, 0, 0) + [("still", 100 * i, i, 5.0) for i in range(100)]
    b = course("a", 1, 300, 200, -1) + course("b", 2, 500, 200) + course("short", 3, 900, 40) + [("still", 100 * i, i, float(i)) for i in range(100)]
    df = lambda r: spark.createDataFrame(r, "pair string, t long, i long, x double")
    got = {r.pair: r for r in sy.correlation_lags(df(a), df(b), ["pair"], "t", "i", "x", list(range(-1500, 1501, 100)), 25).collect()}
    assert (got["a"].offset_ms, got["a"].method) == (300.0, "trajectory") and (got["b"].offset_ms, got["b"].method) == (500.0, "trajectory")
    assert (got["short"].offset_ms, got["short"].method) == (400.0, "trajectory-fallback"), "the median of what is believed"
    assert got["still"].method == "trajectory-fallback" and got["still"].offset_ms == 400.0 and got["still"].r is None
