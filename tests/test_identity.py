"""Exchanged ids: composition over time, spans, and when a swap is believed."""

import random

from storeflow.operators import identity as idn


def plain(rows, swaps):
    out = []
    for k, who, t in rows:
        v = who
        for a, b, since in sorted(swaps, key=lambda s: (s[2], s[0], s[1])):
            if since <= t and v in (a, b):
                v = b if v == a else a
        out.append((k, who, v))
    return sorted(out)


def test_chained_swaps(spark):
    swaps = spark.createDataFrame([(1, 2, 1), (2, 3, 2)], "a long, b long, since long")
    rows = spark.createDataFrame([(i, i, t) for t in (0, 1, 5) for i in (1, 2, 3, 9)], "k long, who long, t long")
    got = sorted((r.t, r.was, r.who) for r in idn.relabel_since(rows, swaps, "who", "t").collect())
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 9, 9), (1, 1, 2), (1, 2, 1), (1, 3, 3), (1, 9, 9), (5, 1, 3), (5, 2, 1), (5, 3, 2), (5, 9, 9)]


def test_like_one_swap_after_another(spark):
    rng = random.Random(7)
    swaps = [(rng.randrange(12), rng.randrange(12), rng.randrange(50)) for _ in range(14)] + [(3, 3, 4)]
    rows = [(i, rng.randrange(14), rng.randrange(60)) for i in range(300)]
    got = idn.relabel_since(spark.createDataFrame(rows, "k long, who long, t long"), spark.createDataFrame(swaps, "a long, b long, since long"), "who", "t").collect()
    assert sorted((r.k, r.was, r.who) for r in got) == plain(rows, [s for s in swaps if s[0] != s[1]])


def test_a_second_swap_undoes_the_first(spark):
    h = idn.swap_history(spark.createDataFrame([(1, 2, 5), (2, 1, 9)], "a long, b long, since long")).collect()
    assert sorted((r.id, r.since, r.until, r.is_now) for r in h) == [(1, 5, 9, 2), (1, 9, None, 1), (2, 5, 9, 1), (2, 9, None, 2)]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "x long, y long")
    got = {r.id: r.root for r in idn.components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_spans_are_cut_and_joined(spark):
    swaps = spark.createDataFrame([(11, 12, 2000)], "a long, b long, since long")
    spans = spark.createDataFrame([(1, 0, 2000, 11), (1, 2000, 4000, 12), (2, 0, 3000, 12), (3, 0, 9000, 40), (4, 2500, 3000, 11)], "near long, s long, e long, far long")
    got = sorted(tuple(r) for r in idn.relabel_spans(spans, swaps, ["near"], "far", "s", "e").select("near", "s", "e", "far").collect())
    assert got == [(1, 0, 4000, 11), (2, 0, 2000, 12), (2, 2000, 3000, 11), (3, 0, 9000, 40), (4, 2500, 3000, 12)]


def test_mutual_swaps_need_steady_windows_and_overlap(spark):
    straight, crossed = {1: 11, 2: 12}, {1: 12, 2: 11}

    def swaps(plan, overlaps):
        rows = [(0, n, 500 * n, near, far) for n, links in enumerate(plan) for near, far in links.items()]
        w = spark.createDataFrame(rows, "run long, n long, start_ms long, near long, far long")
        o = spark.createDataFrame(overlaps, "run long, n long, view string, a long, b long, overlap double")
        return [tuple(r) for r in idn.mutual_swaps(w, ["run"], o).collect()]

    far = [(0, 1, "far", 11, 12, 0.75), (0, 2, "far", 11, 12, 0.1)]
    want = [(0, 1000, 11, 12, 1, 2)]
    assert swaps([straight, straight, crossed, crossed], far) == want
    assert swaps([straight, crossed, crossed], far) == [], "one window before is not enough"
    assert swaps([straight, straight, crossed], [(0, 1, "far", 11, 12, 0.3)]) == [], "the far boxes never overlapped"
    assert swaps([straight, straight, crossed], [*far, (0, 2, "near", 1, 2, 0.6)]) == [], "nor may the near ones"
    assert swaps([straight, straight, crossed], [*far, (0, 0, "near", 1, 2, 0.6)]) == want, "but earlier ones may"
    assert swaps([straight, straight, {1: 12}], far) == []
