"""Scripted cases of the registry's rules."""

import numpy as np
from pyspark.sql import functions as F

from storeflow.operators import people
from storeflow.operators.people import Registry, Seen
from storeflow.plans import reports

A, B, C = np.eye(3)
HERE, AWAY = (0.0, 0.0, 40.0, 100.0), (500.0, 0.0, 540.0, 100.0)


def like(v, s):
    """A unit vector with the cosine s to the basis vector v."""
    return s * v + np.sqrt(1 - s * s) * np.roll(v, 1)


def play(m, *frames):
    return [[(d.person, d.held) for d in m.frame(at, boxes)] for at, boxes in frames]


def test_match_needs_more_far_away():
    for box, s, person, stitched in ((AWAY, 0.5, 2, False), (AWAY, 0.7, 1, False), (HERE, 0.5, 1, True), (HERE, 0.4, 2, False), (HERE, 0.7, 1, False)):
        m = Registry()
        m.frame(0, [Seen(1, HERE, A)])
        d = m.frame(2000, [Seen(2, box, like(A, s))])[0]
        assert (d.person, d.stitched, d.new) == (person, stitched, person == 2)
    m = Registry()
    m.frame(0, [Seen(1, HERE, A)])
    assert m.frame(3001, [Seen(2, HERE, like(A, 0.5))])[0].person == 2  # near, but too long ago
    m = Registry()
    m.frame(0, [Seen(1, HERE, A)])
    assert m.frame(30_001, [Seen(2, HERE, A)])[0].person == 2  # retired


def test_a_person_in_the_frame_is_no_candidate():
    m = Registry()
    assert play(m, (0, [Seen(1, HERE, A)]), (500, [Seen(1, HERE, A), Seen(2, AWAY, A)]), (1000, [Seen(3, (900.0, 0.0, 940.0, 100.0), A)])) == [[(1, None)], [(1, None), (2, None)], [(1, None)]]


def test_holds():
    m = Registry(least_score=0.5, hold_overlap=0.8)
    inner = (5.0, 10.0, 35.0, 90.0)
    assert play(m, (0, [Seen(1, HERE, A, tall=False)]), (100, [Seen(1, HERE, A, score=0.4)]), (200, [Seen(1, HERE, A), Seen(2, inner, B)]), (300, [Seen(2, inner, B)])) == [[(-1, "small")], [(-1, "score")], [(1, None), (-1, "nested")], [(2, None)]]
    left, right = ((0.0, 0.0, 0.9),) * 3, ((30.0, 0.0, 0.9),) * 3
    m = Registry(hold_overlap=0.8, hold_pose=0.5)
    assert play(m, (0, [Seen(1, HERE, A, joints=left), Seen(2, inner, B, joints=right)])) == [[(1, None), (2, None)]]  # two people, one before the other


def test_cut_boxes_match_nobody():
    m = Registry()
    assert play(m, (0, [Seen(1, HERE, A)]), (500, [Seen(2, HERE, A, cut=True)])) == [[(1, None)], [(2, None)]]


def test_recheck_after_a_gap():
    m = Registry(recheck_ms=1000)
    assert play(m, (0, [Seen(1, HERE, A)]), (1000, [Seen(1, HERE, B)]), (2500, [Seen(1, AWAY, C)])) == [[(1, None)], [(1, None)], [(2, None)]]
    m = Registry(recheck_ms=1000)
    assert play(m, (0, [Seen(1, HERE, A)]), (9000, [Seen(1, AWAY, like(A, 0.5))])) == [[(1, None)], [(1, None)]]  # its own person needs less
    m = Registry(recheck_ms=1000, least_score=0.5)
    steps = [(0, [Seen(1, HERE, A)]), (5000, [Seen(1, HERE, B, cut=True)]), (5100, [Seen(1, HERE, B, tall=False)]), (5200, [Seen(1, HERE, B, score=0.1)]), (5300, [Seen(1, HERE, C)])]
    assert play(m, *steps) == [[(1, None)], [(1, None)], [(-1, "small")], [(-1, "score")], [(2, None)]]


def test_jump_takes_the_credit():
    for jump, person in ((True, 2), (False, 1)):
        m = Registry(jump_recheck=jump)
        assert play(m, (0, [Seen(1, HERE, A)]), (100, []), (200, [Seen(1, AWAY, like(A, 0.5))]))[-1] == [(person, None)]
    m = Registry(jump_recheck=True)
    assert play(m, (0, [Seen(1, HERE, A)]), (200, [Seen(1, AWAY, B)]))[-1] == [(1, None)]  # never away for a frame
    m = Registry(jump_recheck=True)
    assert play(m, (0, [Seen(1, HERE, A)]), (100, []), (200, [Seen(1, AWAY, like(A, 0.7))]))[-1] == [(1, None)]  # alike enough without credit


def test_one_box_each():
    m = Registry(one_box=True)
    m.frame(0, [Seen(1, HERE, A)])
    m.frame(400, [Seen(2, HERE, A)])
    assert m.tracks[1].person == m.tracks[2].person == 1
    assert play(m, (800, [Seen(1, AWAY, like(A, 0.3)), Seen(2, HERE, A)])) == [[(2, None), (1, None)]]
    m = Registry(one_box=True)
    m.frame(0, [Seen(1, HERE, A)])
    m.frame(400, [Seen(2, HERE, A)])
    assert play(m, (800, [Seen(1, AWAY), Seen(2, HERE)])) == [[(2, None), (1, None)]]  # no look: the one seen last keeps it


def test_tentative_people_are_no_candidates():
    m = Registry(tentative_ms=1000)
    assert play(m, (0, [Seen(1, HERE, A)]), (500, [Seen(2, HERE, A)]))[-1] == [(2, None)]
    m = Registry(tentative_ms=1000)
    play(m, *[(t, [Seen(1, HERE, A, inside=t != 500)]) for t in (0, 500, 600, 1500)])
    assert m.crowd.tentative[0]  # the time begins again after 500
    play(m, (1600, [Seen(1, HERE, A)]))
    assert not m.crowd.tentative[0] and play(m, (2000, [Seen(2, HERE, A)])) == [[(1, None)]]


def test_looks_of_several_heights_stay():
    m = Registry(templates=2, every=500)
    tall = lambda h: (0.0, 0.0, 40.0, h)
    play(m, (0, [Seen(1, tall(100.0), A)]), (500, [Seen(1, tall(300.0), B)]), (700, [Seen(1, tall(290.0), C)]), (1000, [Seen(1, tall(280.0), C)]))
    assert m.crowd.heights[0].tolist() == [100.0, 280.0]


def test_rows_are_frames(spark):
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    rows = [("r", 0, 1, HERE, [1.0, 0.0, 0.0], 0.9), ("r", 0, 2, AWAY, [0.0, 1.0, 0.0], None), ("r", 500, 3, HERE, None, 0.9), ("q", 0, 1, HERE, [0.0, 0.0, 0.0], 0.1)]
    d = spark.createDataFrame(rows, f"run string, ms long, track long, box {box}, vec array<double>, score double")
    got = people.register(d, ["run"], "ms", "track", "box", "vec", "score", least_score=0.5)
    assert sorted((r.run, r.ms, r.track, r.person_id, r.is_new, r.held) for r in got.collect()) == [("q", 0, 1, -1, False, "score"), ("r", 0, 1, 1, True, None), ("r", 0, 2, 2, True, None), ("r", 500, 3, 3, True, None)]
    assert people.register(d.limit(0), ["run"], "ms", "track", "box", "vec").count() == 0


def test_the_query_gives_a_person_one_box_a_frame(spark):
    got = reports.st9_identity_registry(spark, "/root/testdata/sf0.001").persist()
    assert got.where("person_id > 0").groupBy("run", "ms", "person_id").count().where("count > 1").isEmpty()
    assert got.where((F.col("person_id") < 0) != F.col("held").isNotNull()).isEmpty()
    assert {r.held for r in got.select("held").distinct().collect()} >= {None, "small", "score"}


FAR = (900.0, 0.0, 940.0, 100.0)


def photos(who, n, seed, signal=0.6, d=64):
    """Unit vectors of one person: any two are about signal ** 2 alike, their means much more."""
    base = np.random.default_rng(100 + who).normal(size=d)
    base /= np.linalg.norm(base)
    rng = np.random.default_rng(seed)
    noise = rng.normal(size=(n, d))
    noise -= (noise @ base)[:, None] * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    return signal * base + np.sqrt(1 - signal**2) * noise


def show(m, start, *tracks, every=100):
    """Tracks (number, box, photos) shown together from `start`; the last decisions."""
    for i in range(len(tracks[0][2])):
        said = m.frame(start + every * i, [Seen(k, b, vecs[i]) for k, b, vecs in tracks])
    return [d.person for d in said]


def merging(**params):
    return Registry(**{"match": 0.65, "stitch": 0.65, "retire_ms": 60_000, "every": 100, "merge_at": (10,), "merge": 0.75, **params})


def test_late_merge():
    m = merging()
    first = show(m, 0, (1, HERE, photos(0, 10, 1)))
    assert m.frame(20_000, [Seen(2, FAR, photos(0, 10, 2)[0])])[0].person == 2
    m = merging()
    show(m, 0, (1, HERE, photos(0, 10, 1)))
    assert show(m, 20_000, (2, FAR, photos(0, 10, 2))) == first == [1]
    assert [(a, b) for _, a, b, _ in m.merges] == [(2, 1)] and m.crowd.samples[0] == 20
    assert show(m, 21_000, (2, FAR, photos(0, 3, 3))) == [1]


def test_what_is_not_merged():
    m = merging()
    show(m, 0, (1, HERE, photos(0, 10, 1)))
    assert show(m, 20_000, (2, FAR, photos(1, 10, 2))) == [2] and not m.merges
    m = merging(retire_ms=10_000)
    show(m, 0, (1, HERE, photos(0, 10, 1)))
    assert show(m, 30_000, (2, FAR, photos(0, 10, 2))) == [2] and not m.merges
    m = merging()
    show(m, 0, (1, HERE, photos(0, 10, 1)), (2, FAR, photos(0, 10, 2)))
    show(m, 1000, (1, HERE, photos(0, 10, 3)))
    assert not m.merges, "seen together"
    m = merging(tentative_ms=5000)
    show(m, 0, (1, HERE, photos(0, 10, 1)))
    assert show(m, 20_000, (2, FAR, photos(0, 10, 2))) == [2] and not m.merges, "tentative persons neither merge nor are merged into"


def test_short_overlap():
    for overlap, merged in ((0, False), (600, True)):
        m = merging(merge_overlap=overlap)
        show(m, 0, (1, HERE, photos(0, 10, 1)))
        show(m, 1000, (1, HERE, photos(0, 2, 4)), (2, FAR, photos(0, 2, 5)))
        show(m, 1200, (2, FAR, photos(0, 8, 6)))
        assert bool(m.merges) == merged


def test_merges_cascade():
    """A merge changes the mean that the next person is compared with, and chains lead to one root."""
    m = merging(merge_at=(10, 20))
    for k in range(4):
        show(m, 15_000 * k, (k, (300.0 * k, 0.0, 300.0 * k + 40, 100.0), photos(0, 10, 10 + k)))
    assert [(a, b) for _, a, b, _ in m.merges] == [(2, 1), (3, 1), (4, 1)]
    similar = [s for *_, s in m.merges]
    assert similar[1] > similar[0] and similar[2] > similar[0], "a merged mean is closer to the next one"
    alone = merging(merge_at=(10, 20))
    show(alone, 0, (0, HERE, photos(0, 10, 10)))
    show(alone, 15_000, (3, FAR, photos(0, 10, 13)))
    assert alone.merges[0][3] < similar[-1]


def test_merge_rows_like_the_machine(spark):
    rows, m = [], merging()
    for k in range(3):
        for i, v in enumerate(photos(k % 2, 10, 20 + k)):
            rows.append(("r", 15_000 * k + 100 * i, k, (300.0 * k, 0.0, 300.0 * k + 40, 100.0), [float(x) for x in v]))
            m.frame(15_000 * k + 100 * i, [Seen(k, rows[-1][3], v)])
    d = spark.createDataFrame(rows, "run string, ms long, track long, box struct<x1:double,y1:double,x2:double,y2:double>, vec array<double>")
    got = people.merged_people(d, ["run"], "ms", "track", "box", "vec", merge_at=(10,), match=0.65, stitch=0.65, retire_ms=60_000, every=100)
    assert [(r.ms, r.from_id, r.into_id) for r in got.collect()] == [x[:3] for x in m.merges] == [(30_900, 3, 1)]
