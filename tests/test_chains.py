"""Scripted cases of links, leases, slot episodes and calibration."""

import random

import numpy as np
import pytest

from storeflow.operators import chains as ch
from storeflow.operators import machines as mc
from storeflow.operators import matching as mt
from storeflow.operators.chains import Lease, LinkChain, SlotEpisodes


def partners(chain, *windows, start=0):
    return [{a: b for a, b, *_ in chain.window(n, w)} for n, w in enumerate(windows, start)]


def test_best_total_and_floor():
    assert partners(LinkChain(), [(1, 11, 0.9, None), (1, 12, 0.8, None), (2, 11, 0.85, None), (2, 12, 0.1, None)]) == [{1: 12, 2: 11}]
    assert partners(LinkChain(), [(1, 11, 0.4, None), (2, 11, None, 0.99)]) == [{}], "no pair without a position, or under the floor"


def test_the_pair_before_gets_a_bonus():
    steady, wobble = [(1, 2, 0.90, None), (1, 5, 0.75, None)], [(1, 2, 0.90, None), (1, 5, 0.96, None)]
    assert partners(LinkChain(), steady, wobble, steady) == [{1: 2}] * 3
    assert partners(LinkChain(keep=0.0), steady, wobble) == [{1: 2}, {1: 5}]
    link = LinkChain()
    link.window(0, steady)
    assert link.window(1, steady)[0][2] == pytest.approx(1.0)


def test_the_bonus_after_an_absence():
    first, back = [(1, 2, 1.0, None)], [(1, 1, 0.95, None), (1, 2, 0.90, None)]
    for recent, far in ((False, 2), (True, 1)):
        chain = LinkChain(recent=recent)
        partners(chain, first)
        assert partners(chain, back, start=8) == [{1: far}]
    chain = LinkChain()
    assert partners(chain, first, [(1, 2, 0.1, None)], back) == [{1: 2}, {}, {1: 1}], "who was in view without a pair has lost it"


def test_a_single_candidate_is_believed_by_appearance():
    assert partners(LinkChain(), [(1, 11, 0.0, 0.9)]) == [{1: 11}]
    assert partners(LinkChain(), [(1, 11, 0.0, 0.9), (1, 12, 0.0, 0.2)]) == [{}]
    assert partners(LinkChain(), [(1, 11, 0.0, 0.9), (1, 12, None, 0.2)]) == [{1: 11}], "who has no position is no rival"
    assert partners(LinkChain(), [(1, 11, 0.0, 0.84)]) == [{}] and partners(LinkChain(solo=0), [(1, 11, 0.0, 0.99)]) == [{}]


def test_link_rows(spark):
    rng = random.Random(2)
    rows = [(r, n, a, b, rng.choice([None, rng.random()]), rng.choice([None, rng.random()])) for r in range(3) for n in range(12) for a in (1, 2, 3) for b in (7, 8) if rng.random() < 0.8]
    got = ch.link_windows(spark.createDataFrame(rows, "run long, win long, near long, far long, p double, a double").repartition(3), ["run"], "win", "near", "far", "p", "a").collect()
    want = []
    for r in range(3):
        chain = LinkChain()
        for n in range(12):
            w = sorted((x[2:] for x in rows if x[:2] == (r, n)), key=lambda x: x[:2])
            want += [(r, n, *x) for x in chain.window(n, w)] if w else []
    assert sorted(tuple(r) for r in got) == sorted(want)


def reports(m, *messages):
    return [(kind, device, owner) for t, device, counts in messages for _, kind, device, owner in m.message(t, device, counts)]


def test_lane_lease():
    m = Lease(3000)
    assert reports(m, (0, 1, True), (1000, 2, True), (1500, 2, True)) == [("ADMITTED", 1, 1), ("LANE_CONFLICT", 2, 1)], "a conflict is reported once"
    assert reports(m, (2000, 1, False), (5000, 2, True)) == [], "any message keeps the lease"
    assert reports(m, (5001, 2, True), (5100, 1, True), (5200, 1, True)) == [("LANE_OWNER_CHANGED", 2, 1), ("ADMITTED", 2, 2), ("LANE_CONFLICT", 1, 2)]
    assert reports(Lease(3000), (0, 1, False), (10, 2, True)) == [("ADMITTED", 2, 2)], "only measuring takes a lane"
    m = Lease(3000)
    reports(m, (0, 1, True))
    assert reports(m, (60_000, 1, True)) == [("ADMITTED", 1, 1)], "a silent owner that comes back first stays"


def test_lease_rows(spark):
    rows = [(0, 1, 0, 0, True), (1, 1, 2500, 1, True), (0, 2, 3500, 2, True), (0, 2, 9000, 3, True), (1, 1, 9500, 4, True), (None, 3, 0, 5, False)]
    got = ch.lane_leases(spark.createDataFrame(rows, "lane long, device long, t long, i long, m boolean"), "lane", "device", "t", "i", "m", 3000).collect()
    want = [(0, 0, "ADMITTED", 1, 1), (0, 3500, "LANE_CONFLICT", 2, 1), (0, 9000, "LANE_OWNER_CHANGED", 2, 1), (0, 9000, "ADMITTED", 2, 2), (1, 2500, "ADMITTED", 1, 1), (1, 9500, "ADMITTED", 1, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


RNG = np.random.default_rng(4)
FULL, BARE, OTHER = (RNG.normal(size=64) for _ in range(3))


class Shelf:
    def __init__(self, **params):
        self.m, self.said = SlotEpisodes(**params), []

    def run(self, start, seconds, **slots):
        for i in range(round(seconds * 10)):
            self.said += self.m.moment(round(start * 1000) + 100 * i, [(n, *x) for n, x in sorted(slots.items())])
        return self


def test_slot_episodes():
    seen = {"b": (False, OTHER, 5.0), "c": (False, BARE, 5.0)}
    s = Shelf().run(0, 1, a=(False, FULL, 10.0), **seen).run(1, 1, a=(True, OTHER, 1.0), **seen).run(2, 1, a=(False, BARE, 6.0), **seen)
    (slot, start, end, state, ratio, baseline, changed, direction, edges), = s.said
    assert (slot, start, end, state, changed, direction) == ("a", 1000, 2600, "compared", True, "DECREASED") and ratio > 0.5 and baseline == 0 and edges == 0.6
    same = Shelf().run(0, 1, a=(False, FULL, 10.0), **seen).run(1, 1, a=(True, OTHER, 1.0), **seen).run(2, 1, a=(False, FULL * 3 + 1, 10.0), **seen).said
    assert [(x[3], x[6], x[7]) for x in same] == [("compared", False, None)], "brighter is not changed"
    for e, want in ((12.0, "INCREASED"), (10.0, "CHANGED")):
        assert Shelf().run(0, 1, a=(False, FULL, 10.0)).run(1, 1, a=(True, OTHER, 1.0)).run(2, 1, a=(False, BARE, e)).said[0][7] == want
    assert Shelf(empty={"a": BARE}).run(0, 1, a=(False, FULL, 10.0)).run(1, 1, a=(True, OTHER, 1.0)).run(2, 1, a=(False, BARE, 20.0)).said[0][7] == "DECREASED", "the empty look decides"


def test_light_changes_every_slot():
    """What the other slots show at the moment is not the slot's own change."""
    before = {n: (False, FULL, 10.0) for n in "abc"}
    during = {"a": (True, OTHER, 1.0), "b": (True, FULL, 10.0), "c": (True, FULL, 10.0)}
    after = {n: (n != "a", BARE, 10.0) for n in "abc"}
    said = Shelf().run(0, 1, **before).run(1, 1, **during).run(2, 1, **after).said
    assert [(x[0], x[3], x[6]) for x in said] == [("a", "compared", False)] and said[0][5] > 0.5


def test_first_look_and_end():
    s = Shelf().run(0, 1, a=(True, OTHER, 1.0)).run(1, 1, a=(False, FULL, 9.0))
    assert [x[:4] for x in s.said] == [("a", 0, 1600, "no_reference")]
    s.run(2, 1, a=(True, OTHER, 1.0)).run(3, 0.4, a=(False, FULL, 9.0))
    assert [x[:4] for x in s.m.finish(3400)] == [("a", 2000, 3400, "unfinished")]
    short = Shelf().run(0, 1, a=(False, FULL, 9.0)).run(1, 0.3, a=(True, OTHER, 1.0)).run(1.3, 0.3, a=(False, FULL, 9.0)).run(1.6, 0.3, a=(True, OTHER, 1.0)).run(1.9, 1, a=(False, FULL, 9.0))
    assert [(x[1], x[2]) for x in short.said] == [(1000, 2500)], "one episode until it has been seen long enough"


def capture(level, seconds=10, noise=3.0, seed=1, moving=0):
    rng, c = random.Random(seed), mc.LevelCapture()
    for i in range(seconds * 10):
        c.feed(1000 + 100 * i, level + rng.gauss(0, noise) + (40 * (i % 4 - 1.5) if 100 * i < moving else 0))
    return c


def test_capture():
    m, low, high, n = capture(345).result
    assert abs(m - 345) < 2 and low < m < high and n >= 15
    assert capture(345, seconds=4, moving=3000).begun is None and capture(345, seconds=12, moving=3000).result is not None
    c = mc.LevelCapture()
    for i in range(40):
        c.feed(100 * i, 345)
    assert c.begun is not None
    for i in range(40, 50):
        c.feed(100 * i, 300)
    assert c.begun is None and c.result is None, "disturbed"
    c = mc.LevelCapture()
    for t in [*range(0, 6000, 100), *range(8000, 12000, 100)]:
        c.feed(t, 345)
    assert c.result is None, "a gap begins anew"


def test_settings():
    r = mc.lane_settings(*(capture(v, seed=k).result[:3] for k, v in enumerate((345, 328, 263), 1)))
    assert r["error"] is None and abs(r["thickness"] - 65) < 2 and abs(r["gap"] - 17) < 3 and len(r["refs"]) >= 5 and len(r["refs"]) == len(r["tolerances"])
    assert r["refs"] == sorted(r["refs"], reverse=True) and r["tolerances"][0] + r["tolerances"][1] <= r["gap"] - r["hysteresis"]
    assert mc.lane_settings((345, 344, 346), (344, 343, 345), (279, 278, 280))["error"] == "pusher did not move"
    assert mc.lane_settings((345, 344, 346), (328, 327, 329), (326, 325, 327))["error"] == "second item"
    tight = mc.lane_settings((339, 333, 345), (332, 326, 338), (266, 264, 268))
    assert tight["warnings"][0] == "overlap" and "very narrow" in tight["warnings"] and tight["median_of"] == 7


def test_calibrated_lanes(spark):
    rows = [(lane, k, 100 * i, v + (i % 3 - 1)) for lane in (1, None) for k, v in enumerate((345.0, 328.0, 263.0)) for i in range(120)] + [(2, 0, 0, 345.0)]
    c = mc.level_calibration(spark.createDataFrame(rows, "lane long, level int, t long, mm double").repartition(3), ["lane", "level"], "t", "mm")
    got = {r.lane: r for r in mc.calibrated_lanes(c, ["lane"]).collect()}
    assert got[1].refs[:3] == got[None].refs[:3] == [345.0, 328.0, 263.0] and got[2].error == "levels missing"


def test_units_of_large_quantities(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "pair long, lane long, direction string, id long, at double, qty int")
    got = mt.staged_compare(rows((1, 1, "TAKE", 1, 0.0, 40), (1, 1, "TAKE", 2, 50.0, 2)), rows((1, 1, "TAKE", 9, 1.0, 1)), "pair", "lane", "direction", 5.0, 5.0).collect()
    assert len(got) == 42 and len({(r.label_id, r.label_unit) for r in got}) == 42 and sum(r.kind == "matched" for r in got) == 1
    assert {r.label_id for r in got} == {1, 2} and [r.sensor_id for r in got if r.kind == "matched"] == [9]
