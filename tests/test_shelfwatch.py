"""Scripted visits to a shelf."""

import numpy as np

from storeflow.operators import shelfwatch as sw
from storeflow.operators.shelfwatch import Items, ShelfWatch


def item(label, x, y=100.0, score=0.9, size=40.0):
    return (label, x - size / 2, y - size / 2, x + size / 2, y + size / 2, score)


ROW = [item("bottle", 50), item("spray", 100), item("pump", 150), item("jug", 200)]
TEN = 100  # ms a frame


class Shelf:
    def __init__(self, **params):
        self.m, self.visits = ShelfWatch(**params), []

    def run(self, start, seconds, items, people=()):
        for i in range(round(seconds * 10)):
            self.visits += self.m.frame(round(start * 1000) + TEN * i, None if items is None else Items.of(items(i) if callable(items) else items), list(people))
        return self

    @property
    def changes(self):
        return [v for v in self.visits if v[3] or v[4]]


def test_places():
    assert sw.places(Items.of([item("a", 200, 20), item("b", 20, 22), item("c", 100, 130), item("d", 20, 128)])) == ["1.2 a", "1.1 b", "2.2 c", "2.1 d"]
    assert sw.places(Items.of([])) == []


def test_taken_behind_a_person():
    s = Shelf().run(0, 2, ROW).run(2, 3, ROW, [7]).run(5, 3, [ROW[0], ROW[2], ROW[3]])
    assert s.visits == [(2000, 7000, [7], ["1.2 spray"], [])]


def test_browsing_is_a_visit_without_change():
    s = Shelf().run(0, 2, ROW).run(2, 3, ROW, [7]).run(5, 3, ROW)
    assert s.visits == [(2000, 6000, [7], [], [])]


def test_returned():
    less = [ROW[0], ROW[2], ROW[3]]
    assert Shelf().run(0, 2, less).run(2, 2, less, [7]).run(4, 3, ROW).changes == [(2000, 6000, [7], [], ["1.2 spray"])]


def test_two_people_and_none():
    assert Shelf().run(0, 2, ROW).run(2, 2, ROW, [7, 8]).run(4, 3, ROW[1:]).changes[0][2] == [7, 8]
    alone = Shelf().run(0, 2, ROW).run(2, 4, ROW[1:]).changes
    assert len(alone) == 1 and alone[0][2] == [] and alone[0][3] == ["1.1 bottle"]


def test_flicker():
    assert Shelf().run(0, 2, ROW).run(2, 4, lambda i: ROW if i % 5 else ROW[1:]).changes == []
    assert Shelf().run(0, 2, ROW).run(2, 0.8, ROW[1:]).run(2.8, 3, ROW).changes == []
    assert Shelf().run(0, 2, ROW).run(2, 4, [*ROW[:3], item("toilet", 202)]).changes == [], "another name in the same place"


def test_a_faint_item_is_still_there():
    dim = [item("bottle", 50, score=0.12), *ROW[1:]]
    first = [item("bottle", 50, score=0.16), *ROW[1:]]
    s = Shelf(floor=0.15).run(0, 2, first).run(2, 2, first, [7]).run(4, 3, dim)
    assert s.visits == [(2000, 5000, [7], [], [])]
    assert s.run(7, 2, dim, [8]).run(9, 3, ROW[1:]).changes[0][3] == ["1.1 bottle"], "and is missed when it goes"
    ghost = [item("bottle", 50, score=0.05), *ROW[1:]]
    assert len(Shelf(floor=0.15).run(0, 2, first).run(2, 2, first, [7]).run(4, 3, ghost).changes) == 1, "too faint to be the same"
    s = Shelf(floor=0.15).run(0, 2, dim).run(2, 2, dim, [7]).run(4, 3, first)
    assert s.changes == [], "nor does it come when it was there faintly"


def test_not_searched_and_the_difference_must_hold():
    s = Shelf().run(0, 2, ROW).run(2, 2, None, [7]).run(4, 1, None).run(5, 0.5, ROW[1:]).run(5.5, 0.4, ROW[2:])
    assert s.visits == []
    assert [v[3] for v in s.run(5.9, 3, ROW[2:]).visits] == [["1.1 bottle"], ["1.1 spray"]], "what three of ten frames still show has not left"


def test_consensus():
    frames = [Items.of([item("a", 50 + 5 * i, score=0.5 + i / 10)]) for i in range(5)]
    got = sw.consensus(frames)
    assert got.label == ["a"] and got.box[0, 0] == 40 and abs(got.score[0] - 0.7) < 1e-9, "the last member leads the cluster"
    assert sw.consensus([*frames, Items.of([item("b", 300)])]).label == ["a"]
    assert sw.consensus([Items.of([item("b", 50)]), Items.of([item("a", 50)])]).label == ["b"], "of equals the first"
    assert sw.consensus([Items.of([item("a", 50, score=0.1)])], floor=0.15).label == []
    assert sw.consensus([]).label == []


def test_weak_presence():
    box = np.array([0.0, 0.0, 40.0, 40.0])
    near, beside = Items.of([item("x", 25, 25, 0.5)]), Items.of([item("x", 60, 20, 0.9)])
    assert sw.weakly_present(box, 0.9, [near, beside, beside]) and not sw.weakly_present(box, 0.9, [near, beside, beside, beside])
    assert not sw.weakly_present(box, 0.9, [Items.of([item("x", 25, 25, 0.4)])]) and not sw.weakly_present(box, 0.9, [])


def test_rows(spark):
    s, rows = Shelf(), []
    for t in range(0, 9000, TEN):
        items = None if t % 700 == 0 else ROW if t < 3000 else ROW[:2] if t > 5000 else ROW[1:]
        who = [7] if 2500 < t < 3500 else [8, 9] if 5000 < t < 5800 else []
        rows.append(("a", t, t, None if items is None else items, who))
        s.visits += s.m.frame(t, None if items is None else Items.of(items), who)
    schema = "shelf string, t long, i long, items array<struct<label:string,x1:double,y1:double,x2:double,y2:double,score:double>>, blockers array<long>"
    df = spark.createDataFrame([*rows, *[("b", *r[1:]) for r in rows], (None, 0, 0, None, None)], schema).repartition(4)
    got = sorted((r.shelf or "", *map(tuple, [r[1:3]]), r.people, r.removed, r.added) for r in sw.watch_shelves(df, ["shelf"], "t", "i").collect())
    assert got == [(k, v[:2], *map(list, v[2:])) for k in "ab" for v in s.visits] and len(s.changes) == 1
