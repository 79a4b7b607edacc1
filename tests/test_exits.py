"""The exit machine and payment by dwelling: scripted visits, batch, and streams that equal the batch."""

import json
import random

import pytest

from storeflow.operators import exits
from storeflow.operators.exits import ExitDesk, Till

INSIDE, EXIT, STREET = (False, False), (True, False), (False, True)


class Visit:
    """Sightings every 100 ms, and what the machine says."""

    def __init__(self, **params):
        self.desk, self.said = ExitDesk(**params), []

    def stay(self, where, start, seconds, look=None, checked=False):
        for i in range(round(seconds * 10)):
            self.said += self.desk.sighting(round(start * 1000) + 100 * i, *where, look=look, checked=checked)
        return self

    def took(self, at, n=1):
        self.said += self.desk.ledger(round(at * 1000), n, 0)
        return self

    def paid(self, at, n=1):
        self.said += self.desk.ledger(round(at * 1000), 0, n)
        return self

    def wait(self, at):
        self.said += self.desk.until(round(at * 1000), included=True)
        return self

    @property
    def levels(self):
        return [(cause, level) for _, level, cause, *_ in self.said]


W, H, R, C = "WARNING", "HIGH_RISK", "REVIEW", "CLEAR"


def test_warning_then_verdict():
    v = Visit().stay(INSIDE, 1, 0.1).took(1.0).stay(EXIT, 5, 1).wait(10)
    assert v.levels == [("approach", W), ("vanished", H)]
    assert v.said[0][0] == 5500 and v.said[1][0] == 5900 + 3000 and v.said[1][5] == 1


def test_standing_at_the_exit_only_warns():
    assert Visit().stay(INSIDE, 1, 0.1).took(1).stay(EXIT, 5, 10).levels == [("approach", W)]


def test_paid_before_leaving():
    v = Visit().stay(INSIDE, 1, 0.1).took(1).stay(INSIDE, 3, 1).paid(4).stay(INSIDE, 4, 1).stay(EXIT, 6, 1).wait(12)
    assert v.levels == [("vanished", C)]


def test_nothing_taken():
    assert Visit().stay(EXIT, 0, 1).wait(9).levels == [("vanished", C)]


def test_fewer_paid_is_review_without_warning():
    assert Visit().stay(INSIDE, 1, 0.1).took(1, 2).paid(2).stay(EXIT, 6, 1).wait(11).levels == [("vanished", R)]


def test_brushing_past_and_coming_back():
    assert Visit().stay(INSIDE, 1, 0.1).took(1).stay(EXIT, 2, 0.3).stay(INSIDE, 2.3, 5).wait(20).levels == []


def test_one_warning_a_visit_and_a_new_one_after_rearming():
    v = Visit().stay(INSIDE, 1, 0.1).took(1).stay(EXIT, 2, 3).stay(INSIDE, 5, 0.3).stay(EXIT, 5.3, 1)
    assert v.levels == [("approach", W)]
    assert v.stay(INSIDE, 6.3, 2.5).stay(EXIT, 8.8, 1).levels == [("approach", W)] * 2


def test_warned_then_paid():
    v = Visit().stay(INSIDE, 0.5, 0.1).took(0.5).stay(EXIT, 1, 1).stay(INSIDE, 3, 2).paid(5).stay(INSIDE, 5, 1).stay(EXIT, 7, 1).wait(12)
    assert v.levels == [("approach", W), ("vanished", C)]


def test_vanishing_at_once_and_away_from_the_exit():
    assert Visit().stay(INSIDE, 1, 0.1).took(1).stay(EXIT, 2, 0.3).wait(7).levels == [("vanished", H)]
    assert Visit().stay(INSIDE, 1, 0.1).took(1).stay(INSIDE, 2, 0.3).wait(9).levels == []
    assert Visit().stay(INSIDE, 1, 0.1).took(1).stay(EXIT, 2, 1).stay(INSIDE, 3, 0.5).wait(9).levels == [("approach", W), ("vanished", H)]
    assert Visit().stay(INSIDE, 1, 0.1).took(1).stay(EXIT, 2, 1).stay(INSIDE, 3, 2.5).wait(19).levels == [("approach", W)]


def test_items_recorded_after_vanishing_count():
    assert Visit().stay(EXIT, 2, 0.3).took(2.8).wait(9).levels == [("vanished", H)]
    late = Visit().stay(EXIT, 2, 0.3).took(5.2).wait(9)
    assert late.levels == [("vanished", H)], "an item at the very deadline counts"
    assert Visit().stay(EXIT, 2, 0.3).took(5.3).wait(9).levels == [("vanished", C)]


def test_short_occlusion():
    assert Visit().stay(INSIDE, 1, 0.1).took(1).stay(EXIT, 2, 1).stay(EXIT, 5, 1).levels == [("approach", W)]


def test_retracted_and_judged_again():
    v = Visit().stay(EXIT, 1, 0.3).wait(6).stay(INSIDE, 6, 0.1).took(6.05).stay(EXIT, 7, 1).wait(12)
    assert v.levels == [("vanished", C), ("retracted", None), ("approach", W), ("vanished", H)]


def test_likeness():
    low = Visit().stay(INSIDE, 1, 0.2, look=0.55).took(1.2).stay(EXIT, 5, 1).wait(10)
    assert low.levels == [("approach", W), ("vanished", R)] and low.said[1][6] == "identity uncertain"
    high = Visit().stay(INSIDE, 1, 0.2, look=0.93).took(1.2).stay(EXIT, 5, 1, look=0.1).wait(10)
    assert high.levels == [("approach", W), ("vanished", H)] and high.said[1][6] is None
    unknown = Visit().stay(INSIDE, 1, 0.2, checked=True).took(1.2).stay(EXIT, 5, 1, checked=True).wait(10)
    assert unknown.levels[1] == ("vanished", H) and unknown.said[1][6] == "identity not checked"
    best = Visit().stay(INSIDE, 1, 0.1, look=0.9).stay(INSIDE, 1.1, 2, look=0.6).took(3.2).stay(EXIT, 5, 1).wait(10)
    assert best.levels[1] == ("vanished", H), "the best of the window counts"
    old = Visit().stay(INSIDE, 1, 0.1, look=0.9).stay(INSIDE, 1.1, 7, look=0.6).took(8.2).stay(EXIT, 9, 1).wait(14)
    assert old.levels[1] == ("vanished", R), "but not what is older"


def test_street():
    v = Visit().stay(INSIDE, 1, 0.1).took(1).stay(EXIT, 2, 1).stay(STREET, 3, 1).wait(20)
    assert v.levels == [("approach", W), ("outside", H)]
    assert Visit().stay(STREET, 0, 5).wait(20).levels == [], "who never came in is not judged"


def test_settling_inside():
    door = (False, False, False)
    assert Visit(settle=1000).stay((False, False, True), 0, 0.5).stay(door, 0.5, 0.5).stay(EXIT + (False,), 1, 0.3).wait(9).levels == []
    assert Visit(settle=1000).stay((False, False, True), 0, 1.2).took(1.2).stay(EXIT + (False,), 1.3, 0.3).wait(9).levels == [("vanished", H)]


def test_grace_bridges_a_gap_in_a_stay():
    steps = [(EXIT, 2, 0.3), (INSIDE, 2.3, 0.2), (EXIT, 2.5, 0.2)]
    for grace, want in ((0, []), (500, [("approach", W)])):
        v = Visit(grace=grace).stay(INSIDE, 1, 0.1).took(1)
        for s in steps:
            v.stay(*s)
        assert v.levels == want


def test_hold():
    held = Visit(hold=10_000).stay(INSIDE, 1, 0.1).took(1).stay(EXIT, 5, 1).wait(9)
    assert held.levels == [("approach", W), ("vanished", W)]
    assert held.wait(30).levels[2:] == [("released", H)] and held.said[2][0] == 5900 + 3000 + 10_000
    paid = Visit(hold=10_000).stay(INSIDE, 1, 0.1).took(1).stay(EXIT, 5, 1).wait(9).paid(12).wait(30)
    assert paid.levels[2:] == [("released", C)]
    back = Visit(hold=10_000).stay(INSIDE, 1, 0.1).took(1).stay(EXIT, 5, 1).wait(9).stay(INSIDE, 12, 1).wait(40)
    assert back.levels[2:] == [("retracted", None)]


def test_end_of_recording():
    leave = lambda **k: Visit(**k).stay(INSIDE, 1, 0.1).took(1).stay(EXIT, 5, 0.3)
    assert [x[1:3] for x in leave().desk.finish(6500)] == [(H, "end")]
    assert leave().desk.finish(5300) == [], "still in view"
    v = leave()
    v.desk.edge = True
    assert [x[1:3] for x in v.desk.finish(5300)] == [(H, "end")]
    assert [x[1:3] for x in leave(hold=10_000).desk.finish(6500)] == [(H, "end")]
    held = leave(hold=10_000).wait(9)
    assert [x[1:3] for x in held.desk.finish(10_000)] == [(H, "released")]
    assert Visit().stay(INSIDE, 1, 1).desk.finish(9000) == []


def till(steps, **params):
    t, out = Till(**params), []
    for at, checkout, overlap, took in steps:
        out += t.ledger(at, took, 0) + t.sighting(at, checkout, overlap)
    return out


def test_dwelling_pays_cancels_and_pays_again():
    assert till([(0, False, 0, 2), (1000, True, 0, 0), (2400, True, 0, 0), (2500, True, 0, 0), (2600, True, 0, 0)]) == [(2500, 2, "dwell")]
    assert till([(0, False, 0, 2), (1000, True, 0, 0), (2000, False, 0, 0), (2100, True, 0, 0), (3000, True, 0, 0)]) == [], "a stay must be unbroken"
    steps = [(0, False, 0, 1), (1000, True, 0, 0), (2500, True, 0, 0), (3000, False, 0.4, 0), (3500, False, 0.5, 0), (3600, False, 0.9, 1), (5000, True, 0, 0), (6500, True, 0, 0)]
    assert till(steps) == [(2500, 1, "dwell"), (3500, -1, "cancel"), (6500, 2, "dwell")]
    assert till([(0, True, 0, 1), (1500, True, 0, 0), (1600, True, 0, 2)]) == [(1500, 1, "dwell"), (1600, 2, "more")]
    assert till([(0, False, 0, 1), (1000, True, 0, 0), (1500, False, 0, 0), (1900, True, 0, 0), (2500, True, 0, 0)], grace=600) == [(2500, 1, "dwell")]
    assert till([(0, True, 0.9, 1), (1500, True, 0.9, 0)]) == [(1500, 1, "dwell")], "no cancelling while standing there"


def rows(seed=3, people=12, n=160):
    rng, out = random.Random(seed), []
    for p in range(people):
        t = rng.randrange(3000)
        for i in range(n if p else 4 * n):
            t += rng.choice([0, 100, 100, 100, 400, 2500, 5000])
            where = rng.choice([INSIDE, INSIDE, EXIT, EXIT, STREET])
            seen = rng.random() < 0.85
            out.append((None if p == 3 else p, t, i, *((*where, None, rng.choice([None, 0.5, 0.9]), False) if seen else (None,) * 5), rng.choice([0, 0, 0, 1]), rng.choice([0, 0, 0, 0, 1]) * (p % 3 == 0), (rng.random() < 0.4) if seen else None, rng.random() if seen else None))
    return out


SCHEMA = "person long, t long, i long, at_exit boolean, outside boolean, inside boolean, look double, edge boolean, taken long, paid long, checkout boolean, overlap double"


def plain(data, columns, make, step, close):
    by, out = {}, []
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        m = by.setdefault(r[0], make())
        out += [(r[0], *x) for x in step(m, r[1], *[r[SCHEMA.split(", ").index(next(f for f in SCHEMA.split(", ") if f.split()[0] == c))] for c in columns])]
    for p, m in by.items():
        out += [(p, *x) for x in close(m)]
    return sorted(out, key=str)


def test_batch(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    end = max(r[1] for r in data)
    want = plain(data, exits.EXIT_COLUMNS, lambda: ExitDesk(hold=4000), exits.desk_step, lambda m: m.finish(end))
    assert {x[3] for x in want} == {"approach", "outside", "vanished", "retracted", "released"} | ({"end"} & {x[3] for x in want})
    assert sorted((tuple(r) for r in exits.exit_events(df, "person", "t", "i", end=end, hold=4000).collect()), key=str) == want
    want = plain(data, exits.DWELL_COLUMNS, Till, exits.till_step, lambda m: [])
    assert {x[3] for x in want} == {"dwell", "more", "cancel"}
    assert sorted((tuple(r) for r in exits.dwell_events(df, "person", "t", "i").collect()), key=str) == want
    assert exits.exit_events(df.where("false"), "person", "t", "i").count() == 0


@pytest.fixture
def fed(spark, tmp_path):
    """Rows as a stream of files in which later rows come up to 4 s before earlier ones, and a last row that moves the clock."""
    from storeflow.streaming import timers

    timers.use_rocksdb(spark)
    data = [r for r in rows(5, 8, 60) if r[0] is not None]
    rng = random.Random(1)
    sent = sorted(data, key=lambda r: r[1] + rng.randrange(4000))
    at = [0, *sorted(rng.sample(range(1, len(sent)), 4)), len(sent)]
    for n, (a, b) in enumerate(zip(at, at[1:])):
        spark.createDataFrame(sent[a:b], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/parts/{n}")
    clock = [(99, max(r[1] for r in data) + 100_000, 0, *(None,) * 5, 0, 0, None, None)]
    spark.createDataFrame(clock, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/parts/8")
    spark.createDataFrame([(98, clock[0][1] + 1, *clock[0][2:])], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/parts/9")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/parts/*")
    return data, stream, tmp_path


def pull(stream, tmp_path, name):
    from storeflow.streaming.twins import drain

    drain(stream, f"{tmp_path}/{name}", f"{tmp_path}/{name}-checkpoint")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{tmp_path}/{name}").collect()


def test_streams_equal_batch(fed):
    from storeflow.streaming import timers

    data, stream, tmp = fed
    last = max(r[1] for r in data) + 90_000
    want = plain(data, exits.EXIT_COLUMNS, lambda: ExitDesk(hold=4000), exits.desk_step, lambda m: m.until(last))
    assert sorted((tuple(r) for r in pull(timers.exit_stream(stream, "person", "t", "i", 5000, hold=4000), tmp, "exits")), key=str) == want
    assert {"vanished", "released", "retracted"} <= {x[3] for x in want}
    want = plain(data, exits.DWELL_COLUMNS, Till, exits.till_step, lambda m: [])
    assert sorted((tuple(r) for r in pull(timers.dwell_stream(stream, "person", "t", "i", 5000, forget=80_000), tmp, "dwell")), key=str) == want


def test_rows_are_released_in_order(fed):
    from storeflow.streaming import timers

    data, stream, tmp = fed
    got = pull(timers.in_order(stream.select("person", "t", "i", "overlap"), "person", "t", "i", 5000), tmp, "ordered")
    assert sorted(map(str, (tuple(r) for r in got if r.person < 90))) == sorted(str((r[0], r[1], r[2], r[11])) for r in data)


def test_state_survives_text():
    v = Visit().stay(INSIDE, 1, 0.2, look=0.8).took(1.2).stay(EXIT, 2, 0.3)
    again = exits.restored(ExitDesk, json.loads(json.dumps(exits.saved(v.desk))))
    assert again == v.desk and again.until(90_000) == v.desk.until(90_000)
