"""Scripted cases of the rules, and batch against stream."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from storeflow.functions import geometry as g
from storeflow.functions import text as tx
from storeflow.operators import datasets, joins, ledger, machines, matching, windows
from storeflow.sources import logs
from storeflow.streaming import twins


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_hysteresis():
    m = machines.Hysteresis(threshold=0.5, window=5, min_hits=3, end_below=2, cooldown=100)
    scores = [0.9, 0.1, 0.8, 0.7, 0.2, 0.9, 0.1, 0.1, 0.9, 0.9, 0.9]
    out = [m.step(10 * i, s) for i, s in enumerate(scores)]
    assert [e for e in out if e] == [{"start_ms": 30, "end_ms": 70, "peak": 0.9, "hits": 4}]
    assert m.active is None  # still cooling, though the window fills
    assert m.step(200, 0.9) is None and m.active["start_ms"] == 200


def run_lane(samples, **kw):
    m = machines.LaneCounter((160.0, 120.0, 80.0, 40.0), tolerance=15, stable_ms=400, min_samples=3, max_gap=600, resync_gap=5000, error_after=3, **kw)
    return [(e["event"], e["before"], e["after"]) for t, v in samples for e in m.step(t, v)]


def steady(t0, mm, n=12, step=100):
    return [(t0 + i * step, mm) for i in range(n)]


def test_lane_counter():
    assert run_lane(steady(0, 80)) == [("INIT", None, 2)]
    assert run_lane(steady(0, 80) + steady(1200, 120) + steady(2400, 40)) == [("INIT", None, 2), ("REMOVE", 2, 1), ("ADD", 1, 3)]
    assert run_lane(steady(0, 80) + steady(9000, 120)) == [("INIT", None, 2), ("RESYNC", 2, 1)]  # never a movement after a gap
    assert run_lane(steady(0, 80) + [(1200 + 100 * i, None) for i in range(4)] + steady(1600, 80)) == [("INIT", None, 2), ("SENSOR_ERROR", 2, 2), ("RECOVERED", 2, 2), ("RESYNC", 2, 2)]
    assert run_lane(steady(0, 100)) == []  # between two references
    assert run_lane(steady(0, 80) + [(1150, None)] + steady(1200, 80)) == [("INIT", None, 2)]  # one bad sample is no error


def test_lane_counter_special_samples():
    lane = lambda **kw: machines.LaneCounter((160.0, 120.0, 80.0, 40.0), **{"tolerance": 15, "stable_ms": 400, "min_samples": 3, "error_after": 3, **kw})
    said = lambda m, samples: [(e["event"], e["before"], e["after"], e["reason"]) for s in samples for e in m.step(*s)]
    start = [("INIT", None, 2, None)]
    hard = said(lane(), [*steady(0, 80), (1200, None, False, "MUX_ERROR"), *steady(1300, 120)])
    assert hard == start + [("SENSOR_ERROR", 2, 2, "MUX_ERROR"), ("RECOVERED", 2, 2, "MUX_ERROR"), ("RESYNC", 2, 1, "SENSOR_ERROR")]
    slow = said(lane(error_ms=1500), [*steady(0, 80), (2000, None), (3500, None)])
    assert slow == start + [("SENSOR_ERROR", 2, 2, "INVALID")]  # two only, but long enough apart
    late = [(t, mm, False, None, True) for t, mm in steady(1200, 120)]
    assert said(lane(), [*steady(0, 80), *late, *steady(2400, 80)]) == start  # late samples show nothing
    assert said(lane(), [*steady(0, 80), *steady(9000, 80)]) == start + [("RESYNC", 2, 2, "DATA_GAP")]
    assert said(lane(), [*steady(0, 80), *steady(1200, 300), *steady(2400, 80), *steady(3600, 5)]) == start + [("OUT_OF_RANGE", 2, 2, "beyond"), ("OUT_OF_RANGE", 2, 2, "over")]
    stock = said(lane(), [*steady(0, 80), *[(t, mm, True) for t, mm in steady(1200, 40)], *steady(2400, 40)])
    assert stock == start + [("RESYNC", 2, 3, "RESTOCK")]
    assert said(lane(tolerance=(15, 4, 15, 15), hysteresis=0), [*steady(0, 80), *steady(1200, 112)]) == start
    assert said(lane(tolerance=(15, 9, 15, 15), hysteresis=0), [*steady(0, 80), *steady(1200, 112)]) == start + [("REMOVE", 2, 1, None)]
    assert said(lane(), [*steady(0, 80), *steady(1200, 104)]) == start  # within the confirmed count's hysteresis
    shaken = [(1200 + 100 * i, 120 + 12 * (i % 2)) for i in range(8)] + [(2000 + 100 * i, 121) for i in range(8)]
    assert said(lane(median=1), [*steady(0, 80), *shaken]) == start + [("REMOVE", 2, 1, None)]
    assert [e["at_ms"] for m in [lane(median=1)] for s in [*steady(0, 80), *shaken] for e in m.step(*s)][-1] >= 2300  # after the shaking left the window


def test_best_pairs_beats_greedy():
    a, b = np.array([0.0, 3.0]), np.array([2.9, 10.9])
    assert matching.best_pairs(a, b, 2, 8) == [(0, 0), (1, 1)]
    rng = random.Random(1)
    for _ in range(200):
        a, b = (np.sort([rng.uniform(0, 20) for _ in range(rng.randrange(5))]) for _ in range(2))
        best = (0, 0.0)
        for k in range(min(len(a), len(b)) + 1):
            for x in itertools.combinations(range(len(a)), k):
                for y in itertools.permutations(range(len(b)), k):
                    d = [b[j] - a[i] for i, j in zip(x, y, strict=True)]
                    if all(-2 <= v <= 8 for v in d):
                        best = max(best, (k, -sum(map(abs, d))))
        got = matching.best_pairs(a, b, 2, 8)
        assert (len(got), pytest.approx(-sum(abs(b[j] - a[i]) for i, j in got))) == best


def test_hungarian_is_optimal():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 3), (2, 5), (5, 2), (4, 4)):
        for _ in range(20):
            s = rng.random((n, m))
            pairs = matching.hungarian(s)
            k = min(n, m)
            best = max(sum(s[i, j] for i, j in zip(x, y, strict=True)) for x in itertools.combinations(range(n), k) for y in itertools.permutations(range(m), k))
            assert len(pairs) == k and sum(s[i, j] for i, j in pairs) == pytest.approx(best)


def test_cases(spark):
    def last(*levels):
        rows = [("a", i, None if x == "resolve" else x, "ok" if x == "resolve" else None) for i, x in enumerate(levels)]
        r = ledger.case_fold(spark.createDataFrame(rows, "k string, n int, level string, res string"), ["k"], ["n"], "level", "res").first()
        return (r.level, r.state, r.notified, r.reopened)

    assert last("CLEAR") == ("CLEAR", "pass", 0, 0)
    assert last("WARNING", "CLEAR") == ("CLEAR", "auto_cleared", 1, 0)
    assert last("WARNING", "CLEAR", "WARNING") == ("WARNING", "active", 2, 0)
    assert last("REVIEW", "CLEAR") == ("REVIEW", "active", 1, 0)
    assert last("WARNING", "resolve", "WARNING") == ("WARNING", "resolved", 1, 0)
    assert last("WARNING", "resolve", "HIGH_RISK") == ("HIGH_RISK", "active", 2, 1)


def test_range_join_has_each_pair_once(spark):
    rng = random.Random(3)
    a = [(i % 3, i, s := rng.randrange(100), s + rng.randrange(40)) for i in range(60)]
    b = [(i % 3, i, s := rng.randrange(100), s + rng.randrange(40)) for i in range(60)]
    j = joins.range_join(spark.createDataFrame(a, "k int, a long, s long, e long"), spark.createDataFrame(b, "k int, b long, bs long, be long"), ["k"], "s", "e", "bs", "be", 7, slack=3)
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] - 3 <= y[3] and x[3] + 3 >= y[2])
    assert sorted((r.a, r.b) for r in j.collect()) == want


def test_aliases(spark):
    n = spark.createDataFrame([(i,) for i in range(30)], "id long")
    m = spark.createDataFrame([(i, i - 1) for i in range(1, 20)], "from long, into long")
    assert {r.id: r.root for r in joins.resolve_aliases(n, m).collect()} == {i: 0 if i < 20 else i for i in range(30)}


def test_geometry(spark):
    square = g.points((0, 0), (10, 0), (10, 10), (0, 10))
    b = g.box(F.lit(5), F.lit(5), F.lit(15), F.lit(15))
    r = one(spark, g.polygon_area(square), g.overlap_ratio(square, b), g.contains_point(square, F.lit(5.0), F.lit(5.0)), g.contains_point(square, F.lit(15.0), F.lit(5.0)), g.distance_to_polygon(square, F.lit(13.0), F.lit(14.0)), g.iou(b, b), g.interpolate(F.lit(110.0), [160.0, 120.0, 80.0]))
    assert tuple(r) == (100.0, 0.25, True, False, 5.0, 1.0, 1.25)


def test_text(spark):
    r = one(spark, tx.ean13_check_digit(F.lit("400638133393")), tx.normalize_barcode(F.lit(" 4006-3813 ")), tx.seconds_of_day(F.lit("01-02-03")), tx.seconds_of_day(F.lit("25-00-00")), tx.clock_text(F.lit(3723.0045)), tx.local_clock(F.lit("nonsense"), "Asia/Seoul"))
    assert tuple(r) == (1, "40063813", 3723, -1, "01:02:03.004", "nonsense")


def test_even_thinning_and_spacing(spark):
    rows = spark.createDataFrame([("a", i, i) for i in range(23)], "k string, t long, i long")
    assert sorted(r.i for r in windows.even_thinning(rows, ["k"], ["t"], 5).collect()) == [i * 23 // 5 for i in range(5)]
    assert windows.greedy_spacing(rows, ["k"], "t", 7, 3).first().picks == [0, 7, 14]
    assert windows.greedy_spacing(rows, ["k"], "t", 7, 9).first().picks is None


def test_lateness_is_a_reflected_walk(spark):
    rng = random.Random(4)
    host, dev, rows = 0, 0, []
    for i in range(200):
        host, dev = host + rng.randrange(200), dev + rng.randrange(200)
        rows.append(("b", i, host, dev))
    got = windows.arrival_lateness(spark.createDataFrame(rows, "k string, i long, h long, d long"), ["k"], ["i"], "h", "d", 100.0)
    late, want = 0.0, []
    for x, y in itertools.pairwise(rows):
        late = max(0.0, late + (y[2] - x[2]) - (y[3] - x[3]) * 1.001)
        want.append(late)
    assert [r.late_ms for r in got.orderBy("i").collect()] == pytest.approx([0.0, *want], abs=0.01)


def test_splits_do_not_leak(spark):
    rows = spark.createDataFrame([(f"t{i // 3}", "ab"[i % 7 == 0]) for i in range(300)], "take string, cls string")
    s = datasets.group_split(rows, "take", "cls", 0.15, 0.2)
    assert s.count() == s.select("take").distinct().count() == 100
    assert {r.split for r in s.select("split").distinct().collect()} == {"train", "val", "test"}


def test_sources(spark, tmp_path):
    (tmp_path / "o.jsonl").write_text('{"track_id": 1, "bbox": [0, 1, 2, 3], "frame": 5, "keypoints": [[1, 2, 0.5]]}\n\n{"track_id": 2, "bbox": [0, 0, 1, 1], "frame": 6, "keypoints": null}\n')
    o = logs.read_observations(spark, str(tmp_path / "o.jsonl")).where("track_id is not null").orderBy("frame").collect()
    assert (o[0].bbox.y2, o[0].keypoints[0].conf, o[1].keypoints) == (3.0, 0.5, None)
    (tmp_path / "p.csv").write_text("time_sec,items,person_id\n31.5,1,\n58.0,,3\n,2,1\n")
    assert [tuple(r) for r in logs.read_payments(spark, str(tmp_path / "p.csv")).orderBy("time_sec").collect()] == [(31.5, 1, None), (58.0, 1, 3)]
    (tmp_path / "c.xml").write_text('<annotations><track label="fall_start"><box frame="3" outside="0"/></track><track label="fall_end"><box frame="9" outside="0"/><box frame="10" outside="1"/></track><track label="theft_start"><box frame="4" outside="0"/></track></annotations>')
    good, bad = logs.cvat_events(logs.read_cvat_tracks(spark, str(tmp_path / "c.xml")))
    assert [tuple(r) for r in good.collect()] == [("c", "fall", 3, 9)] and bad.first().problem == "start without end"
    (tmp_path / "coco.json").write_text('{"images": [{"id": 1, "file_name": "a.jpg"}], "annotations": [{"image_id": 1, "category_id": 7, "bbox": [1, 2, 3, 4]}], "categories": [{"id": 7, "name": "cup"}]}')
    assert tuple(logs.read_coco(spark, str(tmp_path / "coco.json")).first()) == (1, "a.jpg", "cup", 1.0, 2.0, 3.0, 4.0)
    y = logs.yolo_boxes(spark.createDataFrame([("2 0.5 0.5 0.2 0.4",), ("bad",)], "value string"), F.lit(100), F.lit(50)).collect()
    assert [tuple(r) for r in y] == [(2, 40.0, 15.0, 60.0, 35.0)]
    with pytest.raises(ValueError):
        logs.zone_rows([{"name": "z", "polygon": [(0, 0), (1, 1)]}])
    assert {r.path.rsplit("/", 1)[1]: r.bytes for r in logs.manifest(spark, str(tmp_path), "*.csv").collect()} == {"p.csv": 46}


def test_streams_equal_batches(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i % 4, i * 1000, i, rng.random(), rng.choice("ab"), rng.choice([80.0, 81.0, 120.0, 40.0])) for i in range(400)]
    schema = "k long, ms long, id long, score double, code string, mm double"
    for n in range(8):  # eight micro-batches in order of time
        spark.createDataFrame(rows[50 * n : 50 * n + 50], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    whole = spark.createDataFrame(rows, schema)
    src = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")

    def drained(stream, name):
        twins.drain(stream, f"{tmp_path}/{name}", f"{tmp_path}/{name}-ck")
        return sorted(map(tuple, spark.read.schema(stream.schema).parquet(f"{tmp_path}/{name}").collect()))

    p = {"threshold": 0.5, "window": 5, "min_hits": 3, "end_below": 2, "cooldown": 5000}
    batch = machines.alert_intervals(whole, "k", "ms", "id", "score", **p).where("end_ms is not null")
    assert drained(twins.alert_stream(src(), "k", "ms", "id", "score", **p), "alerts") == sorted(map(tuple, batch.collect()))
    q = {"stable_ms": 4000, "min_samples": 2, "max_gap": 9000, "spread": 50.0}
    lanes = machines.lane_events(whole, "k", "ms", "id", "mm", [120.0, 80.0, 40.0], **q)
    assert drained(twins.lane_stream(src(), "k", "ms", "id", "mm", [120.0, 80.0, 40.0], **q), "lanes") == sorted(map(tuple, lanes.collect()))
    gate = windows.scan_gate(whole, ["k"], "ms", "id", "code", 5000).select("k", "ms", "id", "code")
    assert drained(twins.scan_gate_stream(src(), "k", "ms", "id", "code", 5000), "gate") == sorted(map(tuple, gate.collect()))


def test_streams_forget_silent_keys(spark, tmp_path):
    """Key 1 is silent for 100 s while key 2 goes on: with an expiry it begins anew, without one it resyncs."""
    batches = [[(1, t, t, 80.0) for t in range(0, 5000, 1000)], *[[(2, t, t, 80.0) for t in range(s, s + 20_000, 1000)] for s in (5000, 25_000, 45_000, 65_000, 85_000)], [(1, t, t, 120.0) for t in range(105_000, 110_000, 1000)]]
    schema = "k long, ms long, id long, mm double"
    for n, b in enumerate(batches):
        rows = [(k, 1_000_000 + t, i, v) for k, t, i, v in b]  # a watermark begins at 0 and drops a row of that time
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    q = {"stable_ms": 2000, "min_samples": 2, "max_gap": 9000}
    for expire, want in ((10_000, ["INIT", "INIT"]), (None, ["INIT", "RESYNC"])):
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        stream = twins.lane_stream(src, "k", "ms", "id", "mm", [120.0, 80.0, 40.0], expire=expire, **q)
        twins.drain(stream, f"{tmp_path}/o{expire}", f"{tmp_path}/o{expire}-ck")
        got = spark.read.schema(stream.schema).parquet(f"{tmp_path}/o{expire}").where("k = 1").orderBy("at_ms")
        assert [r.event for r in got.collect()] == want


def test_numbers_of_one_huge_key(spark):
    rng = random.Random(6)
    rows = [(None if i % 50 == 0 else "b" if i % 9 == 0 else "a", rng.randrange(40), i) for i in range(3000)]
    d = spark.createDataFrame(rows, "k string, v int, id long").repartition(7)
    got = {r.id: r.turn for r in windows.numbered(d, ["k"], [F.desc("v"), "id"], "turn").collect()}
    want = {}
    for k in (None, "a", "b"):
        want |= {i: n for n, (_, i) in enumerate(sorted((-v, i) for c, v, i in rows if c == k), 1)}
    assert got == want
    assert windows.numbered(d.limit(0), ["k"], ["v"], "turn").count() == 0
