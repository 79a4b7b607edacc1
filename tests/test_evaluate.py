"""Scripted cases of judging links, labels, devices and restocking."""

from pyspark.sql import functions as F

from storeflow.operators import evaluate as ev


def test_sure_and_carried_pairs(spark):
    schema = "pair long, near long, start long, far long, samples int, points int, point_gap double, floor_gap double"
    rows = [
        (1, 1, 0, 11, 5, 2, 4.0, 4.0), (1, 1, 0, 12, 5, 0, None, 40.0),  # sure: 11
        (1, 1, 1, 11, 5, 1, 4.0, 4.0), (1, 1, 1, 12, 5, 0, None, 40.0),  # one point is not enough: carried from 0
        (1, 1, 2, 11, 5, 2, 4.0, 4.0), (1, 1, 2, 12, 5, 0, None, 29.0),  # the other might be near
        (1, 1, 3, 11, 5, 2, 4.0, 4.0), (1, 1, 3, 12, 5, 3, 9.0, 9.0),  # two are near
        (1, 1, 4, 11, 5, 2, 4.0, 4.0),  # no rival
        (1, 1, 5, 12, 5, 0, None, 50.0), (1, 1, 5, 13, 5, 2, 8.0, 8.0), (1, 1, 5, 11, 0, 0, None, None),  # sure: 13, 11 has no samples
        (1, 1, 6, 12, 5, 0, None, 50.0), (1, 1, 6, 11, 5, 0, None, None),  # 13 is gone: nothing is carried
        (1, 2, 0, 11, 5, 0, None, 1.0), (1, 2, 0, 12, 5, 0, None, 2.0),  # never sure
    ]
    c = spark.createDataFrame(rows, schema)
    sure = ev.sure_pairs(c, ["pair"], "near", "start", "far")
    assert sorted(tuple(r)[1:] for r in sure.collect()) == [(1, 0, 11), (1, 5, 13)]
    carried = ev.carried_pairs(c, sure, ["pair"], "near", "start", "far")
    assert sorted(tuple(r)[1:] for r in carried.collect()) == [(1, 1, 11), (1, 2, 11)]
    links = spark.createDataFrame([(1, 1, 0, 11), (1, 1, 5, 12), (1, 1, 1, None)], "pair long, near long, start long, far long")
    both = sure.unionByName(carried)
    got = ev.score_links(links, both, ["pair"], "near", "start", "far", ["pair"]).collect()
    assert [(r.right, r.wrong, r.none) for r in got] == [(1, 1, 1)]


def outcomes(spark, labels, episodes):
    la = spark.createDataFrame([("p", *x) for x in labels], "lane string, id long, at long, action string")
    ep = spark.createDataFrame([("p", *x) for x in episodes], "lane string, id long, start_ms long, end_ms long, state string, changed boolean, direction string")
    return {r.label_id: (r.outcome, r.episode_id, r.direction, r.cause) for r in ev.label_outcomes(la, ep, ["lane"], 2000).collect()}


def test_label_outcomes(spark):
    changed = lambda k, s, e, d: (k, s, e, "compared", True, d)
    assert outcomes(spark, [(1, 5000, "take")], [changed(7, 4000, 6000, "DECREASED")]) == {1: ("FOUND", 7, "RIGHT", None)}
    assert outcomes(spark, [(1, 5000, "return")], [changed(7, 4000, 6000, "DECREASED")])[1][2] == "WRONG"
    assert outcomes(spark, [(1, 5000, "take")], [changed(7, 4000, 6000, "CHANGED")])[1][2] == "UNKNOWN"
    assert outcomes(spark, [(1, 5000, "take")], [changed(7, 6500, 7000, None), changed(8, 3000, 4600, None), changed(9, 4400, 4600, None)])[1][1] == 8, "nearest, then earlier"
    assert outcomes(spark, [(1, 5000, "take")], [changed(7, 7001, 9000, None)])[1] == ("MISSED", None, None, "NO_EPISODE")
    assert outcomes(spark, [(1, 5000, "take")], [(7, 4000, 6000, "unfinished", False, None)])[1] == ("MISSED", 7, None, "only unfinished")
    still = (7, 4000, 9000, "compared", False, None)
    got = outcomes(spark, [(1, 5000, "take"), (2, 8000, "return"), (3, 8500, "return")], [still])
    assert got[1][:2] == got[2][:2] == ("SWAP_BACK", 7) and got[3] == ("MISSED", 7, None, "only compared")
    assert outcomes(spark, [(1, 8000, "take"), (2, 5000, "return")], [still])[1][0] == "MISSED", "put back before it was taken"


def test_device_events(spark):
    rows = [("d", 0, 0, "a", 1, False), ("d", 1000, 1, "a", 2, True), ("d", 2000, 2, "a", 3, True), ("d", 3000, 3, "a", 20, False), ("d", 4000, 4, "b", 1, True), ("d", 60_000, 5, "b", 2, True), ("e", 5, 9, None, None, None)]
    df = spark.createDataFrame(rows, "device string, t long, i long, boot string, seq long, late boolean")
    got = sorted((r.t, r.kind, r.missing) for r in ev.device_events(df, "device", "t", "i", "boot", "seq", F.col("late"), 10_000).where("device = 'd'").collect())
    assert got == sorted([(0, "DEVICE_SEEN", None), (1000, "BACKLOG_START", None), (3000, "BACKLOG_END", None), (3000, "SEQUENCE_GAP", 16), (4000, "BACKLOG_START", None), (4000, "DEVICE_REBOOT", None), (60_000, "BACKLOG_START", None), (60_000, "DEVICE_RESTORED", None)])


def test_restocking_ends_by_itself(spark):
    rows = spark.createDataFrame([("a", t, t) for t in (50, 100, 500, 1100, 1101, 2000, 2500)] + [("b", 100, 1)], "lane string, t long, i long")
    switch = spark.createDataFrame([("a", 100, 1, True), ("a", 600, 2, True), ("a", 1900, 3, False), ("a", 2400, 4, True)], "lane string, t long, i long, on boolean")
    got = {(r.lane, r.t): r.restock for r in ev.restocking(rows, switch, ["lane"], "t", "i", "on", 1000).collect()}
    assert got == {("a", 50): False, ("a", 100): True, ("a", 500): True, ("a", 1100): True, ("a", 1101): False, ("a", 2000): False, ("a", 2500): True, ("b", 100): False}


def test_moved_boxes(spark):
    boxes = [(f, f, "tin", 10.0, 10.0, 20.0, 20.0) for f in range(8)] + [(50, 0, "tin", 40.0, 10.0, 50.0, 20.0), (51, 1, "jar", 10.0, 10.0, 20.0, 20.0), (52, 2, "tin", 13.0, 10.0, 23.0, 20.0)]
    df = spark.createDataFrame([("c", *b) for b in boxes] + [("lone", 99, 0, "tin", 0.0, 0.0, 5.0, 5.0)], "cam string, id long, frame long, cls string, x1 double, y1 double, x2 double, y2 double")
    got = {r.id: (round(r.stability, 6), r.moved) for r in ev.box_stability(df, ["cam"], "frame", "id", "cls", 10.0).collect()}
    assert got[3] == (1.0, False) and got[50] == (0.0, True) and got[51] == (0.0, True) and got[52] == (1.0, False) and got[99] == (0.0, True)
