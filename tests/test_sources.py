"""Readers and writers on small files: round trips, types and blanks."""

from pyspark.sql import functions as F

from storeflow.sources import logs
from storeflow.streaming import twins


def test_logs_round_trip(spark, tmp_path):
    seen = {"track_id": 1, "bbox": [1.0, 2.0, 3.0, 4.0], "frame": 5, "timestamp": "t", "score": 0.5, "class_name": "person", "keypoints": [[1.0, 2.0, 0.9]], "camera_id": "c1"}
    who = {"person_id": 9, "is_new": True, "matched_similarity": None, "stitched": False, **seen}
    schema = logs.IDENTITY + ", run string"
    logs.write_log(spark.createDataFrame([who | {"run": "r"}, who | {"run": "r", "frame": 6}], schema), str(tmp_path / "out"), ["run", "camera_id"])
    got = logs.read_identities(spark, str(tmp_path / "out/run=r/camera_id=c1")).orderBy("frame").collect()
    assert [(r.person_id, r.frame, r.bbox.x2, r.keypoints[0].conf, r.is_new) for r in got] == [(9, 5, 3.0, 0.9, True), (9, 6, 3.0, 0.9, True)]
    (tmp_path / "o.jsonl").write_text('{"track_id": 1, "bbox": [1,2,3,4], "frame": 5, "keypoints": null}\n\n{"track_id": 2, "bbox": [0,0,1,1], "frame": 6}\n')
    assert [(r.track_id, r.bbox.y2, r.keypoints) for r in logs.read_observations(spark, str(tmp_path / "o.jsonl")).orderBy("frame").collect()] == [(1, 4.0, None), (2, 1.0, None)]


def test_sensor_tables(spark, tmp_path):
    (tmp_path / "s.csv").write_text("time_sec,slot,delta_g,confidence\n5.0,card,-45.0,1.0\n6.5004,cup,30,\n")
    assert [tuple(r) for r in logs.read_sensor_events(spark, str(tmp_path / "s.csv")).orderBy("time_ms").collect()] == [(5000, "card", -45.0, 1.0), (6500, "cup", 30.0, 1.0)]
    rows = [(1000, "1", "REMOVE", 1), (2000, "1", "RESYNC", 1), (3000, "9", "ADD", 1), (4000, "2", "ADD", 0), (5000, "2", "ADD", 1)]
    lanes = logs.lane_sensor_rows(spark.createDataFrame(rows, "time_ms long, lane string, event string, in_video int"), 250, ["1", "2"])
    assert sorted((r.time_ms, r.lane) for r in lanes.collect()) == [(1250, "1"), (5250, "2")]


def test_event_lines(spark):
    lines = ["09:00:05  L1  REMOVE  3→2  128.5  lane 1 / cup noodle / -1", "  23:59:59  L12  SENSOR_ERROR  2→2  -  tea  ", "09:00:05  L1  ADD  1→2  -", "9:00:05  L1  ADD  1→2  -  x", "09:00:05.100  L1  ADD  1 -> 2", ""]
    got = [tuple(r) for r in logs.parse_event_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert got == [(32405, "L1", "REMOVE", 3, 2, 128.5, "cup noodle"), (86399, "L12", "SENSOR_ERROR", 2, 2, None, "")]


def test_label_tables(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    takes = logs.read_take_labels(spark, put("t.csv", "﻿pair,seq,time_sec,lane,action,qty,checked_by,note\nC03,1,4.5,L1,take,1,a,\"x, y\"\nC03,2,,L1,take,1,a,\nC03,3,7,L2,none,,a,\nC10,1,9,L2,return,2,,\n"))
    assert sorted((r.seq, r.time_sec, r.action, r.qty) for r in takes.collect()) == [(1, 4.5, "take", 1), (1, 9.0, "return", 2)]
    paid = logs.read_payment_labels(spark, put("p.csv", "pair,attempt,time_sec,items,result,checked_by,note\nC03,1, 31.5 ,2, paid ,a,\nC03,,,,none,,\n"))
    assert sorted(map(tuple, paid.collect()), key=str) == [("C03", 0, None, 0, "none", "", ""), ("C03", 1, 31.5, 2, "paid", "a", "")]
    truth = logs.read_truth(spark, put("g.csv", "pair,expected,people,set\nC03,HIGH_RISK ,2,theft\n"))
    assert tuple(truth.first()) == ("C03", "HIGH_RISK", 2, "theft")
    check = logs.read_sensor_check(spark, put("c.csv", "pair,kind,lane,direction,label_sec,sensor_lane,sensor_sec,dt\nC10,missed,1,take,3.0004,,,\nC9,extra,1,take,,1,8.5,\nC9,ok,2,take,1.5,2,1.6,0.1\nC9,missed,2,take,,,,\n"))
    assert {(r.pair, r.label_ms, r.kind) for r in logs.sensor_kinds(check).collect()} == {("C10", 3000, "missed"), ("C9", 1500, "ok")}
    assert [(r.pair, r.kind, r["at"]) for r in logs.problem_rows(check, ["missed", "extra"]).collect()] == [("C9", "missed", 0.0), ("C9", "extra", 8.5), ("C10", "missed", 3.0004)]
    assert logs.problem_rows(check, ["missed"], ["C10"]).count() == 1


def test_dimensions_and_offsets(spark, tmp_path):
    z = logs.zones_table(spark, [{"name": "a", "polygon": [(0, 0), (1, 0), (1, 1)]}, {"name": "b", "type": "SHELF", "polygon": [(0, 0), (2, 0), (2, 2)], "normalized": False}], normalized=True)
    assert [(r.zone, r.type, len(r.poly), r.normalized) for r in z.orderBy("zone").collect()] == [("a", "OTHER", 3, True), ("b", "SHELF", 3, False)]
    schema = "pair string, video string, offset_ms long"
    old, new = spark.createDataFrame([("C1", "v", 5), ("C2", "v", 6)], schema), spark.createDataFrame([("C2", "v", 7), ("C3", "v", 8), ("C3", "v", 9)], schema).coalesce(1)
    assert sorted((r.pair, r.offset_ms) for r in logs.upsert_sync(old, new, ["pair", "video"]).collect()) == [("C1", 5), ("C2", 7), ("C3", 9)]
    for root, names in (("r1", ["x.txt"]), ("r2", ["x.txt", "y.txt"])):
        (tmp_path / root).mkdir()
        for n in names:
            (tmp_path / root / n).write_text(root + n)
    found = logs.files(spark, [str(tmp_path / "r1"), str(tmp_path / "r2")], "*.txt")
    assert sorted((r.stem, r.root) for r in found.collect()) == [("x", 0), ("y", 1)]
    logs.publish_splits(spark.createDataFrame([("train", "c1", "a.jpg"), ("val", "c1", "b.jpg")], "split string, camera string, image string"), str(tmp_path / "lists"))
    assert spark.read.csv(str(tmp_path / "lists/split=val/camera=c1")).first()[0] == "b.jpg"


def test_sinks(spark, tmp_path):
    schema = "k long, v long, kind string"
    for n, rows in enumerate([[(1, 1, "EVENT"), (2, 1, "STATUS")], [(1, 2, "DEVICE_LOG")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    src = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    twins.pour(src().drop("kind"), twins.upsert_sink(f"{tmp_path}/up", ["k"], "v"), f"{tmp_path}/ck1")
    assert sorted((r.k, r.v) for r in twins.latest_of(spark, f"{tmp_path}/up", ["k"], "v").collect()) == [(1, 2), (2, 1)]
    twins.pour(src(), twins.lane_sink(f"{tmp_path}/lanes"), f"{tmp_path}/ck2")
    read = lambda n: sorted(map(str, (r.asDict() for r in spark.read.schema("k long, v long, message_type string").json(f"{tmp_path}/lanes/{n}").drop("batch").collect())))
    assert read("status") == [str({"k": 2, "v": 1, "message_type": None})]
    assert read("events") == sorted([str({"k": 1, "v": 1, "message_type": None}), str({"k": 1, "v": 2, "message_type": "DEVICE_LOG"})])


def test_case_store_keeps_history_over_batches(spark, tmp_path):
    schema = "case long, at long, level string, resolution string"
    batches = [[(1, 1, "WARNING", None), (2, 1, "CLEAR", None)], [(1, 2, None, "ok"), (2, 2, "HIGH_RISK", None)], [(1, 3, "HIGH_RISK", None), (9, 3, None, None)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    write = twins.case_store(f"{tmp_path}/store", ["case"], ["at"], "level", "resolution")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    twins.pour(twins.case_stream(src, "case", "at", "at", "level", "resolution"), write, f"{tmp_path}/ck")
    again = [(1, 3, "HIGH_RISK", None, "HIGH_RISK", "active", 2, 1), (9, 3, None, None, None, None, 0, 0)]
    write(spark.createDataFrame(again, schema + ", case_level string, case_state string, notified int, reopened int"), 2)  # a batch that runs again replaces itself
    got = {r.case: (r.level, r.state, r.reopened) for r in twins.latest_cases(spark, f"{tmp_path}/store", ["case"]).collect()}
    assert got == {1: ("HIGH_RISK", "active", 1), 2: ("HIGH_RISK", "active", 0)}
    count = lambda n: spark.read.schema(schema).parquet(f"{tmp_path}/store/{n}").count()
    assert (count("events"), count("resolutions")) == (4, 1)
    assert spark.read.parquet(f"{tmp_path}/store/cases").where(F.col("case") == 1).count() == 3


def test_cases_one_event_at_a_time(spark):
    import random

    from storeflow.operators.ledger import LEVELS, Case, case_fold

    rng = random.Random(6)
    rows = [(rng.randrange(40), t, rng.choice([*LEVELS, None]), "ok" if rng.random() < 0.2 else None) for t in range(900)]
    cases = {}
    for case, _, level, resolution in rows:
        cases.setdefault(case, Case()).event(level, resolution is not None)
    got = case_fold(spark.createDataFrame(rows, "case long, at long, level string, resolution string"), ["case"], ["at"], "level", "resolution").collect()
    assert {r.case: (r.level, r.state, r.notified, r.reopened) for r in got} == {k: (c.name, c.state, c.notified, c.reopened) for k, c in cases.items() if c.level >= 0}
