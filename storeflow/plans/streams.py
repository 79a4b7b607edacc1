"""Streams over the given tables, drained into the shared folder, and parsed logs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import logs
from ..sources.tables import HOUR, OBS_SQL, observations, shared_root, table
from ..streaming import twins
from .state import ORACLES as STATE_ORACLES
from .state import levels

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _folder(spark) -> str:
    return f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"


def event_stream(spark, d):
    """The events table as a file stream."""
    path = f"{d}/events.parquet"
    given = spark.read.parquet(path)
    single = given.inputFiles()[:1] and given.inputFiles()[0].endswith("/events.parquet")
    reader = spark.readStream.schema(given.schema)
    s = reader.option("pathGlobFilter", "events.parquet").parquet(d) if single else reader.parquet(path)
    return s.select("event_id", F.col("user_id").alias("person_id"), F.col("event_type").alias("zone"), F.col("ts").cast("timestamp").alias("at"), F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("ms"), "value")


def _drained(spark, stream, mode="append"):
    f = _folder(spark)
    twins.drain(stream, f"{f}/out", f"{f}/state", mode)
    return spark.read.schema(stream.schema).parquet(f"{f}/out")


@query(STATE_ORACLES["st2_alert_intervals"].split(" UNION ALL SELECT person_id, started")[0])
def stream_alerts(spark, d):
    """ST2 on a stream: ended alerts."""
    s = event_stream(spark, d).withColumn("score", F.col("value") / 100.0)
    return _drained(spark, twins.alert_stream(s, "person_id", "ms", "event_id", "score", threshold=0.4, window=5, min_hits=3, end_below=4, cooldown=20 * HOUR))


@query(f"""WITH {OBS_SQL}, a AS (SELECT *, lag(zone) OVER o = zone AND ms - lag(ms) OVER o < {6 * HOUR} AS again FROM ev WINDOW o AS (PARTITION BY person_id ORDER BY ms, event_id))
SELECT person_id, ms, event_id, zone FROM a WHERE NOT coalesce(again, false)""")
def stream_scan_gate(spark, d):
    """W20 on a stream."""
    return _drained(spark, twins.scan_gate_stream(event_stream(spark, d), "person_id", "ms", "event_id", "zone", 6 * HOUR))


@query(f"""WITH {OBS_SQL}, z AS (SELECT max(ms) AS t FROM ev) SELECT zone, ms // {24 * HOUR} * {24 * HOUR} AS start_ms, count(*) AS n, min(value) AS low, max(value) AS high FROM ev, z WHERE (ms // {24 * HOUR} + 1) * {24 * HOUR} <= t - {HOUR} GROUP BY 1, 2""")
def stream_sensor_windows(spark, d):
    """A28 on a stream: daily windows that the watermark has passed."""
    w = _drained(spark, twins.sensor_windows(event_stream(spark, d), "zone", "at", "value", "1 day", "1 hour"))
    return w.select("zone", F.unix_millis("w.start").alias("start_ms"), "n", "low", "high")


@query()
def stream_sessions(spark, d):
    """W1 on a stream: sessions that the watermark has closed."""
    s = _drained(spark, twins.sessions(event_stream(spark, d), "person_id", "at", "7 hours", "1 hour"))
    return s.select("person_id", F.unix_millis("s.start").alias("start_ms"), F.unix_millis("s.end").alias("end_ms"), "n")


@query("""WITH e AS (SELECT event_id, event_id % 24 AS h, event_id % 60 AS m, CAST(floor(value) AS INT) % 60 AS s FROM events WHERE event_id % 9 <> 0)
SELECT event_id, (h * 60 + m) * 60 + s AS at_sec, 'L' || event_id % 4 AS lane, 'ADD' AS event, CAST(event_id % 5 AS INTEGER) AS before, CAST(event_id % 5 + 1 AS INTEGER) AS after, CASE WHEN event_id % 7 > 0 THEN event_id % 400 + 0.5 END AS distance_mm, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'item ' || event_id % 3 END AS product FROM e""")
def s8_event_lines(spark, d):
    """Log lines built from events and parsed again; every ninth is damaged and skipped."""
    k = F.col("event_id")
    far = F.when(k % 7 > 0, F.concat((k % 400).cast("string"), F.lit(".5"))).otherwise("-")
    line = F.format_string("%02d:%02d:%02d  L%d  ADD        %d→%d   %s  %s", k % 24, k % 60, F.floor("value").cast("int") % 60, k % 4, k % 5, k % 5 + 1, far, F.when(k % 11 == 0, "loose").otherwise(F.concat(F.lit("lane 1 / item "), (k % 3).cast("string"), F.lit(" / +1"))))
    lines = table(spark, d, "events").select("event_id", F.when(k % 9 == 0, F.lit("09:00:0x  L1  ADD  1→2  -  broken")).when(k % 5 == 0, F.concat(F.lit("  "), line, F.lit(" "))).otherwise(line).alias("value"))
    return logs.parse_event_lines(lines)


def _label_csv(spark, rows):
    """Rows of strings as CSV files with a header, in the shared folder."""
    path = f"{_folder(spark)}/labels"
    rows.write.option("header", True).option("nullValue", "").csv(path)
    return path


@query("""WITH l AS (SELECT l_suppkey AS pair, l_linenumber AS seq, l_quantity AS q, l_partkey AS p, l_orderkey AS o FROM lineitem)
SELECT 'takes' AS kind, count(*) AS n, CAST(sum(seq) AS DOUBLE) AS total FROM l WHERE o % 6 > 0 AND p % 3 < 2
UNION ALL SELECT 'payments', count(*), CAST(sum(CASE WHEN o % 5 = 0 THEN 0 ELSE p % 4 END) AS DOUBLE) FROM l
UNION ALL SELECT 'untimed payments', count(*), NULL FROM l WHERE o % 6 = 0
UNION ALL SELECT 'truth', count(*), CAST(sum(seq) AS DOUBLE) FROM l
UNION ALL SELECT 'sensor kinds', count(*), NULL FROM (SELECT DISTINCT pair, p % 3, seq, q FROM l WHERE o % 4 > 0)""")
def s14_label_tables(spark, d):
    """Take, payment, truth and sensor-check labels written as CSV with blanks, and read with their types."""
    li = table(spark, d, "lineitem")
    text = lambda c: c.cast("string")
    o, p, pair = F.col("l_orderkey"), F.col("l_partkey"), F.concat(F.lit("N"), text(F.col("l_suppkey")))
    time = F.when(o % 6 > 0, text(F.col("l_quantity"))).otherwise(" ")
    seq = text(F.col("l_linenumber"))
    take = F.when(p % 3 == 0, "take").when(p % 3 == 1, "return").otherwise("none")
    takes = logs.read_take_labels(spark, _label_csv(spark, li.select(pair.alias("pair"), seq.alias("seq"), time.alias("time_sec"), F.lit("L1").alias("lane"), take.alias("action"), F.lit("1").alias("qty"), F.lit("x").alias("checked_by"), F.lit("a, b").alias("note"))))
    paid = logs.read_payment_labels(spark, _label_csv(spark, li.select(pair.alias("pair"), F.lit("").alias("attempt"), time.alias("time_sec"), F.when(o % 5 > 0, text(p % 4)).otherwise("").alias("items"), F.lit(" paid ").alias("result"), F.lit("").alias("checked_by"), F.lit("").alias("note"))))
    truth = logs.read_truth(spark, _label_csv(spark, li.select(pair.alias("pair"), F.lit("CLEAR").alias("expected"), seq.alias("people"), F.lit("normal").alias("set"))))
    check = logs.read_sensor_check(spark, _label_csv(spark, _check_rows(li)))
    count = lambda df, kind, total: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), total.cast("double").alias("total"))
    out = count(takes, "takes", F.sum("seq"))
    for part in (count(paid.where("result = 'paid'"), "payments", F.sum("items")), count(paid.where("time_sec is null"), "untimed payments", F.lit(None)), count(truth, "truth", F.sum("people")), count(logs.sensor_kinds(check), "sensor kinds", F.lit(None))):
        out = out.unionByName(part)
    return out


def _check_rows(li):
    text = lambda c: c.cast("string")
    o, p = F.col("l_orderkey"), F.col("l_partkey")
    kind = F.when(p % 5 == 0, "missed").when(p % 5 == 1, "extra").otherwise("ok")
    return li.select(
        F.concat(F.lit("N"), text(F.col("l_suppkey"))).alias("pair"), kind.alias("kind"), text(p % 3).alias("lane"), text(F.col("l_linenumber")).alias("direction"),
        F.when(o % 4 > 0, text(F.col("l_quantity"))).otherwise("").alias("label_sec"), F.lit("1").alias("sensor_lane"), F.when(o % 3 > 0, text(o)).otherwise("").alias("sensor_sec"), F.lit("").alias("dt"),
    )


@query("""SELECT 'N' || l_suppkey AS pair, CASE WHEN l_partkey % 5 = 0 THEN 'missed' ELSE 'extra' END AS kind, CAST(CASE WHEN l_orderkey % 4 > 0 THEN l_quantity WHEN l_orderkey % 3 > 0 THEN l_orderkey ELSE 0 END AS DOUBLE) AS at FROM lineitem WHERE l_partkey % 5 < 2""")
def p20_problem_rows(spark, d):
    """Problem rows of the sensor check with the time to jump to, in natural order of pairs."""
    check = logs.read_sensor_check(spark, _label_csv(spark, _check_rows(table(spark, d, "lineitem"))))
    return logs.problem_rows(check, ["missed", "extra"]).select("pair", "kind", "at")


@query(STATE_ORACLES["st3_case_fold"])
def s18_case_store(spark, d):
    """Alarms and resolutions streamed into the three tables of a case store; the newest row of each case."""
    f = _folder(spark)
    cases = twins.case_stream(levels(event_stream(spark, d).drop("at")), "person_id", "ms", "event_id", "level", "resolution")
    twins.pour(cases, twins.case_store(f"{f}/store", ["person_id"], ["ms", "event_id"], "level", "resolution"), f"{f}/state")
    return twins.latest_cases(spark, f"{f}/store", ["person_id"]).select("person_id", "level", "state", "notified", "reopened")


@query("""SELECT 'events' AS file, coalesce(CASE WHEN event_type = 'error' THEN 'DEVICE_LOG' END, '') AS message_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type <> 'view' GROUP BY 1, 2
UNION ALL SELECT 'status', '', count(*), round(sum(value), 4) FROM events WHERE event_type = 'view'""")
def s19_lane_files(spark, d):
    """Lane events and device logs to one folder of JSON lines, status rows to another, read back."""
    f = _folder(spark)
    kind = F.when(F.col("zone") == "view", "STATUS").when(F.col("zone") == "error", "DEVICE_LOG").otherwise("EVENT")
    twins.pour(event_stream(spark, d).select("event_id", "person_id", "value", kind.alias("kind")), twins.lane_sink(f"{f}/lanes"), f"{f}/state")
    read = lambda name: spark.read.schema("event_id long, person_id long, value double, message_type string").json(f"{f}/lanes/{name}").select(F.lit(name).alias("file"), F.coalesce("message_type", F.lit("")).alias("message_type"), "value")
    return read("events").unionByName(read("status")).groupBy("file", "message_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT CASE WHEN event_id % 10 = 0 THEN 'not JSON of this shape' WHEN event_id % 10 = 1 THEN 'a required field is missing' WHEN event_id % 10 = 2 THEN 'valid without a distance' ELSE 'good' END AS kind, count(*) AS n FROM events GROUP BY 1""")
def s9_measurement_lines(spark, d):
    """Device messages built from events; bad ones are counted by reason, not fatal."""
    k = F.col("event_id")
    good = F.to_json(F.struct(F.lit("measurement").alias("message_type"), F.lit("d1").alias("device_id"), F.when(k % 10 != 1, F.col("user_id").cast("string")).alias("boot_id"), k.alias("sequence"), F.lit(5).alias("uptime_ms"), F.lit("L1").alias("lane_id"), F.when(k % 10 != 2, F.col("value")).alias("distance_mm"), F.lit(True).alias("valid")))
    lines = table(spark, d, "events").select("event_id", F.when(k % 10 == 0, F.lit("{broken")).otherwise(good).alias("value"))
    ok, bad = logs.parse_measurements(lines)
    return ok.select(F.lit("good").alias("kind")).unionByName(bad.select(F.col("reason").alias("kind"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT user_id AS stem, event_type AS action, CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'end' END AS side, event_id AS frame FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY stem, action, side ORDER BY frame) AS n FROM t),
p AS (SELECT stem, action, n, min(frame) FILTER (side = 'start') AS s, min(frame) FILTER (side = 'end') AS e FROM r GROUP BY 1, 2, 3) SELECT stem, action, s AS start_frame, e AS end_frame FROM p WHERE s IS NOT NULL AND e IS NOT NULL AND e >= s""")
def s10_paired_tracks(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("stem"), F.concat("event_type", F.when(F.col("event_id") % 2 == 0, "_start").otherwise("_end")).alias("label"), F.col("event_id").alias("frame"))
    return logs.cvat_events(e)[0]


@query("""WITH o AS (SELECT l_orderkey AS id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS item_count, CAST(sum(CAST(l_quantity AS BIGINT) * l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY 1) SELECT * FROM o ORDER BY id DESC LIMIT 100""")
def s22_order_history(spark, d):
    """The newest hundred orders, their lines written as JSON and parsed again."""
    item = F.struct(F.col("l_partkey").cast("string").alias("barcode"), F.lit("x").alias("name"), F.col("l_linenumber").cast("bigint").alias("price"), F.col("l_quantity").cast("bigint").alias("qty"))
    o = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.to_json(F.collect_list(item)).alias("items_json"))
    return logs.order_history(o, "items_json", "id", 100).select("id", "item_count", "total")
