"""Scans and sinks of event logs, measurements, payments and labels. Schemas are explicit, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "array<double>"
OBSERVATION = f"track_id long, bbox {BOX}, frame long, timestamp string, score double, class_name string, keypoints array<array<double>>, camera_id string"
IDENTITY = f"person_id long, track_id long, bbox {BOX}, frame long, timestamp string, score double, class_name string, is_new boolean, matched_similarity double, keypoints array<array<double>>, stitched boolean, camera_id string"
MEASUREMENT = "message_type string, device_id string, boot_id string, sequence long, uptime_ms long, lane_id string, distance_mm double, valid boolean, sensor_status string"


def _shaped(df: DataFrame) -> DataFrame:
    """Boxes and keypoints as structs; blank lines are gone already."""
    box = F.struct(*[F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])
    points = F.transform("keypoints", lambda k: F.struct(F.get(k, F.lit(0)).alias("x"), F.get(k, F.lit(1)).alias("y"), F.get(k, F.lit(2)).alias("conf")))
    return df.withColumn("bbox", box).withColumn("keypoints", points)


def read_observations(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON lines of tracked observations, as a table or a stream."""
    return _shaped((spark.readStream if stream else spark.read).schema(OBSERVATION).json(path))


def read_identities(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return _shaped((spark.readStream if stream else spark.read).schema(IDENTITY).json(path))


def write_log(df: DataFrame, path: str, by: list[str]) -> None:
    """One JSON object a row, in a folder for each run and camera."""
    df.write.partitionBy(*by).json(path)


def read_payments(spark: SparkSession, path: str) -> DataFrame:
    """time_sec, items (1 where blank), person_id; rows without a time are skipped."""
    df = spark.read.option("header", True).schema("time_sec double, items int, person_id long").csv(path)
    return df.where("time_sec is not null").withColumn("items", F.coalesce("items", F.lit(1)))


def read_sensor_events(spark: SparkSession, path: str) -> DataFrame:
    """time_ms, slot, delta_g, confidence (1 where blank)."""
    df = spark.read.option("header", True).schema("time_sec double, slot string, delta_g double, confidence double").csv(path)
    return df.select(F.bround(F.col("time_sec") * 1000).cast("long").alias("time_ms"), "slot", "delta_g", F.coalesce("confidence", F.lit(1.0)).alias("confidence"))


def lane_sensor_rows(df: DataFrame, offset_ms: int, lanes: list[str]) -> DataFrame:
    """Lane rows inside the recording, removals and additions of the given lanes, on the video's clock."""
    return df.where((F.col("in_video") == 1) & F.col("event").isin("REMOVE", "ADD") & F.col("lane").isin(*lanes)).withColumn("time_ms", F.col("time_ms") + offset_ms)


#: What the six fields of a line of the event log look like. Fixed formats.
EVENT_FIELDS = {"time": r"[0-9]{2}:[0-9]{2}:[0-9]{2}", "lane": r"L[0-9]+", "event": r"[A-Z_]+", "change": r"[0-9]+→[0-9]+", "distance": r"[0-9.]+|-", "text": r"(?s).*"}


def parse_event_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """at_sec (of the day), lane, event, before, after, distance_mm (null for -), product from log lines; other lines are skipped.

    A line is split on blanks into time, lane, event, change, distance and text; the product is the second part of a text
    that is cut at slashes, else empty.
    """
    rest = [F.col(c) for c in lines.columns if c != text]
    cut = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", 6)
    f = lines.select(*rest, F.explode(F.array(cut)).alias("_cut"))  # a row of its own, so that a line is cut once and not again for each field and filter
    f = f.select(*rest, *[F.get("_cut", F.lit(i)).alias(f"_{n}") for i, n in enumerate(EVENT_FIELDS)])
    for name, form in EVENT_FIELDS.items():
        f = f.where(F.col(f"_{name}").rlike(f"^(?:{form})$"))
    hours, minutes, seconds = (F.substring("_time", i, 2).cast("long") for i in (1, 4, 7))
    at = (hours * 60 + minutes) * 60 + seconds
    return f.select(
        *rest, at.alias("at_sec"), F.col("_lane").alias("lane"), F.col("_event").alias("event"), F.substring_index("_change", "→", 1).try_cast("int").alias("before"), F.substring_index("_change", "→", -1).try_cast("int").alias("after"),
        F.col("_distance").try_cast("double").alias("distance_mm"), F.coalesce(F.trim(F.get(F.split("_text", "/"), F.lit(1))), F.lit("")).alias("product"),
    )


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A label table: columns by the header's names, blanks as null."""
    names = [c.split()[0] for c in schema.split(", ")]
    df = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("enforceSchema", False).csv(path, schema=", ".join(f"{n} string" for n in names))
    clean = lambda n: F.when(F.trim(n) != "", F.trim(n))
    return df.select(*[clean(n).try_cast(k).alias(n) for n, k in (c.split() for c in schema.split(", "))])


def read_take_labels(spark: SparkSession, path: str) -> DataFrame:
    """pair, seq, time_sec, lane, action, qty, checked_by, note of takes and returns that have a time."""
    return _csv(spark, path, "pair string, seq int, time_sec double, lane string, action string, qty int, checked_by string, note string").where(F.col("time_sec").isNotNull() & F.col("action").isin("take", "return"))


def read_payment_labels(spark: SparkSession, path: str) -> DataFrame:
    """pair, attempt, time_sec (null where blank), items, result, checked_by, note; blank numbers count 0."""
    return _csv(spark, path, "pair string, attempt int, time_sec double, items int, result string, checked_by string, note string").fillna(0, ["attempt", "items"]).fillna("", ["checked_by", "note"])


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """pair, expected verdict, people, set."""
    return _csv(spark, path, "pair string, expected string, people int, set string")


def read_sensor_check(spark: SparkSession, path: str) -> DataFrame:
    """pair, kind, lane, direction, label_sec, sensor_lane, sensor_sec, dt."""
    return _csv(spark, path, "pair string, kind string, lane string, direction string, label_sec double, sensor_lane string, sensor_sec double, dt double")


def sensor_kinds(check: DataFrame) -> DataFrame:
    """The kind of each label that has a time, by pair, lane, direction and rounded ms; the last row of a key holds (largest sensor time, then kind)."""
    keyed = check.where("label_sec is not null").select("pair", "lane", "direction", F.bround(F.col("label_sec") * 1000).cast("long").alias("label_ms"), "kind", "sensor_sec")
    return keyed.groupBy("pair", "lane", "direction", "label_ms").agg(F.max_by("kind", F.struct("sensor_sec", "kind")).alias("kind"))


def problem_rows(check: DataFrame, kinds: list[str], pairs: list[str] | None = None) -> DataFrame:
    """The rows of problem kinds with `at` (the label's time, else the sensor's, else 0), by pair in natural order and time."""
    d = check.where(F.col("kind").isin(kinds))
    if pairs:
        d = d.where(F.col("pair").isin(pairs))
    number = F.regexp_extract("pair", r"(\d+)", 1).try_cast("long")
    return d.withColumn("at", F.coalesce("label_sec", "sensor_sec", F.lit(0.0))).orderBy(F.regexp_extract("pair", r"^(\D*)", 1), number, "pair", "at")


def parse_measurements(lines: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good, bad): messages with their required fields, and lines set aside with a reason."""
    d = lines.withColumn("m", F.from_json(text, MEASUREMENT + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    missing = F.col("m.device_id").isNull() | F.col("m.boot_id").isNull() | F.col("m.sequence").isNull() | F.col("m.lane_id").isNull()
    reason = F.when(F.col("m").isNull() | F.col("m._corrupt").isNotNull(), "not JSON of this shape").when(missing, "a required field is missing").when(F.col("m.valid") & F.col("m.distance_mm").isNull(), "valid without a distance")
    d = d.withColumn("reason", reason)
    other = [c for c in lines.columns if c != text]
    return d.where("reason is null").select(*other, "m.*").drop("_corrupt"), d.where("reason is not null").select(*lines.columns, "reason")


def cvat_events(tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(intervals, problems) from rows (stem, label, frame) whose labels end in _start or _end.

    The n-th start of an action pairs with its n-th end; counts that differ and ends before starts are problems.
    """
    from pyspark.sql import Window

    t = tracks.withColumn("action", F.regexp_replace("label", "_(start|end)$", "")).withColumn("side", F.regexp_extract("label", "_(start|end)$", 1)).where("side <> ''")
    t = t.withColumn("n", F.row_number().over(Window.partitionBy("stem", "action", "side").orderBy("frame")))
    p = t.groupBy("stem", "action", "n").agg(F.min(F.when(F.col("side") == "start", F.col("frame"))).alias("start_frame"), F.min(F.when(F.col("side") == "end", F.col("frame"))).alias("end_frame"))
    why = F.when(F.col("start_frame").isNull(), "end without start").when(F.col("end_frame").isNull(), "start without end").when(F.col("end_frame") < F.col("start_frame"), "end before start")
    p = p.withColumn("problem", why)
    return p.where("problem is null").drop("problem", "n"), p.where("problem is not null").select("stem", "action", "n", "problem")


def read_cvat_tracks(spark: SparkSession, path: str) -> DataFrame:
    """(stem, label, frame) of every track in annotation XML files."""
    df = spark.read.format("xml").option("rowTag", "track").schema("_label string, box array<struct<_frame:long,_outside:int>>").load(path)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.xml$", 1)
    return df.select(stem.alias("stem"), F.col("_label").alias("label"), F.array_min(F.transform("box", lambda b: b["_frame"])).alias("frame"))


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """image, file_name, category, x, y, w, h of every annotation of an export."""
    schema = "images array<struct<id:long,file_name:string,width:int,height:int>>, annotations array<struct<image_id:long,category_id:long,bbox:array<double>>>, categories array<struct<id:long,name:string>>"
    d = spark.read.schema(schema).option("multiLine", True).json(path)
    im = d.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name")
    an = d.select(F.explode("annotations").alias("a")).select("a.*")
    ca = d.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("category"))
    at = lambda i: F.get("bbox", F.lit(i))
    return an.join(im, "image_id").join(ca, "category_id").select("image_id", "file_name", "category", at(0).alias("x"), at(1).alias("y"), at(2).alias("w"), at(3).alias("h"))


def yolo_boxes(lines: DataFrame, width: Column, height: Column, text: str = "value") -> DataFrame:
    """class and pixel box of `cls cx cy w h` lines."""
    p = F.split(F.trim(text), " +")
    v = lambda i: F.get(p, F.lit(i)).cast("double")
    rest = [c for c in lines.columns if c != text]
    return lines.where(F.size(p) == 5).select(*rest, F.get(p, F.lit(0)).cast("int").alias("cls"), ((v(1) - v(3) / 2) * width).alias("x1"), ((v(2) - v(4) / 2) * height).alias("y1"), ((v(1) + v(3) / 2) * width).alias("x2"), ((v(2) + v(4) / 2) * height).alias("y2"))


def zone_rows(zones: list[dict], normalized: bool = False) -> list[tuple]:
    """Checked zone definitions; `normalized` is inherited where a zone doesn't say."""
    out = []
    for z in zones:
        if len(z["polygon"]) < 3:
            raise ValueError(f"zone {z['name']} has fewer than three points")
        out.append((z["name"], z.get("type", "OTHER"), [(float(x), float(y)) for x, y in z["polygon"]], bool(z.get("normalized", normalized))))
    return out


def zones_table(spark: SparkSession, zones: list[dict], normalized: bool = False) -> DataFrame:
    return spark.createDataFrame(zone_rows(zones, normalized), "zone string, type string, poly array<struct<x:double,y:double>>, normalized boolean")


def upsert_sync(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Offsets by pair and video; the last write of a key wins."""
    from ..operators.ledger import latest

    a, b = old.withColumn("_v", F.lit(0)), new.withColumn("_v", F.lit(1) + F.monotonically_increasing_id())
    return latest(a.unionByName(b), keys, ["_v"]).drop("_v")


def files(spark: SparkSession, paths: list[str], glob: str) -> DataFrame:
    """stem, root number, path, length; the first root that has a stem wins."""
    from ..operators.joins import top_one

    found = None
    for i, p in enumerate(paths):
        f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(p).select("path", "length", F.lit(i).alias("root"))
        found = f if found is None else found.unionByName(f)
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return top_one(found.withColumn("stem", stem), ["stem"], [F.col("root"), F.col("path")])


def manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, bytes, sha1 of each file."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return f.select("path", F.col("length").alias("bytes"), F.sha1("content").alias("sha1"))


def publish_splits(rows: DataFrame, path: str) -> None:
    """One folder of lists for each split and camera."""
    rows.write.partitionBy("split", "camera").csv(path)


def order_history(orders: DataFrame, items_json: str, newest: str, n: int) -> DataFrame:
    """Newest orders with their items parsed and counted."""
    items = F.from_json(items_json, "array<struct<barcode:string,name:string,price:bigint,qty:bigint>>")
    d = orders.orderBy(F.desc(newest)).limit(n).withColumn("items", items)
    total = F.aggregate("items", F.lit(0).cast("bigint"), lambda s, i: s + i["price"] * i["qty"])
    return d.withColumn("item_count", F.aggregate("items", F.lit(0).cast("bigint"), lambda s, i: s + i["qty"])).withColumn("total", total)
