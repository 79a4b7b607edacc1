"""Geometry queries: boxes from lineitem's numbers, zones as literal dimensions, vectors from embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import joins as j
from ..sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


ZONES = {"shelf": [(0, 0), (40, 5), (35, 45), (5, 40)], "exit": [(30, 10), (60, 10), (45, 50)], "checkout": [(10, 30), (50, 30), (50, 60), (30, 45), (10, 60)]}

#: lineitem as boxes of a frame (the order), one object a line.
BOX_SQL = "bx AS (SELECT l_orderkey AS frame, l_linenumber AS id, l_partkey AS part, l_quantity AS x1, l_discount * 400 AS y1, l_quantity + 4 + l_linenumber * 2 AS x2, l_discount * 400 + 6 + l_tax * 300 AS y2 FROM lineitem)"


def boxes(spark, d):
    li = table(spark, d, "lineitem")
    x1, y1 = F.col("l_quantity"), F.col("l_discount") * 400
    return li.select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("id"), F.col("l_partkey").alias("part"), g.box(x1, y1, x1 + 4 + F.col("l_linenumber") * 2, y1 + 6 + F.col("l_tax") * 300).alias("b"))


def zone_dim(spark):
    rows = [(n, [(float(x), float(y)) for x, y in p]) for n, p in ZONES.items()]
    return spark.createDataFrame(rows, "zone string, poly array<struct<x:double,y:double>>").withColumn("sides", g.edges(F.col("poly")))


_ZONE_SQL = "zn(zone, poly) AS (VALUES " + ", ".join(f"('{n}', [{', '.join(f'{{x: {float(x)}, y: {float(y)}}}' for x, y in p)}])" for n, p in ZONES.items()) + ")"
_EDGE_SQL = "ed AS (SELECT zone, poly[i] AS a, poly[i % len(poly) + 1] AS b FROM zn, LATERAL (SELECT unnest(range(1, len(poly) + 1)) AS i))"
_INSIDE = "(a.y > py) <> (b.y > py) AND px < (b.x - a.x) * (py - a.y) / (b.y - a.y) + a.x"
_AT = "pt AS (SELECT row_number() OVER () AS rid, frame, id, x1, y1, x2, y2, (x1 + x2) / 2 AS px, y2 AS py FROM bx)"


@query(f"""WITH {BOX_SQL}, {_ZONE_SQL}, {_EDGE_SQL}, {_AT},
c AS (SELECT rid, frame, id, zone, count(*) FILTER ({_INSIDE}) % 2 = 1 AS inside FROM pt, ed GROUP BY ALL)
SELECT frame, id, zone FROM c WHERE inside""")
def g1_foot_in_zone(spark, d):
    """Boxes joined with the zones their foot stands in; zones are known beforehand, so the join is one expression a side."""
    b = boxes(spark, d).withColumn("px", (F.col("b.x1") + F.col("b.x2")) / 2).withColumn("py", F.col("b.y2"))
    zones = F.array_compact(F.array(*[F.when(g.inside_literal(p, F.col("px"), F.col("py")), n) for n, p in ZONES.items()]))
    return b.select("frame", "id", F.explode(zones).alias("zone"))


@query(f"""WITH {_ZONE_SQL}, {_EDGE_SQL}, zz AS (SELECT zone, abs(sum(a.x * b.y - b.x * a.y)) / 2 AS area FROM ed GROUP BY zone),
{BOX_SQL} SELECT zone, round(area, 6) AS area, (SELECT count(*) FROM bx WHERE (x2 - x1) * (y2 - y1) > area) AS larger FROM zz""")
def g2_polygon_area(spark, d):
    z = zone_dim(spark).withColumn("area", g.polygon_area(F.col("poly")))
    larger = boxes(spark, d).join(F.broadcast(z.select("zone", "area")), g.area(F.col("b")) > F.col("area")).groupBy("zone").agg(F.count(F.lit(1)).alias("larger"))  # three zones
    return z.join(larger, "zone", "left").select("zone", F.round("area", 6).alias("area"), F.coalesce("larger", F.lit(0)).alias("larger"))


@query(f"""WITH {BOX_SQL} SELECT frame, id, round(least(greatest(least(x2, 40) - greatest(x1, 10), 0) * greatest(least(y2, 50) - greatest(y1, 5), 0) / ((x2 - x1) * (y2 - y1)), 1), 6) AS ratio FROM bx""")
def g4_overlap_ratio(spark, d):
    """Clip a rectangle given as a polygon, so that the oracle has a closed form."""
    poly = [(10, 5), (40, 5), (40, 50), (10, 50)]
    return boxes(spark, d).select("frame", "id", F.round(g.overlap_ratio(poly, F.col("b")), 6).alias("ratio"))


@query(f"""WITH {BOX_SQL}, {_ZONE_SQL}, {_EDGE_SQL}, {_AT}, q AS (SELECT rid, frame, id, zone, px, py, a, b, b.x - a.x AS dx, b.y - a.y AS dy FROM pt, ed),
t AS (SELECT *, least(greatest(((px - a.x) * dx + (py - a.y) * dy) / (dx * dx + dy * dy), 0), 1) AS t FROM q)
SELECT frame, id, zone, round(CASE WHEN count(*) FILTER ({_INSIDE}) % 2 = 1 THEN 0 ELSE min(sqrt((px - a.x - t * dx) ** 2 + (py - a.y - t * dy) ** 2)) END, 5) AS distance FROM t GROUP BY rid, frame, id, zone""")
def g5_distance_to_polygon(spark, d):
    """The zones are known beforehand, so each side is a few steps over a batch of boxes."""
    b = boxes(spark, d).withColumn("px", (F.col("b.x1") + F.col("b.x2")) / 2).withColumn("py", F.col("b.y2"))
    zones = F.array(*[F.struct(F.lit(n).alias("zone"), F.round(g.literal_distance(p, F.col("px"), F.col("py")), 5).alias("distance")) for n, p in ZONES.items()])
    return b.select("frame", "id", F.inline(zones))


_PAIR = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"


@query(f"""WITH {BOX_SQL}, p AS (SELECT a.frame, a.id AS a_id, b.id AS b_id, {_PAIR} AS i, (a.x2 - a.x1) * (a.y2 - a.y1) AS aa, (b.x2 - b.x1) * (b.y2 - b.y1) AS ab FROM bx a JOIN bx b ON a.frame = b.frame AND a.id < b.id)
SELECT frame, a_id, b_id, round(i / (aa + ab - i), 6) AS score, round(i / least(aa, ab), 6) AS nested FROM p WHERE i / (aa + ab - i) >= 0.1""")
def j8_concurrent_pairs(spark, d):
    """Objects of one frame whose boxes overlap."""
    p = j.concurrent_pairs(boxes(spark, d).drop("part"), ["frame"], "id", g.iou(F.col("a_b"), F.col("b_b")), 0.1)
    return p.select("frame", "a_id", "b_id", F.round("score", 6).alias("score"), F.round(g.nested(F.col("a_b"), F.col("b_b")), 6).alias("nested"))


@query(f"""WITH {BOX_SQL} SELECT a.frame, a.id FROM bx a WHERE EXISTS (SELECT 1 FROM bx b WHERE a.frame = b.frame AND a.id <> b.id AND b.y2 > a.y2
 AND (a.x1 + a.x2) / 2 BETWEEN b.x1 - 0.05 * (b.x2 - b.x1) AND b.x2 + 0.05 * (b.x2 - b.x1) AND a.y2 BETWEEN b.y1 - 0.05 * (b.y2 - b.y1) AND b.y2 + 0.05 * (b.y2 - b.y1))""")
def p17_behind_another(spark, d):
    a = boxes(spark, d).select("frame", "id", F.col("b").alias("a"))
    b = boxes(spark, d).select(F.col("frame").alias("f2"), F.col("id").alias("id2"), "b")
    w, h = F.col("b.x2") - F.col("b.x1"), F.col("b.y2") - F.col("b.y1")
    inside = ((F.col("a.x1") + F.col("a.x2")) / 2).between(F.col("b.x1") - 0.05 * w, F.col("b.x2") + 0.05 * w) & F.col("a.y2").between(F.col("b.y1") - 0.05 * h, F.col("b.y2") + 0.05 * h)
    return a.join(b, (F.col("frame") == F.col("f2")) & (F.col("id") != F.col("id2")) & (F.col("b.y2") > F.col("a.y2")) & inside, "left_semi").select("frame", "id")


@query(f"""WITH {BOX_SQL}, p AS (SELECT frame, id, 0.0008 * x1 + 0.0005 * y1 + 0.95 AS w, 1.2 * x1 + 0.1 * y1 + 3 AS u, -0.05 * x1 + 0.9 * y1 + 7 AS v FROM bx)
SELECT frame, id, CASE WHEN w > 0.96 THEN round(u / w, 6) END AS fx, CASE WHEN w > 0.96 THEN round(v / w, 6) END AS fy FROM p""")
def g9_apply_homography(spark, d):
    p = boxes(spark, d).withColumn("p", g.apply_homography([1.2, 0.1, 3, -0.05, 0.9, 7, 0.0008, 0.0005, 0.95], F.col("b.x1"), F.col("b.y1"), 0.96))
    return p.select("frame", "id", F.round("p.x", 6).alias("fx"), F.round("p.y", 6).alias("fy"))


_ANKLES_SQL = """k AS (SELECT *, CASE WHEN id % 2 = 0 THEN 0.9 ELSE 0.3 END AS c1, 0.7 AS c2, x1 + 1 AS ax, y2 - 1 AS ay, x2 + 9 AS bx_, y2 AS by_ FROM bx),
f AS (SELECT *, c1 >= 0.5 AND ax BETWEEN x1 - 0.05 * (x2 - x1) AND x2 + 0.05 * (x2 - x1) AS ok1 FROM k)"""


def _ankles():
    """Ankle 1 is confident for even ids; ankle 2 stands outside the padded box."""
    b = F.col("b")
    return F.array(F.struct((b["x1"] + 1).alias("x"), (b["y2"] - 1).alias("y"), F.when(F.col("id") % 2 == 0, 0.9).otherwise(0.3).alias("conf")), F.struct((b["x2"] + 9).alias("x"), b["y2"].alias("y"), F.lit(0.7).alias("conf")))


@query(f"""WITH {BOX_SQL}, {_ANKLES_SQL}
SELECT frame, id, round(CASE WHEN ok1 THEN ax ELSE (x1 + x2) / 2 END, 6) AS fx, round(CASE WHEN ok1 THEN ay ELSE y2 END, 6) AS fy FROM f""")
def g8_foot_pixel(spark, d):
    p = boxes(spark, d).withColumn("k", _ankles()).withColumn("p", g.foot_pixel(F.col("b"), F.col("k")))
    return p.select("frame", "id", F.round("p.x", 6).alias("fx"), F.round("p.y", 6).alias("fy"))


@query(f"""WITH {BOX_SQL}, {_ANKLES_SQL}, q AS (SELECT frame, id, CASE WHEN ok1 THEN ax ELSE (x1 + x2) / 2 END AS x, CASE WHEN ok1 THEN ay ELSE y2 END AS y FROM f),
p AS (SELECT frame, id, 0.0008 * x + 0.0005 * y + 0.95 AS w, 1.2 * x + 0.1 * y + 3 AS u, -0.05 * x + 0.9 * y + 7 AS v FROM q)
SELECT frame, id, CASE WHEN w > 0.96 THEN round(u / w, 6) END AS fx, CASE WHEN w > 0.96 THEN round(v / w, 6) END AS fy FROM p""")
def g14_floor_point(spark, d):
    """Where a person stands on the floor, from the ankles or the box's foot."""
    h = [1.2, 0.1, 3, -0.05, 0.9, 7, 0.0008, 0.0005, 0.95]
    p = boxes(spark, d).withColumn("k", _ankles()).withColumn("p", g.floor_point(F.col("b"), F.col("k"), h, 0.96))
    return p.select("frame", "id", F.round("p.x", 6).alias("fx"), F.round("p.y", 6).alias("fy"))


@query(f"""WITH {BOX_SQL} SELECT frame, id, round((y1 - 5) / 30.0, 6) AS band, round(CASE WHEN px - ox > 0 THEN abs(py) ELSE sqrt((px - ox) ** 2 + py ** 2) END, 6) AS ray FROM (SELECT *, x1 AS px, y1 AS py, 12.0 AS ox FROM bx)""")
def g13_floor_distance(spark, d):
    """Position in a band, and distance from a ray along x that starts at 12."""
    x, y = F.col("b.x1"), F.col("b.y1")
    return boxes(spark, d).select("frame", "id", F.round(g.band_position(y, F.lit(5.0), F.lit(35.0)), 6).alias("band"), F.round(g.ray_distance(x, y, F.lit(12.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)), 6).alias("ray"))


@query(f"""WITH {BOX_SQL}, k AS (SELECT *, sqrt((x2 - x1 - 1) ** 2 + 4) / (y2 - y1) AS ext FROM bx)
SELECT frame, id, round(ext, 6) AS extension, round((y2 - (y1 + 2)) / (y2 - y1), 6) AS hand_height, CASE WHEN id % 3 = 0 THEN 1 ELSE 2 END AS wrists, round(2.0 / (x2 - x1), 6) AS gap FROM k""")
def g16_pose_features(spark, d):
    """Wrists, arm extension, hand height and the gap between two poses."""
    b = F.col("b")
    h = b["y2"] - b["y1"]
    wrist = F.struct(b["x2"].alias("x"), (b["y1"] + 2).alias("y"), F.lit(0.9).alias("conf"))
    other = F.struct(b["x1"].alias("x"), b["y1"].alias("y"), F.when(F.col("id") % 3 == 0, 0.2).otherwise(0.6).alias("conf"))
    shoulder = F.struct((b["x1"] + 1).alias("x"), b["y1"].alias("y"))
    moved = lambda k: F.struct((k["x"] + 2).alias("x"), k["y"].alias("y"), F.lit(0.9).alias("conf"))
    p = boxes(spark, d).withColumn("k", F.array(wrist, other)).withColumn("m", F.transform("k", moved))
    return p.select(
        "frame", "id", F.round(g.extension(wrist, shoulder, h), 6).alias("extension"), F.round((b["y2"] - wrist["y"]) / h, 6).alias("hand_height"),
        F.size(F.filter("k", lambda k: k["conf"] >= 0.5)).alias("wrists"), F.round(g.pose_gap(F.col("k"), F.col("m"), b["x2"] - b["x1"]), 6).alias("gap"),
    )


@query("""WITH m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, range(1, 65) t(i) GROUP BY label, i),
n AS (SELECT label, list(v ORDER BY i) AS mean FROM m GROUP BY label),
s AS (SELECT vec_id, e.label, list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * mean[i])) AS dt, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS ee, list_sum(list_transform(mean, lambda x: x * x)) AS mm FROM embeddings e JOIN n ON e.label = n.label)
SELECT vec_id, label, round(least(greatest(dt / sqrt(ee * mm), 0), 1), 5) AS similarity FROM s""")
def g21_similarity_to_mean(spark, d):
    """Cosine of each vector with its label's mean vector; the means are added up per task before they meet."""
    e = table(spark, d, "embeddings")
    m = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    mean = m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("mean"))
    return e.join(mean, "label").select("vec_id", "label", F.round(g.cosine(F.col("embedding"), F.col("mean")), 5).alias("similarity"))


@query("""WITH e AS (SELECT event_id, 60.0 + value AS mm FROM events)
SELECT event_id, round(CASE WHEN mm >= 200 THEN (250 - mm) / 50 WHEN mm >= 140 THEN 1 + (200 - mm) / 60 WHEN mm >= 100 THEN 2 + (140 - mm) / 40 ELSE 3 + (100 - mm) / 30 END, 6) AS count FROM e""")
def g23_continuous_count(spark, d):
    return table(spark, d, "events").select("event_id", F.round(g.interpolate(60.0 + F.col("value"), [250.0, 200.0, 140.0, 100.0, 70.0]), 6).alias("count"))


@query(f"""WITH {BOX_SQL}, o AS (SELECT frame, id, x1, y1 FROM bx), p AS (SELECT a.frame, a.id AS i, b.id AS j, least(sqrt((a.x1 - b.x1) ** 2 + (a.y1 - b.y1) ** 2), 15.0) AS dist FROM o a JOIN o b ON a.frame = b.frame AND a.id % 2 = 0 AND b.id % 2 = 1),
u AS (SELECT frame, avg(m) AS f FROM (SELECT frame, i, min(dist) AS m FROM p GROUP BY 1, 2) GROUP BY 1), v AS (SELECT frame, avg(m) AS f FROM (SELECT frame, j, min(dist) AS m FROM p GROUP BY 1, 2) GROUP BY 1)
SELECT frame, round((u.f + v.f) / 2, 6) AS chamfer FROM u JOIN v USING (frame)""")
def g22_chamfer(spark, d):
    """Capped two-way mean nearest distance between even and odd objects of a frame."""
    o = boxes(spark, d).select("frame", "id", F.col("b.x1").alias("x"), F.col("b.y1").alias("y"))
    a, b = o.where("id % 2 = 0").toDF("frame", "i", "ax", "ay"), o.where("id % 2 = 1").toDF("frame", "j", "bx", "by")
    p = a.join(b, "frame").withColumn("dist", F.least(F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2)), F.lit(15.0)))
    side = lambda k, n: p.groupBy("frame", k).agg(F.min("dist").alias("m")).groupBy("frame").agg(F.avg("m").alias(n))
    return side("i", "u").join(side("j", "v"), "frame").select("frame", F.round((F.col("u") + F.col("v")) / 2, 6).alias("chamfer"))


@query(f"""WITH {BOX_SQL}, c AS (SELECT frame, id, greatest(x1, 5) AS x1, greatest(y1, 4) AS y1, least(x2, 40) AS x2, least(y2, 45) AS y2 FROM bx)
SELECT id, count(*) AS boxes, count(*) FILTER (x2 <= x1 OR y2 <= y1) AS outside, count(*) FILTER (x2 > x1 AND y2 > y1 AND (x2 - x1 < 3 OR y2 - y1 < 3)) AS tiny FROM c GROUP BY id""")
def p6_clip_and_drop(spark, d):
    """Boxes clipped to the picture; dropped ones counted by cause."""
    b = F.col("b")
    c = boxes(spark, d).select("id", F.greatest(b["x1"], F.lit(5)).alias("x1"), F.greatest(b["y1"], F.lit(4)).alias("y1"), F.least(b["x2"], F.lit(40)).alias("x2"), F.least(b["y2"], F.lit(45)).alias("y2"))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    out = (w <= 0) | (h <= 0)
    return c.groupBy("id").agg(F.count(F.lit(1)).alias("boxes"), F.count_if(out).alias("outside"), F.count_if(~out & ((w < 3) | (h < 3))).alias("tiny"))


@query(f"""WITH {BOX_SQL}, g AS (SELECT * FROM bx WHERE id % 2 = 1), p AS (SELECT * FROM bx WHERE id % 2 = 0),
m AS (SELECT a.frame, a.id, a.part % 3 = b.part % 3 AS same, {_PAIR} AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM g a JOIN p b ON a.frame = b.frame)
SELECT g.frame, g.id, round(coalesce(max(i / (s - i)) FILTER (same), 0), 6) AS best_same, round(coalesce(max(i / (s - i)), 0), 6) AS best_any, coalesce(max(i / (s - i)) FILTER (same), 0) >= 0.3 AS found
FROM g LEFT JOIN m ON g.frame = m.frame AND g.id = m.id GROUP BY g.frame, g.id""")
def j15_prediction_truth(spark, d):
    """Best IoU of each truth box with predictions of its class and of any class."""
    b = boxes(spark, d)
    t = b.where("id % 2 = 1").select("frame", "id", (F.col("part") % 3).alias("cls"), F.col("b").alias("a"))
    p = b.where("id % 2 = 0").select("frame", (F.col("part") % 3).alias("pcls"), "b")
    m = t.join(p, "frame", "left").withColumn("iou", g.iou(F.col("a"), F.col("b")))
    same = F.max(F.when(F.col("cls") == F.col("pcls"), F.col("iou")))
    out = m.groupBy("frame", "id").agg(F.coalesce(same, F.lit(0.0)).alias("s"), F.coalesce(F.max("iou"), F.lit(0.0)).alias("v"))
    return out.select("frame", "id", F.round("s", 6).alias("best_same"), F.round("v", 6).alias("best_any"), (F.col("s") >= 0.3).alias("found"))


@query(f"""WITH {BOX_SQL} SELECT frame, id, id >= 5 OR (x1 <= 30 AND 0.4 + id * 0.1 >= 0.6) AS candidate FROM bx""")
def p19_link_candidates(spark, d):
    """Objects already counted as inside, or with a confident ankle whose floor point is inside."""
    b = boxes(spark, d)
    return b.select("frame", "id", ((F.col("id") >= 5) | ((F.col("b.x1") <= 30) & (0.4 + F.col("id") * 0.1 >= 0.6))).alias("candidate"))


@query(f"""WITH {BOX_SQL}, m AS (SELECT *, 0.001 * x1 - 0.02 * y1 + 1 AS w FROM bx WHERE x1 > 2), f AS (SELECT *, (1.1 * x1 + 2) / w AS u, (0.9 * y1 + 1) / w AS v FROM m WHERE w > 0.3)
SELECT frame, id, round(u, 5) AS u, round(v, 5) AS v FROM f WHERE u BETWEEN 0 AND 60 AND v BETWEEN 0 AND 60""")
def p21_common_view(spark, d):
    """Rows that are whole, not beyond the horizon, and visible in the other camera."""
    b = boxes(spark, d).where("b.x1 > 2").withColumn("p", g.apply_homography([1.1, 0, 2, 0, 0.9, 1, 0.001, -0.02, 1], F.col("b.x1"), F.col("b.y1"), 0.3))
    return b.where("p is not null and p.x between 0 and 60 and p.y between 0 and 60").select("frame", "id", F.round("p.x", 5).alias("u"), F.round("p.y", 5).alias("v"))


@query(f"""WITH {BOX_SQL}, {_ZONE_SQL}, {_EDGE_SQL}, wr AS (SELECT row_number() OVER () AS rid, frame, id, x1 AS px, y1 AS py FROM bx), c AS (SELECT rid, frame, id, zone, count(*) FILTER ({_INSIDE}) % 2 = 1 AS inside FROM wr, ed GROUP BY ALL)
SELECT rid * 0 + frame AS frame, id, count(*) FILTER (inside) AS zones, coalesce(string_agg(zone, ',' ORDER BY zone) FILTER (inside), '') AS held FROM c GROUP BY rid, frame, id""")
def g18_hands_in_zones(spark, d):
    """The zones that hold a wrist. Zones travel as one array of three."""
    z = zone_dim(spark).agg(F.array_sort(F.collect_list(F.struct("zone", "sides"))).alias("zs"))
    b = boxes(spark, d).join(F.broadcast(z), how="cross").withColumn("px", F.col("b.x1")).withColumn("py", F.col("b.y1"))  # one row
    held = F.transform(F.filter("zs", lambda k: g.inside(k["sides"], F.col("px"), F.col("py"))), lambda k: k["zone"])
    return b.withColumn("h", held).select("frame", "id", F.size("h").cast("bigint").alias("zones"), F.array_join("h", ",").alias("held"))


@query("""SELECT l_partkey AS lane, l_linenumber AS n, CAST(CASE WHEN l_linenumber = 2 THEN 77 ELSE 250 - l_linenumber * (10 + l_partkey % 5) END AS DOUBLE) AS reference_mm, CAST(CASE WHEN l_linenumber = 2 THEN 4 ELSE 15 END AS DOUBLE) AS tolerance_mm FROM lineitem""")
def g24_references(spark, d):
    """Reference distance and tolerance of a count: the measured table wins over the thickness formula."""
    n = F.col("l_linenumber")
    measured = F.create_map(F.lit(2), F.struct(F.lit(77.0).alias("mm"), F.lit(4.0).alias("tol")))
    m = F.element_at(measured, n)
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("lane"), n.alias("n"), F.coalesce(m["mm"], (250 - n * (10 + F.col("l_partkey") % 5)).cast("double")).alias("reference_mm"), F.coalesce(m["tol"], F.lit(15.0)).alias("tolerance_mm"))
