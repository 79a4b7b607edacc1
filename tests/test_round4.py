"""Findings of round 4: results that are laid out in runs, equal and unknown intervals."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np

from storeflow.operators import joins as j
from storeflow.plans import joins, windows

from .test_round3 import by_sql, event_table, same


def order_table(spark, path, rows):
    """orders.parquet of (key, customer, milliseconds since 1996 or None)."""
    base = dt.datetime(1996, 1, 1, tzinfo=dt.UTC)
    data = [(k, c, None if ms is None else base + dt.timedelta(milliseconds=ms)) for k, c, ms in rows]
    spark.createDataFrame(data, "o_orderkey long, o_custkey long, o_orderdate timestamp").selectExpr("o_orderkey", "o_custkey", "cast(o_orderdate as timestamp_ntz) as o_orderdate", "1.0D as o_totalprice").coalesce(1).write.mode("overwrite").parquet(f"{path}/orders.parquet")


def test_rows_of_recordings_of_one_span_follow_each_other(spark, tmp_path):
    rnd = random.Random(1)
    day = 86_400_000
    event_table(spark, tmp_path, [(i, rnd.randrange(3 * day), 1, "error", 1.0) for i in range(300)])
    order_table(spark, tmp_path, [(i, 1, rnd.randrange(30) * day) for i in range(20_000)])
    t = joins.j18_event_spans(spark, str(tmp_path)).toArrow()
    got = {c: t[c].to_numpy(zero_copy_only=False) for c in t.column_names}
    assert t.num_rows == by_sql(tmp_path, f"SELECT count(*) FROM ({joins.ORACLES['j18_event_spans']})", "events", "orders")[0][0] > 50_000
    assert len(set(zip(got["event_id"].tolist(), got["span"].tolist(), strict=True))) == t.num_rows
    for c in ("event_id", "rel_ms", "in_video"):
        assert np.count_nonzero(got[c][1:] != got[c][:-1]) < t.num_rows / 50


def test_spans_on_odd_rows(spark, tmp_path):
    rnd = random.Random(2)
    ms = [*(rnd.randrange(40) * 3_600_000 + rnd.choice([0, -3200, -3201, 9200, 9201, 1, 600_000]) for _ in range(150)), -1, 43_200_000, 43_199_999]
    event_table(spark, tmp_path, [(rnd.choice([i, i, None]), t, 1, rnd.choice(["error", "error", "view", None]), 1.0) for i, t in enumerate(ms)])
    orders = [(rnd.choice([i, i, -i, 7, None]), 1, rnd.choice([None, rnd.randrange(40) * 86_400_000, rnd.randrange(40) * 86_400_000 + 1, -rnd.randrange(10**12)])) for i in range(600)]
    order_table(spark, tmp_path, orders)
    assert len(same(joins.j18_event_spans(spark, str(tmp_path)), by_sql(tmp_path, joins.ORACLES["j18_event_spans"], "events", "orders"))) > 300


def test_lists_hold_every_id_once(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([1, 2, None]), i) for i in range(1000)] + [(1, None), (3, None), (4, 5), (4, 5)]
    lists = [tuple(r) for r in j.listed(spark.createDataFrame(rows, "k int, i long"), ["k"], "i", 7).collect()]
    assert sorted(((k, i) for k, ids in lists for i in ids), key=str) == sorted((r for r in rows if r[1] is not None), key=str)
    assert all(0 < len(ids) <= 7 for _, ids in lists) and len(lists) < 150


def test_equal_and_unknown_intervals_merge_as_in_the_sql(spark, tmp_path):
    rnd = random.Random(4)
    day = 86_400_000
    rows = [(rnd.choice([i, i, -i, None]), rnd.choice([*range(20), None]), rnd.choice([None, *(rnd.randrange(60) * day for _ in range(5))])) for i in range(1200)]
    order_table(spark, tmp_path, rows)
    sql = windows.ORACLES["w3_coalesce_intervals"]
    told = sql.replace("ORDER BY s, e ", "ORDER BY s, e, id ")  # the SQL leaves open in which order equal intervals come
    got = same(windows.w3_coalesce_intervals(spark, str(tmp_path)), by_sql(tmp_path, told, "orders"))
    assert told.count("e, id ROWS") == 2 and sum(r[1] == "None" for r in got) > 50


def test_equal_intervals_merge_in_any_order(spark):
    rows = [(1, 1, 0, -5), (1, 1, 0, -5), (1, 1, 0, 4), (1, 1, 0, 4), (1, 1, 20, 25), (1, 1, 20, 25), (1, 1, 20, 25), (1, 1, 26, 22), (1, 1, 26, 22), (1, 1, 40, 30), (1, 1, 40, 30), (1, 1, 50, None), (1, 1, 50, None)]
    for _ in range(5):
        random.Random(len(rows)).shuffle(rows)
        got = windows.w.coalesce_intervals(spark.createDataFrame(rows, "k int, x int, s long, e long"), ["k"], "s", "e", 2)
        assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 0, -5, 1), (1, 0, -5, 1), (1, 0, 4, 2), (1, 20, 25, 5), (1, 40, 30, 1), (1, 40, 30, 1), (1, 50, None, 1), (1, 50, None, 1)], key=str)
