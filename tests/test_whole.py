"""Queries against their rule on whole tables, where the oracle's SQL reads a subset of ids."""

import os

import duckdb
import pytest

from storeflow.plans import joins, matching, reports

from .test_registry import DATA, TABLES, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize(("plans", "name", "subset"), [(reports, "a17_box_stability", " WHERE l_orderkey % 20 = 0"), (joins, "j18_event_spans", " WHERE o_orderkey % 40 = 0")])
def test_no_id_is_left_out(spark, duck, plans, name, subset):
    sql = plans.ORACLES[name].replace(subset, "")
    assert rows(plans.QUERIES[name](spark, DATA).toArrow()) == rows(duck.sql(sql).to_arrow_table())


def test_shelves_are_all_ordered(spark):
    li = spark.read.parquet(f"{DATA}/lineitem.parquet")
    got = matching.k4_reading_order(spark, DATA)
    assert got.count() == li.count()
    assert got.select("shelf").distinct().count() == li.select("l_orderkey").distinct().count()


def test_lanes_are_judged_on_all_references(spark, tmp_path):
    refs = {1: [90, 80, 70, 60, 50, 55], 2: [90, 80, 70, 60, 50, 45], 3: [90, 80, 70, 60, 50, 40], 4: [7], 5: [9, 9]}
    li = [(lane, k, 1, 1, float(v)) for lane, vs in refs.items() for k, v in enumerate(vs)]
    spark.createDataFrame(li, "l_suppkey long, l_orderkey long, l_linenumber long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(map(tuple, reports.p11_lane_consistency(spark, str(tmp_path)).collect()))
    assert got == [(1, True, True), (2, False, True), (3, False, False), (4, False, False), (5, True, True)]
