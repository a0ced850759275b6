"""Jobs that must look at all rows: no caps on sessions, streets or blackouts."""

import math
import os

import numpy as np
import pytest
import slow_loops
from pyspark.sql import functions as F

from roadtrace.operators import reckon, roads
from roadtrace.queries import journeys

D = "/root/testdata/sf0.001"


def lattice(spark, size):
    rows = []
    for x in range(size):
        for y in range(size):
            for x2, y2 in ((x + 1, y), (x, y + 1)):
                if x2 < size and y2 < size:
                    a, b = f"{x}_{y}", f"{x2}_{y2}"
                    rows.append((f"{a}-{b}", a, b, x * 100.0, y * 100.0, x2 * 100.0, y2 * 100.0, 100.0))
    return spark.createDataFrame(rows, "edge string, a string, b string, ae double, an double, be double, bn double, length double")


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", ["m5_hmm_match_whole", "m6_map_aided_walk_whole"])
def test_every_row_of_every_session_is_on_the_map(spark, name):
    from roadtrace.queries import QUERIES

    out = QUERIES[name](spark, D)
    assert out.count() == spark.read.parquet(f"{D}/events.parquet").count()


def test_own_edges_have_all_within_reach(spark):
    edges = lattice(spark, 12).cache()
    points = spark.createDataFrame([("p", 120.0, 130.0), ("p", 910.0, 1010.0), ("q", 550.0, 20.0)], "key string, e double, n double")
    got = {(r["key"], r["edge"]) for r in roads.own_edges(points, edges, ["key"], 180.0).collect()}
    near = roads.near_edges(points.withColumn("i", F.monotonically_increasing_id()), edges, ["key", "i"], 180.0, 1000)
    want = {(r["key"], r["edge"]) for r in near.collect()}
    assert want <= got and len(got) < 2 * edges.count()
    assert {e for k, e in got if k == "p"} & {"9_10-10_10"} and not {e for k, e in got if k == "q"} & {"9_10-10_10"}


def test_free_vs_map_searches_all_blackouts_and_takes_truth_from_the_samples(spark):
    from roadtrace.plans import mapmatch

    # north beside a street; then with a gyro bias that sets in after a while, which only the map makes good
    rows, speeds = [], {}
    for key, drift in (("1", 0.0), ("2", 0.05)):
        v = [10.0 + math.sin(i / 9) for i in range(600)]
        speeds[key] = np.array(v)
        n = 20.0 + np.cumsum(v) / 10
        for i in range(600):
            bias = 0.01 + (drift if i % 150 >= 60 else 0.0)
            rows.append(("A", key, i, v[i], 0.0, 0.0, 303.0, float(n[i]), 0.0, 0.0, 9.81, 0.0, 0.0, 9.81, 0.0, 0.0, bias))
    schema = "driver_id string, session_key string, row_idx long, speed double, course_deg double, az_deg double, e double, n double, " + ", ".join(f"{c} double" for c in reckon.CHANNELS)
    out = mapmatch.free_vs_map(spark.createDataFrame(rows, schema), lattice(spark, 8), ["driver_id", "session_key"], ["session_key"], (100.0, 200.0), 50, step_s=1.0)
    got = {(r["session_key"], r["blackout_m"], r["track"]): r for r in out.collect()}
    assert len(got) == 8
    for (key, dist, _), r in got.items():
        assert r["blackouts"] == len(slow_loops.scan(speeds[key], dist, 50, 10.0, 5.0, 1.0, 0, 11, 1.0)) > 1
    for dist in (100.0, 200.0):
        assert got["2", dist, "free"]["median_drift"] > got["1", dist, "free"]["median_drift"] + 5
        assert got["2", dist, "map"]["median_drift"] == pytest.approx(got["1", dist, "map"]["median_drift"])
        assert got["1", dist, "map"]["median_drift"] < 12


def test_free_vs_map_computes_its_steps_once(spark):
    """The plan that is left reads tables; each Python step is in it at most twice, not once for every step behind it."""
    out = journeys.m7_free_vs_map(spark, "/root/testdata/sf0.001")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("InPandas") <= 4


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_roads_do_not_pass_through_the_driver(spark):
    """A lattice is exploded from one row, so Spark takes it for small; only the list of full cells, which has a bound, is broadcast."""
    points = spark.createDataFrame([("p", 120.0, 130.0), ("q", 410.0, 210.0)], "key string, e double, n double")
    edges = journeys.lattice(spark, D)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(roads.own_edges(points, edges, ["key"], 180.0))
    assert "BroadcastHashJoin" not in plan(roads.near_edges(points, edges, ["key"], 180.0, work=None))
    joins = [x for x in plan(roads.near_edges(points, edges, ["key"], 180.0)).splitlines() if "BroadcastHashJoin" in x]
    assert len(joins) == 2 and all("LeftOuter" in x and "BuildRight" in x for x in joins)
    blackouts = plan(journeys.m7_free_vs_map(spark, D)).splitlines()
    assert [x for x in blackouts if "SortMergeJoin [" in x and "blackout_m" in x] and not [x for x in blackouts if "BroadcastHashJoin" in x and "blackout_m" in x]


def test_blackouts_of_a_region_share_its_edges(spark, monkeypatch):
    sent, own = [], roads.own_edges
    monkeypatch.setattr(roads, "own_edges", lambda *a, **k: sent.append(own(*a, **k)) or sent[-1])
    out = journeys.m7_free_vs_map(spark, "/root/testdata/sf0.001")
    blackouts = out.where("track = 'map'").agg(F.sum("blackouts")).head()[0]
    (edges,) = sent
    assert edges.groupBy("edge").count().agg(F.max("count")).head()[0] <= 4 < blackouts


def test_trajectories_of_a_region_share_its_edges(spark, monkeypatch):
    edges = lattice(spark, 12).cache()
    rows = [(f"d{i}", t, 20.0 + 40 * t, 500.0 + i % 7) for i in range(40) for t in range(20)]
    p = spark.createDataFrame(rows, "key string, row_idx long, e double, n double")
    cand, sent = roads.near_edges_expanding(p, edges, ["key", "row_idx"]), []
    own = roads.own_edges
    monkeypatch.setattr(roads, "own_edges", lambda *a, **k: sent.append(own(*a, **k)) or sent[-1])
    out = roads.hmm_match(p, cand, edges, ["key"], 400.0, cap=400.0).collect()
    assert len(out) == len(rows) and all(r["matched"] and r["match_n"] == 500.0 and r["match_e"] == 20.0 + 40 * r["row_idx"] for r in out)
    assert sum(x.count() for x in sent) <= 2 * edges.count()


def test_regions_are_dealt_where_many_points_meet(spark):
    p = spark.createDataFrame([(None if i == 0 else f"k{i}", 5.0, 5.0) for i in range(400)] + [("far", 9000.0, 5.0)], "key string, e double, n double")
    out = roads.regions(p, ["key"], 1000.0, shared=100).collect()
    assert len(out) == 401 and len({tuple(r[c] for c in roads.REGION) for r in out}) == 5


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", ["m6_map_aided_walk", "m6_map_aided_walk_whole", "m4_route_distance"])
def test_sessions_of_a_region_share_its_edges(spark, monkeypatch, name):
    """Copies of the sessions at the same places send no more edges."""
    sent, own = [], roads.own_edges
    monkeypatch.setattr(roads, "own_edges", lambda *a, **k: sent.append(own(*a, **k)) or sent[-1])
    getattr(journeys, name)(spark, D)
    sessions = spark.read.parquet(f"{D}/events.parquet").select("user_id").distinct().count()
    (edges,) = sent
    assert edges.groupBy("edge").count().agg(F.max("count")).head()[0] <= 4 < sessions
