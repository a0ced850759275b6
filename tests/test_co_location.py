"""Bucketed recordings meet without a shuffle; full cells are dealt to several tasks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadtrace.operators import aggregates, joins, roads
from roadtrace.sources import sinks

KEYS = ["driver_id", "session_key"]


@pytest.fixture
def sides(spark, tmp_path):
    n = 400
    key = [("A", "x"), ("A", "y"), (None, "x"), ("B", None)]
    rows = [(*key[min(i % 8, 3)], i // 8 if i % 8 < 3 else i, 0.1 * i, float(i % 50), 52.0 + i * 1e-5, -1.5) for i in range(n)]
    phone = spark.createDataFrame(rows, "driver_id string, session_key string, row_idx int, phone_t double, phone_speed_kmh double, lat double, lon double")
    vehicle = phone.select(*KEYS, "row_idx", F.col("phone_t").alias("vehicle_t"), (F.col("phone_speed_kmh") * 1.1).alias("velocity_kmh"), F.col("lat").alias("vehicle_lat"), F.col("lon").alias("vehicle_lon"))
    names = []
    for name, df in (("phone", phone), ("vehicle", vehicle)):
        names.append(f"t_{name}_{tmp_path.name.replace('-', '_')}")
        sinks.write_bucketed(df, names[-1], KEYS, buckets=5, path=str(tmp_path / name))
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    joins.co_located(spark)
    yield phone, vehicle, *map(spark.table, names)
    for k, v in old.items():
        spark.conf.set(k, v)
    for name in names:
        spark.sql(f"drop table {name}")


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_recordings_meet_without_an_exchange(sides):
    phone, vehicle, p, v = sides
    pairs = joins.row_aligned_pairs(p, v, KEYS)
    audit = aggregates.audit_pairs(pairs, KEYS)
    assert "Exchange" not in plan(pairs) and "Exchange" not in plan(audit) and "SortMergeJoin" in plan(audit)
    assert "Exchange" in plan(joins.row_aligned_pairs(phone, vehicle, KEYS))
    order = lambda df: df.toPandas().sort_values([*KEYS, "paired_rows"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(audit), order(aggregates.audit_pairs(joins.row_aligned_pairs(phone, vehicle, KEYS), KEYS)))


def test_a_file_for_each_bucket(sides):
    files = sides[2].select(F.input_file_name().alias("f")).distinct().count()
    assert files <= 5 and sides[2].count() == 400


def test_a_depot_is_dealt(spark):
    """A third of all points in one cell: no part has more pairs than stated, and the edges are those of a search over all pairs."""
    rng = np.random.default_rng(4)
    at = np.concatenate([rng.uniform(300, 420, (400, 2)), rng.uniform(0, 3000, (800, 2))])
    points = spark.createDataFrame(pd.DataFrame({"id": np.arange(1200), "e": at[:, 0], "n": at[:, 1]}))
    lines = [(f"s{i}", 0.0, 75.0 * i, 3000.0, 75.0 * i) for i in range(40)] + [(f"w{i}", 75.0 * i, 0.0, 75.0 * i, 3000.0) for i in range(40)]
    edges = spark.createDataFrame([(x[0], f"{x[0]}a", f"{x[0]}b", *x[1:], 3000.0) for x in lines], "edge string, a string, b string, ae double, an double, be double, bn double, length double")
    want = {(i, x[0]) for i, (e, n) in enumerate(at) for x in lines if (abs(n - x[2]) if x[0][0] == "s" else abs(e - x[1])) <= 30}
    for work in (None, 50, 400, roads.WORK):
        got = roads.near_edges(points, edges, ["id"], 30.0, 100, work=work)
        assert {(r["id"], r["edge"]) for r in got.collect()} == want and got.count() == len(want)
    cells = points.select("id", F.floor(F.col("e") / 150).alias("cx"), F.floor(F.col("n") / 150).alias("cy"))
    p, r = roads._deal(cells, roads._box(edges, 150.0), ["id"], 400)
    work = p.groupBy("cx", "cy", "part").count().join(r.groupBy("cx", "cy", "part").agg(F.count("*").alias("e")), ["cx", "cy", "part"])
    assert work.agg(F.max(F.col("count") * F.col("e"))).first()[0] <= 800 and p.count() == 1200
    whole = cells.groupBy("cx", "cy").count().join(roads._box(edges, 150.0).groupBy("cx", "cy").agg(F.count("*").alias("e")), ["cx", "cy"])
    assert whole.agg(F.max(F.col("count") * F.col("e"))).first()[0] > 1000
    assert roads.near_edges(points.limit(0), edges, ["id"], 30.0).isEmpty() and roads.near_edges(points, edges.limit(0), ["id"], 30.0).isEmpty()
