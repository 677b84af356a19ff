"""The nearest point in a seed's node: right, and without pairs of all seeds and points."""

import numpy as np
import pytest

from pointquarry.operators import nearest
from pointquarry.plans.catalogue import QUERIES

POINT = "node_key string, x double, y double, z double, k long"


def test_seeds_meet_few_places(spark, monkeypatch):
    tables, real = {}, nearest.written
    monkeypatch.setattr(nearest, "written", lambda df, tag: tables.setdefault(tag, real(df, tag)))
    draw = np.random.default_rng(7)
    places = np.stack([draw.integers(0, 300, 4000), draw.integers(0, 300, 4000), draw.integers(0, 3, 4000)], axis=1).astype(float)
    asked = draw.integers(0, 600, (200, 3)) / 2.0
    points = [(f"1-0-0-{i % 2}", *map(float, places[i]), 4000 * copy + (i * 7919) % 4000) for i in range(4000) for copy in range(3)]
    seeds = [(j, f"1-0-0-{j % 2}", *map(float, asked[j])) for j in range(200)] + [(200, "9-9-9-9", 0.0, 0.0, 0.0), (201, "1-0-0-0", *map(float, asked[0]))]
    got = {r.seed_id: (r.k, r.distance) for r in nearest.nearest_in_node(spark.createDataFrame(seeds, POINT.replace("node_key", "seed_id long, node_key").replace(", k long", "")), spark.createDataFrame(points, POINT), ["k"], ["k"], 2.0, 4.0).collect()}
    assert set(got) == {*range(200), 201}
    for j, key, *at in seeds[:200]:
        d2, k = min((((x - at[0]) ** 2 + (y - at[1]) ** 2 + ((z - at[2]) * 2) ** 2), k) for node, x, y, z, k in points if node == key)
        assert got[j] == (k, pytest.approx(2 * d2**0.5, abs=1e-9))
    assert got[201] == got[0]
    pairs = tables["cells"].join(tables["places"], ["node_key", "c_x", "c_y", "c_z"]).count()
    assert pairs < 200 * len(points) / 2 / 20


def test_points_nowhere_are_not_near(spark):
    rows = [("a", None, 0.0, 0.0, 1), ("a", float("nan"), 0.0, 0.0, 2), ("a", 3.0, 4.0, 0.0, 3), ("a", 3.0, 4.0, 0.0, 4), ("b", 1.0, 1.0, 1.0, 5)]
    seeds = spark.createDataFrame([(1, "a", 0.0, 0.0, 0.0), (2, "b", None, 0.0, 0.0), (3, "c", 0.0, 0.0, 0.0)], "seed_id long, node_key string, x double, y double, z double")
    assert [tuple(r) for r in nearest.nearest_in_node(seeds, spark.createDataFrame(rows, POINT), ["k"], ["k"]).collect()] == [(1, "a", 3, 5.0)]


def rows_of_joins(node):
    """The most rows that a join of an executed plan gave."""
    while node.nodeName() == "AdaptiveSparkPlan" or node.nodeName().endswith("QueryStage"):
        node = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan()
    own = node.metrics().get("numOutputRows").get().value() if "Join" in node.nodeName() else 0
    return max([own, *(rows_of_joins(node.children().apply(i)) for i in range(node.children().size()))])


@pytest.mark.parametrize("name", ["nearest_in_node", "snap_point"])
def test_copies_of_seeds_and_points_do_not_pair(spark, sf_dir, tmp_path, name):
    shifted = spark.read.parquet(f"{sf_dir}/lineitem.parquet").crossJoin(spark.range(30).withColumnRenamed("id", "i"))
    shifted.selectExpr("* except (i, l_orderkey)", "l_orderkey + i * 1500 as l_orderkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = QUERIES[name](spark, str(tmp_path))
    seeds = len(found.collect())
    assert seeds > 300
    assert rows_of_joins(found._jdf.queryExecution().executedPlan()) <= 5 * seeds
