"""Paths of call trees and time of their nodes."""

from pointquarry.operators import callpaths

KIND = "id long, parent long, name string, hits long"


def test_paths(spark):
    rows = [(1, None, "main", 0), (2, 1, "draw", 3), (3, 2, "read", 9), (4, 1, "read", 9), (5, 3, None, 2), (6, 99, "lost", 1), (7, 8, "loop", 5), (8, 7, "pool", 4), (9, 1, "idle", None)]
    got = {r.name: (r.id, r.hits, r.length, r.path) for r in callpaths.busiest_paths(spark.createDataFrame(rows, KIND), hops=6).collect()}
    assert got["read"] == (3, 9, 3, "main > draw > read")
    assert got["(anon)"] == (5, 2, 4, "main > draw > read > (anon)")
    assert got["lost"] == (6, 1, 1, "lost")
    assert got["loop"] == (7, 5, 6, "pool > loop > pool > loop > pool > loop")
    assert set(got) == {"draw", "read", "(anon)", "lost", "loop", "pool"}
    assert callpaths.busiest_paths(spark.createDataFrame([], KIND)).collect() == []


def test_long_chains_stop_after_the_hops(spark):
    rows = [(i, i - 1 if i else None, f"n{i}", int(i == 60)) for i in range(61)]
    r = callpaths.busiest_paths(spark.createDataFrame(rows, KIND)).first()
    assert (r.length, r.path) == (25, " > ".join(f"n{i}" for i in range(36, 61)))


def test_self_times(spark):
    rows = [(i, None, "abc"[i % 3], h) for i, h in enumerate([10, 3, 1, 2, 0, None])]
    got = [tuple(r) for r in callpaths.self_times(spark.createDataFrame(rows, KIND), ["name"], top=2).collect()]
    assert got == [("a", 12, 3.0, 75.0)]
    assert callpaths.self_times(spark.createDataFrame([], KIND), ["name"]).collect() == []
