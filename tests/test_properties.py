"""Laws that hold for all inputs."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pointquarry.operators.intervals import burst, concurrency, greedy_runs
from pointquarry.sinks.tiles import parsed_tile, tile_bytes
from pointquarry.streaming.sessions import answers_of

RANGES = st.lists(st.tuples(st.integers(0, 400), st.integers(1, 60)), min_size=1, max_size=25)
SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SLOW
@given(RANGES)
def test_runs_cover_their_ranges(spark, ranges):
    df = spark.createDataFrame([(0, a, n) for a, n in ranges], "f int, off long, len long")
    runs = sorted((r.run_start, r.run_end, r.n) for r in greedy_runs(df, 20, 150, ["f"]).collect())
    want, done = sorted(ranges), []
    for a, n in want:
        if done and a - done[-1][1] <= 20 and a + n - done[-1][0] <= 150:
            done[-1] = (done[-1][0], max(done[-1][1], a + n), done[-1][2] + 1)
        else:
            done.append((a, a + n, 1))
    assert runs == sorted(done)


@SLOW
@given(RANGES)
def test_concurrency_and_bursts(spark, ranges):
    df = spark.createDataFrame([(float(a), float(a + n)) for a, n in ranges], "s double, e double")
    most = max(sum(a <= t < a + n for a, n in ranges) for t, _ in ranges)
    assert concurrency(df, "s", "e", 50.0).first().most == most
    assert burst(df, "s", 16).first().most == max(sum(t <= a <= t + 16 for a, _ in ranges) for t, _ in ranges)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(*[st.floats(-1e7, 1e7)] * 3), min_size=1, max_size=20))
def test_positions_survive_a_tile(points):
    xyz = np.array(points)
    extent = np.where(np.ptp(xyz, axis=0) > 0, np.ptp(xyz, axis=0), 1)
    got = parsed_tile(tile_bytes(xyz, np.zeros((len(xyz), 3)), []))["xyz"]
    assert (np.abs(got - xyz) <= extent / 65535 + 1e-6).all()


def test_sessions_answer_in_order():
    import pandas as pd

    e = pd.DataFrame([(1, 7, 0.0, 1.0, "click"), (2, 7, 1.0, 1.0, "signup"), (3, 7, 2.0, 1.0, "click"), (4, 7, 3.0, 50_000.0, "view"), (5, 7, 4.0, 1.0, "purchase")], columns=["event_id", "sid", "t_ms", "dur_ms", "outcome"])
    out, is_open = answers_of(e, False)
    assert out["answer"].tolist() == ["inactive", "data", "timeout", "empty"]
    assert is_open
    assert answers_of(e[:1], True)[0]["answer"].tolist() == ["data"]
    closed, is_open = answers_of(e.assign(outcome=["signup", "click", "close", "click", "signup"]), False)
    assert closed["answer"].tolist() == ["data", "inactive"]
    assert is_open


def test_closing_fails_what_is_unanswered():
    import pandas as pd

    e = pd.DataFrame({"event_id": range(5), "sid": 1, "t_ms": [0.0, 10.0, 20.0, 30.0, 40.0], "dur_ms": [1.0, 5.0, 15.0, 1.0, 1.0], "outcome": ["signup", "click", "click", "close", "click"]})
    # Answered in time; still waiting at the closing; after it.
    assert answers_of(e, False)[0]["answer"].tolist() == ["data", "aborted", "inactive"]
    # A request that ends when its session closes was answered; a timeout answers before a later closing.
    assert answers_of(e.assign(dur_ms=[1.0, 20.0, 10.0, 1.0, 1.0]), False)[0]["answer"].tolist() == ["data", "data", "inactive"]
    late = e.assign(t_ms=[0.0, 10.0, 20.0, 90_000.0, 90_001.0], dur_ms=100_000.0)
    assert answers_of(late, False)[0]["answer"].tolist() == ["timeout", "timeout", "inactive"]


def test_pending_at_close(spark):
    from pointquarry.streaming.sessions import pending_at_close

    rows = [(0, 1, 0.0, 1.0, "signup"), (1, 1, 10.0, 5.0, "click"), (2, 1, 20.0, 15.0, "view"), (3, 1, 30.0, 1.0, "close"), (4, 1, 31.0, 9.0, "click"), (5, 2, 20.0, 15.0, "click")]
    events = spark.createDataFrame(rows, "event_id long, sid long, t_ms double, dur_ms double, outcome string")
    assert [tuple(r) for r in pending_at_close(events).collect()] == [(2, 1, 30.0)]
    assert pending_at_close(events.limit(0)).isEmpty()


def test_iso_time_and_unknown_dataset(spark):
    from pyspark.sql import functions as F

    from pointquarry.functions.numbers import iso_time
    from pointquarry.sources.clouds import chosen_datasets

    got = spark.createDataFrame([(0.0,), (-1.0,), (951_782_399_999.9,), (None,)], "ms double").select(iso_time(F.col("ms")).alias("t"))
    assert [r.t for r in got.collect()] == ["1970-01-01T00:00:00.000Z", "1969-12-31T23:59:59.999Z", "2000-02-28T23:59:59.999Z", None]
    known = spark.createDataFrame([("b", "second", 2), ("a", "first", 1)], "id string, label string, place int")
    asked = spark.createDataFrame([("b",), ("zz",), (None,)], "asked_id string")
    assert sorted(r.label for r in chosen_datasets(asked, known, "place").collect()) == ["first", "first", "second"]
