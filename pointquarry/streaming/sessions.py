"""Tile requests of sessions as a stream: each is answered once, and only while its session is open."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pointquarry.scratch import shared_path

#: A request that takes longer is answered with an error.
TIMEOUT_MS = 40_000.0
#: Kinds of events and the answers they get while their session is open.
OPEN, CLOSE = "signup", "close"
ANSWERS = {"click": "data", "view": "json", "purchase": "empty"}
ANSWER_SCHEMA = "event_id long, sid long, t_ms double, answer string"


def answers_of(events: pd.DataFrame, is_open: bool) -> tuple[pd.DataFrame, bool]:
    """The answers to a session's events in order, and whether it is open afterwards."""
    events = events.sort_values(["t_ms", "event_id"])
    # The last opening or closing before an event says whether the session is open there.
    active = events["outcome"].map({OPEN: 1.0, CLOSE: 0.0}).ffill().fillna(float(is_open)).to_numpy() > 0
    answer = events["outcome"].map(ANSWERS).fillna("error").where(events["dur_ms"] <= TIMEOUT_MS, "timeout")
    # A closing fails what is not answered by then; one in a later batch finds all answered.
    closed = events["t_ms"].where(events["outcome"] == CLOSE).bfill()
    answer = answer.where(~(events["t_ms"] + events["dur_ms"].clip(upper=TIMEOUT_MS) > closed), "aborted").where(active, "inactive")
    asked = ~events["outcome"].isin([OPEN, CLOSE])
    return events.assign(answer=answer)[asked][["event_id", "sid", "t_ms", "answer"]], bool(active[-1]) if len(active) else is_open


def answered(requests: DataFrame, idle_ms: int | None = 3_600_000) -> DataFrame:
    """Answers of a stream of requests (event_id, sid, t_ms, dur_ms, outcome).

    A session's state is whether it is open. A session without events for ``idle_ms`` is
    forgotten, which closes it: a late request then gets ``inactive`` and does not open it
    again; with none, sessions are kept, as fits a bounded run. A request that comes twice is answered once.
    """

    def of_session(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        is_open = bool(state.exists and state.get[0])
        out, is_open = answers_of(pd.concat(list(parts)), is_open)
        state.update((is_open,))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield out

    once = requests.dropDuplicates(["event_id"])
    return once.groupBy("sid").applyInPandasWithState(of_session, ANSWER_SCHEMA, "is_open boolean", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def answer_all(requests: DataFrame) -> DataFrame:
    """Run the stream over all that is there and return what was written."""
    spark = requests.sparkSession
    out, marks = shared_path(spark, "answers"), shared_path(spark, "answers-checkpoint")
    run = answered(requests, None).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(ANSWER_SCHEMA).parquet(out)


def with_status(answers: DataFrame) -> DataFrame:
    """Adds the HTTP status of each answer."""
    status = F.when(F.col("answer").isin("data", "json"), 200).when(F.col("answer") == "empty", 404).otherwise(500)
    return answers.withColumn("status", status)


def pending_at_close(events: DataFrame) -> DataFrame:
    """(event_id, sid, closed_ms): requests that are not answered yet when their session closes next."""
    after = W.partitionBy("sid").orderBy("t_ms", "event_id").rowsBetween(1, W.unboundedFollowing)
    closed = F.min(F.when(F.col("outcome") == CLOSE, F.col("t_ms"))).over(after)
    asked = events.withColumn("closed_ms", closed).where(~F.col("outcome").isin(OPEN, CLOSE))
    return asked.where(F.col("t_ms") + F.least(F.col("dur_ms"), F.lit(TIMEOUT_MS)) > F.col("closed_ms")).select("event_id", "sid", "closed_ms")
