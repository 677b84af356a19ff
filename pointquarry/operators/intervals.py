"""Byte ranges and time intervals: merging, look-up, overlap."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointquarry.scratch import written


def islands(ranges: DataFrame, max_gap: int, by: list[str], width: int = 1 << 22) -> DataFrame:
    """Adds ``run``: ranges whose gaps are at most ``max_gap`` share one, numbered from 1 in each group.

    A group may be one large file, so it is cut into cells of ``width`` bytes by offset: ranges are ordered
    within a cell only, and what cells before it reach, and the runs begun there, are running
    values over one row for each cell.
    """
    cut = ranges.withColumn("__cell", F.floor(F.col("off") / width))
    own, cell = W.partitionBy(*by, "__cell").orderBy("off", "len"), [*by, "__cell"]
    earlier = W.partitionBy(*by).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    tops = cut.groupBy(*cell).agg(F.max(F.col("off") + F.col("len")).alias("__top")).withColumn("__before", F.max("__top").over(earlier)).drop("__top")
    reach = F.greatest(F.max(F.col("off") + F.col("len")).over(own.rowsBetween(W.unboundedPreceding, -1)), F.col("__before"))
    starts = F.when(reach.isNull() | (F.col("off") - reach > max_gap), 1).otherwise(0)
    begun = cut.join(tops, cell).withColumn("__starts", starts).withColumn("__run", F.sum("__starts").over(own.rowsBetween(W.unboundedPreceding, 0)))
    bases = begun.groupBy(*cell).agg(F.sum("__starts").alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    return begun.join(bases, cell).withColumn("run", F.col("__run") + F.col("__base")).select(*ranges.columns, "run")


def runs_of_islands(islanded: DataFrame, by: list[str]) -> DataFrame:
    """Start, end, number and bytes of each run."""
    return islanded.groupBy(*by, "run").agg(F.min("off").alias("run_start"), F.max(F.col("off") + F.col("len")).alias("run_end"), F.count("*").alias("n"), F.sum("len").alias("data"))


def greedy_runs(ranges: DataFrame, max_gap: int, max_bytes: int, by: list[str]) -> DataFrame:
    """Runs of ranges that a read fetches at once: a range joins the run before it if the gap
    and the bytes from the run's start stay within both limits.

    Where a run starts depends on the run before, but only within an island of small gaps:
    so files are cut into islands first, and each island is folded by itself: 16 bytes for each range of the
    longest island are held at once. ``jump_runs`` holds two blocks instead.
    """
    row, run = F.struct(F.col("off").cast("long").alias("off"), F.col("len").cast("long").alias("len")), "struct<start:bigint,end:bigint,n:bigint>"
    island = islands(ranges, max_gap, by).groupBy(*by, "run").agg(F.array_sort(F.collect_list(row)).alias("rs"))

    def step(state: Column, r: Column) -> Column:
        # The open run is apart from the closed ones, so these are copied once for each run and not for each range.
        last, end = state["open"], r["off"] + r["len"]
        joins = last.isNotNull() & (r["off"] - last["end"] <= max_gap) & (F.greatest(last["end"], end) - last["start"] <= max_bytes)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end"), (last["n"] + 1).alias("n"))
        fresh = F.struct(r["off"].alias("start"), end.alias("end"), F.lit(1).cast("bigint").alias("n"))
        closed = F.when(joins | last.isNull(), state["closed"]).otherwise(F.concat(state["closed"], F.array(last)))
        return F.struct(closed.alias("closed"), F.when(joins, longer).otherwise(fresh).alias("open"))

    none = F.struct(F.array().cast(f"array<{run}>").alias("closed"), F.lit(None).cast(run).alias("open"))
    folded = F.aggregate("rs", none, step, lambda s: F.concat(s["closed"], F.array(s["open"])))
    runs = island.select(*by, F.explode(folded).alias("r"))
    return runs.select(*by, F.col("r.start").alias("run_start"), F.col("r.end").alias("run_end"), F.col("r.n").alias("n"))


def next_starts(off: np.ndarray, end: np.ndarray, max_gap: int, max_bytes: int) -> list[int]:
    """For each range, in order, where the next run starts if one starts at it: the first range behind that is too far from what
    the run reaches, or with which the run is too long. From the last range to the first: a run takes over what the run at its
    next range found, and ends that grow form a stack in which the first too long one is looked up."""
    n, offs, ends = len(off), off.tolist(), end.tolist()
    after_gap, reach, found = [n] * n, [0] * n, [n] * n
    stack, neg = [], []
    for i in range(n - 1, -1, -1):
        top, j = ends[i], i + 1
        while j < n and offs[j] - top <= max_gap:
            top, j = max(top, reach[j]), after_gap[j]
        after_gap[i], reach[i] = j, top
        # The stack holds later ranges with ends that grow away from here; its last is the nearest.
        most = offs[i] + max_bytes
        k = bisect_left(neg, -most) - 1
        found[i] = min(j, i + 1 if ends[i] > most else stack[k] if k >= 0 else n)
        while stack and ends[stack[-1]] <= ends[i]:
            stack.pop()
            neg.pop()
        stack.append(i)
        neg.append(-ends[i])
    return found


def jump_runs(ranges: DataFrame, max_gap: int, max_bytes: int, by: list[str], width: int | None = None) -> DataFrame:
    """The runs of ``greedy_runs``, for files of any length that are one island.

    Where a run starts depends on the run before it, but where the next one starts depends on its own start alone: a jump for each
    range. A group may be one packed file, so it is cut into blocks of ``width`` bytes (at least ``max_bytes``), each with the ranges of the
    block behind it that its runs may reach. A task follows the jumps within a block and gives, for the ranges at which an earlier run may leave off,
    the first start beyond it. These ways from block to block are composed by doubling, so the starts that count are found in as many joins as the
    number of blocks has binary digits; then each block gives its runs. A task holds two blocks, whatever the length of a file or island.

    Returns the columns ``by``, ``run_start``, ``run_end`` and ``n``. Equal ranges count each. Lengths are not negative; rows with a null offset or length are in no run.
    """
    width = max(max_bytes + 1, width or 4 * max_bytes)
    names = {c: f"__by{i}" for i, c in enumerate(by)}
    own = ranges.where("off is not null and len is not null").select(*[F.col(c).alias(n) for c, n in names.items()], F.col("off").cast("long").alias("off"), F.col("len").cast("long").alias("len"))
    own = own.withColumn("block", F.floor(F.col("off") / width).cast("long"))
    keys = list(names.values())
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields if f.name in keys)
    in_zone = F.col("off") - F.col("block") * width <= max_bytes
    firsts = own.groupBy(*keys, "block").agg(F.min(F.struct("off", "len")).alias("head"), F.min(F.when(~in_zone, F.struct("off", "len"))).alias("rest"))
    along = W.partitionBy(*keys).orderBy("block")
    later = firsts.withColumns({"next": F.lead("block").over(along), "next_head": F.lead("head").over(along), "next_rest": F.lead("rest").over(along), "third_head": F.lead("head", 2).over(along)})
    after = F.when(F.col("next") == F.col("block") + 1, F.coalesce("next_rest", "third_head")).otherwise(F.col("next_head"))
    later = written(later.select(*keys, "block", "head", after.alias("after")), "blocks")
    ahead = own.where(in_zone).withColumns({"block": F.col("block") - 1, "mine": F.lit(False)})
    both = own.withColumn("mine", F.lit(True)).unionByName(ahead).join(later, [*keys, "block"])

    def ordered(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, int, tuple]:
        off, size, mine = (rows.column(c).to_numpy() for c in ("off", "len", "mine"))
        order = np.lexsort((size, off))
        end = rows.column("after")[0].as_py()
        return off[order], size[order], int(mine.sum()), (end["off"], end["len"]) if end else (None, None)

    def keyed(rows: pa.Table, n: int) -> dict[str, pa.ChunkedArray]:
        return {c: rows.column(c).take(pa.array(np.zeros(n, np.int64))) for c in keys}

    def ways(rows: pa.Table) -> pa.Table:
        off, size, mine, end = ordered(rows)
        jumps, exits = next_starts(off, off + size, max_gap, max_bytes), [0] * mine
        for i in range(mine - 1, -1, -1):
            exits[i] = jumps[i] if jumps[i] >= mine else exits[jumps[i]]
        # An earlier run may leave off at the first range, in the zone, or at the first range behind it.
        entry = np.flatnonzero(off[:mine] - off[0] // width * width <= max_bytes)
        entry = np.unique(np.concatenate([[0], entry, [min(mine - 1, len(entry))]]))
        outs = [exits[i] for i in entry.tolist()]
        to = [(int(off[j]), int(size[j])) if j < len(off) else end for j in outs]
        columns = [off[entry], size[entry], pa.array([t[0] for t in to], pa.int64()), pa.array([t[1] for t in to], pa.int64())]
        return pa.table(keyed(rows, len(entry)) | {c: pa.array(v) for c, v in zip(("off", "len", "to_off", "to_len"), columns, strict=True)})

    def runs(rows: pa.Table) -> pa.Table:
        off, size, mine, _ = ordered(rows)
        end, at = off + size, rows.column("entry")[0].as_py()
        jumps, found = next_starts(off, end, max_gap, max_bytes), []
        i = int(np.flatnonzero((off == at["off"]) & (size == at["len"]))[0])
        while i < mine:
            found.append((int(off[i]), int(end[i : jumps[i]].max()), jumps[i] - i))
            i = jumps[i]
        return pa.table(keyed(rows, len(found)) | {c: pa.array([f[k] for f in found], pa.int64()) for k, c in enumerate(("run_start", "run_end", "n"))})

    place = [*keys, "off", "len"]
    group = [*keys, "block"]
    hops = written(both.groupBy(*group).applyInArrow(ways, f"{kinds}{', ' * bool(keys)}off long, len long, to_off long, to_len long").where("to_off is not null").dropDuplicates(place), "ways")
    heads = later.withColumn("first", F.row_number().over(along)).where("first = 1").select(*keys, "head.off", "head.len")
    starts, n = written(heads, "starts"), -1
    while (m := starts.count()) != n:
        n = m
        reached = starts.join(hops, place).select(*keys, F.col("to_off").alias("off"), F.col("to_len").alias("len"))
        starts = written(starts.union(reached).distinct(), "starts")
        onward = hops.select(*keys, F.col("off").alias("to_off"), F.col("len").alias("to_len"), F.col("to_off").alias("then_off"), F.col("to_len").alias("then_len"))
        hops = written(hops.join(onward, [*keys, "to_off", "to_len"]).select(*place, F.col("then_off").alias("to_off"), F.col("then_len").alias("to_len")), "ways")
    entered = starts.select(*keys, F.floor(F.col("off") / width).cast("long").alias("block"), F.struct("off", "len").alias("entry"))
    out = both.join(entered, group).groupBy(*group).applyInArrow(runs, f"{kinds}{', ' * bool(keys)}run_start long, run_end long, n long")
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], "run_start", "run_end", "n")


def learnt_total(responses: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``known``: the ``total`` of the first response (by off and len) of each group that tells one, from that
    response on; null before. The first ones are a partial aggregate, a row for each group."""
    first = responses.where("total is not null").groupBy(*by).agg(F.min(F.struct("off", "len", "total")).alias("__first"))
    known = F.when(F.struct("off", "len") >= F.struct("__first.off", "__first.len"), F.col("__first.total"))
    return responses.join(first, by, "left").withColumn("known", known).drop("__first")


def feasibility(ranges: DataFrame, gaps: list[int], by: list[str]) -> DataFrame:
    """How many runs each gap limit leaves, and which part of the bytes read is waste."""
    out = None
    for g in gaps:
        runs = runs_of_islands(islands(ranges, g, by), by)
        one = runs.agg(F.lit(g).cast("long").alias("gap"), F.sum("n").alias("ranges"), F.count("*").alias("runs"), F.sum("data").alias("data"), F.sum(F.col("run_end") - F.col("run_start")).alias("span"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("waste_pct", (F.col("span") - F.col("data")) * 100.0 / F.col("span"))


def covering_region(asked: DataFrame, regions: DataFrame, width: int, by: list[str]) -> DataFrame:
    """The first region (by start) that holds each asked range whole; null where none does.

    A region is listed in each bucket of ``width`` bytes that it touches, and a range
    looks into the bucket of its start: an equi-join in place of a scan over all regions.
    """
    cells = F.sequence(F.floor(F.col("run_start") / width), F.floor((F.col("run_end") - 1) / width))
    listed = regions.select(*by, "run_start", "run_end", F.explode(cells).alias("cell"))
    a = asked.withColumn("cell", F.floor(F.col("off") / width))
    met = a.join(listed, [*by, "cell"], "left")
    holds = (F.col("run_start") <= F.col("off")) & (F.col("run_end") >= F.col("off") + F.col("len"))
    found = F.min(F.when(holds, F.struct("run_start", "run_end"))).alias("r")
    return met.groupBy(*by, "off", "len").agg(found).select(*by, "off", "len", F.col("r.run_start").alias("run_start"), F.col("r.run_end").alias("run_end"))


def exact_ranges(asked: DataFrame, ranges: DataFrame, by: list[str], order: str) -> DataFrame:
    """Asked ranges that are exactly one of the ranges; the last by ``order`` counts where offsets repeat."""
    known = ranges.groupBy(*by, "off").agg(F.max_by("len", F.struct(order, "len")).alias("len"))
    return asked.join(known, [*by, "off", "len"], "left_semi")


def concurrency(intervals: DataFrame, start: str, end: str, width: float, by: list[str] | None = None) -> DataFrame:
    """``most``: how many intervals are open at once at most (one that ends frees its place first).

    Starts and ends are summed by buckets of ``width``; running sums over buckets give the
    number open where a bucket begins, and events are ordered within each bucket only.
    """
    by = by or []
    t = intervals.select(*by, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("step")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("step")))).alias("e")).select(*by, "e.*")
    events = t.groupBy(*by, F.floor(F.col("t") / width).alias("cell"), "t", "step").agg(F.sum("step").alias("steps"))
    order = W.partitionBy(*by, "cell").orderBy("t", "step").rowsBetween(W.unboundedPreceding, 0)
    own = events.withColumn("open", F.sum("steps").over(order)).groupBy(*by, "cell").agg(F.max("open").alias("peak"), F.sum("steps").alias("net"))
    before = F.coalesce(F.sum("net").over(W.partitionBy(*by).orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return own.withColumn("before", before).groupBy(*by).agg(F.max(F.col("before") + F.col("peak")).alias("most"))


def burst(events: DataFrame, t: str, span_ms: int) -> DataFrame:
    """``most``: how many events fall into [t, t + span] at most, over all events.

    Times are milliseconds and compared to the microsecond. Each event is listed in its
    bucket of the span's width and in the one before; windows run within buckets.
    """
    micros, span = F.round(F.col(t) * 1000).cast("long"), span_ms * 1000
    cell = F.floor(F.col("t") / span)
    both = events.select(micros.alias("t")).select("t", cell.alias("own"), F.explode(F.array(cell, cell - 1)).alias("cell"))
    ahead = F.count("*").over(W.partitionBy("cell").orderBy("t").rangeBetween(W.currentRow, span))
    return both.withColumn("n", ahead).where("own = cell").agg(F.max("n").alias("most"))
