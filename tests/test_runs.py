"""Greedy runs by jumps against one pass over all ranges."""

import random

import numpy as np
import pytest

from pointquarry.operators.intervals import jump_runs, next_starts


def one_pass(ranges, gap, most):
    runs = []
    for off, size in sorted(ranges):
        end = off + size
        if runs and off - runs[-1][1] <= gap and max(runs[-1][1], end) - runs[-1][0] <= most:
            runs[-1][1], runs[-1][2] = max(runs[-1][1], end), runs[-1][2] + 1
        else:
            runs.append([off, end, 1])
    return [tuple(r) for r in runs]


def made(seed, n, span, longest):
    draw = random.Random(seed)
    return [(draw.randrange(span), draw.choice([0, 1, draw.randrange(longest), longest * draw.randrange(1, 4)])) for _ in range(n)]


@pytest.mark.parametrize("seed", range(40))
def test_jumps_of_each_range(seed):
    draw = random.Random(seed)
    ranges = sorted(made(seed, 60, draw.choice([50, 400, 3000]), draw.choice([3, 20, 90])))
    gap, most = draw.choice([0, 2, 15]), draw.choice([1, 30, 120])
    off, size = np.array(ranges).T
    jumps = next_starts(off, off + size, gap, most)
    for i in range(len(ranges)):
        runs = one_pass(ranges[i:], gap, most)
        assert jumps[i] == i + runs[0][2]


@pytest.mark.parametrize("seed,span,longest,gap,most", [(1, 2000, 20, 3, 60), (2, 100_000, 50, 100, 400), (3, 300, 5, 0, 1), (4, 5000, 700, 10, 90), (5, 10**9, 3, 2, 50)])
def test_runs_over_many_blocks(spark, seed, span, longest, gap, most):
    rows = [(f, *r) for f in ("a", "b", None) for r in made(f"{seed}{f}", 400, span, longest)] + [("c", 5, 1), ("d", None, 3)]
    df = spark.createDataFrame(rows, "f string, off long, len long")
    got = sorted((r.run_start, r.run_end, r.n) for r in jump_runs(df, gap, most, ["f"], width=most + 1).where("f = 'a'").collect())
    assert got == one_pass([r[1:] for r in rows if r[0] == "a"], gap, most)
    wide = jump_runs(df, gap, most, ["f"]).collect()
    assert sorted((r.run_start, r.run_end, r.n) for r in wide if r.f == "b") == one_pass([r[1:] for r in rows if r[0] == "b"], gap, most)
    assert [(r.run_start, r.run_end, r.n) for r in wide if r.f == "c"] == [(5, 6, 1)]
    assert not [r for r in wide if r.f == "d"]


def test_without_groups_and_without_rows(spark):
    df = spark.createDataFrame(made(7, 200, 900, 9), "off long, len long")
    assert sorted((r.run_start, r.run_end, r.n) for r in jump_runs(df, 1, 20, []).collect()) == one_pass([tuple(r) for r in df.collect()], 1, 20)
    assert jump_runs(df.limit(0), 1, 20, []).collect() == []


def test_a_packed_file_of_a_million_ranges_is_many_tasks(spark):
    ranges = spark.range(1_000_000).selectExpr("'f' as f", "id * 8 as off", "8L as len")
    runs = jump_runs(ranges, 0, 1 << 16, ["f"])
    got = runs.selectExpr("count(*)", "sum(n)", "max(n)", "max(run_end)", "min(run_end - run_start)").first()
    assert tuple(got) == (123, 1_000_000, 8192, 8_000_000, 8_000_000 % (1 << 16))
    assert runs.selectExpr("count(distinct floor(run_start / (4 * 65536)))").first()[0] == 31
