"""Paths in the shared folder."""

import os
import types

import pytest

from pointquarry import scratch


def test_paths_are_new_and_have_a_scheme(spark):
    a, b = scratch.shared_path(spark, "x"), scratch.shared_path(spark, "x")
    assert a != b and a.startswith("file:/")
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert os.path.isdir(os.path.dirname(a.removeprefix("file://").removeprefix("file:")))
    assert base.rstrip("/") in a


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"])
def test_a_cluster_must_name_its_folder(master):
    context = types.SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_base(types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=context))


def test_a_local_session_gets_a_folder():
    context = types.SimpleNamespace(master="local[4]", getCheckpointDir=lambda: None)
    base = scratch.shared_base(types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=context))
    assert os.path.isdir(base.removeprefix("file://"))
