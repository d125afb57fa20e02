import os

import pytest

from guideloom.plans import scratch as module
from guideloom.plans.scratch import Scratch, released, shared_folder
from tests.conftest import rows


class Cluster:
    """A session on a cluster that names no shared folder."""

    class conf:
        get = staticmethod(lambda name, default: default)

    class sparkContext:
        master = "spark://somewhere:7077"


def test_a_cluster_must_name_a_shared_folder(spark):
    with pytest.raises(RuntimeError):
        shared_folder(Cluster)
    Cluster.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        shared_folder(Cluster)
    Cluster.sparkContext.master = "local[2]"
    assert shared_folder(Cluster).startswith("file:///")


def test_tables_of_finished_runs_are_released(spark):
    kept = Scratch(spark, "kept")
    outer = kept.written(spark.range(3))
    folder = os.path.dirname(kept.base.removeprefix("file://"))
    before = set(os.listdir(folder))
    for _ in range(2):
        with released():
            table, n = Scratch(spark, "run").counted(spark.range(5))
            assert n == table.count() == 5 and set(os.listdir(folder)) > before
            with released():
                Scratch(spark, "inner").written(spark.range(2))
        assert set(os.listdir(folder)) == before
    assert rows(outer) == [(0,), (1,), (2,)] and module._open_scopes.get() == ()
