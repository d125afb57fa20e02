"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing a table and reading it back. The folder is the
one the cluster names in ``spark.checkpoint.dir``; only where that is unset and the master is a
local one (tests, a laptop) a temporary folder is made. A written table survives the loss of
executors. Tables last until the process ends; ``released`` removes those of a finished result
before.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own_root: list[str] = []
_open_scopes: ContextVar[tuple[list[Scratch], ...]] = ContextVar("guideloom_scopes", default=())


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder, or a temporary one if a local session names none; elsewhere an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master.split("[")[0] != "local":
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="guideloom-"))
    return "file://" + _own_root[0]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Written tables of one operator run; ``drop`` removes those no later step reads."""

    _roots: dict[str, SparkSession] = {}

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        root = f"{shared_folder(spark)}/guideloom-{spark.sparkContext.applicationId}"
        if root not in Scratch._roots:
            Scratch._roots[root] = spark
        self.base = f"{root}/{tag}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        for scope in _open_scopes.get():
            scope.append(self)

    def written(self, df: DataFrame) -> DataFrame:
        """df as a table on shared storage, read back without its lineage."""
        self._n += 1
        path = f"{self.base}/{self._n}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._guideloom_path = path
        return back

    def counted(self, df: DataFrame, where: Column | None = None) -> tuple[DataFrame, int]:
        """Like written, with the number of rows (those that meet ``where``), which the tasks that write count as they go."""
        seen = Observation()
        back = self.written(df.observe(seen, (F.count(F.lit(1)) if where is None else F.count_if(where)).alias("n")))
        return back, seen.get["n"]

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete written tables; plans built on them must have run."""
        for table in tables:
            path = getattr(table, "_guideloom_path", None)
            if path:
                _delete(self.spark, path)

    def release(self) -> None:
        """Delete all tables of this run; results that were not written or counted yet are lost."""
        _delete(self.spark, self.base)


@contextmanager
def released() -> Iterator[None]:
    """Tables written by operators inside are deleted at the end: consume their results before."""
    mine: list[Scratch] = []
    token = _open_scopes.set((*_open_scopes.get(), mine))
    try:
        yield
    finally:
        _open_scopes.reset(token)
        for scratch in mine:
            scratch.release()


@atexit.register
def _clean_up() -> None:
    for root, spark in Scratch._roots.items():
        try:
            _delete(spark, root)
        except Exception:  # the session is gone: a local folder can still be cleared, others are the cluster's to clear
            local = root.removeprefix("file://")
            if local.startswith("/"):
                shutil.rmtree(local, ignore_errors=True)
