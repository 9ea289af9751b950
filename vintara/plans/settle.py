"""End a frame's lineage where several later steps start from it."""

from __future__ import annotations

import tempfile
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Settled tables kept for later queries of the same session; the oldest go first.
KEPT = 32
_kept: OrderedDict[tuple, DataFrame] = OrderedDict()


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: the one in spark.checkpoint.dir.

    Where the setting is missing, a local session gets a temporary folder; on a cluster that is an
    error, because driver and executors share no local folders.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def settle(frame: DataFrame) -> DataFrame:
    """Write ``frame`` once to the shared folder and read it from there.

    Later steps then share one computation, plans stay small, and a lost executor costs no rerun.
    """
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def state_of(spark: SparkSession, path: str) -> int:
    """A number that changes when a file below ``path`` is added, removed or written again (names, sizes and times; files are not read)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files, found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True), []
    while files.hasNext():
        file = files.next()
        found.append((file.getPath().toString(), file.getLen(), file.getModificationTime()))
    return hash(tuple(sorted(found)))


def once(spark: SparkSession, name: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """The settled table ``name`` of this session, built when first asked for.

    The last part of the name is the path of the input. A table is built anew once a file there has changed.
    """
    key = (spark.sparkContext.applicationId, *name, state_of(spark, name[-1]))
    if key not in _kept:
        _kept[key] = settle(build())
        while len(_kept) > KEPT:
            _kept.popitem(last=False)
    _kept.move_to_end(key)
    return _kept[key]


def forget() -> None:
    """Drop all kept tables, so that the next query builds its own."""
    _kept.clear()
