"""What driver and executors share: a folder, frames cut off from their lineage there, and this package's code."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local session without one (as in tests) gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    spark.conf.set("quotaline.shared", own := spark.conf.get("quotaline.shared", None) or tempfile.mkdtemp(prefix="quotaline-"))
    return own


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed when the driver's process ends."""
    folder = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:  # else the session has ended already
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tasks(spark: SparkSession) -> int:
    """Tasks that keep all cores busy with work that is small for its number of rows."""
    return 2 * spark.sparkContext.defaultParallelism


def cut(frame: DataFrame, parts: int | None = None) -> DataFrame:
    """The frame's rows, computed now and read from the shared folder afterwards, whichever executors are lost.

    ``parts`` writes at most so many files, and later stages read them with as many tasks.
    """
    frame = frame if parts is None else frame.coalesce(parts)
    spark = frame.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return frame.checkpoint()


def discard(*frames: DataFrame) -> None:
    """Remove what ``cut`` wrote for frames that are not read any more."""
    for frame in frames:
        rdd = next((p.rdd() for p in _plans(frame._jdf.queryExecution().analyzed()) if p.getClass().getSimpleName() == "LogicalRDD"), None)
        if rdd is not None and rdd.getCheckpointFile().isDefined():
            _remove(frame.sparkSession, rdd.getCheckpointFile().get())


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of what ran before and is not referred to any more.

    It does so when the driver's garbage is collected, which a large driver puts off while the disks fill. What still
    runs is referred to.
    """
    gc.collect()
    spark._jvm.System.gc()


def _plans(plan):
    yield plan
    children = plan.children()
    for k in range(children.size()):
        yield from _plans(children.apply(k))


def ship(spark: SparkSession) -> None:
    """Let Spark send this package to its Python workers, unless they start where it can be imported."""
    root, context = Path(__file__).resolve().parents[2], spark.sparkContext
    found = [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]
    if context.applicationId in _shipped or any(Path(f).resolve() == root for f in found):
        return
    folder = tempfile.mkdtemp(prefix="quotaline-code-")  # of the driver, which serves it to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    clean = shutil.copytree(root / __package__.split(".")[0], f"{folder}/{__package__.split('.')[0]}", ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{folder}/code", "zip", folder, Path(clean).name))
    _shipped.add(context.applicationId)
